"""Line differences against the plain table, and on long texts."""

import random
import time
import tracemalloc

import pytest

from velarium.operators import linediff


def plainly(left, right):
    """By the whole table of common lengths."""
    sizes = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            sizes[i][j] = sizes[i + 1][j + 1] + 1 if left[i] == right[j] else max(sizes[i + 1][j], sizes[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            out.append(("UNCHANGED", left[i]))
            i, j = i + 1, j + 1
        elif i < len(left) and (j >= len(right) or sizes[i + 1][j] >= sizes[i][j + 1]):
            out.append(("REMOVED", left[i]))
            i += 1
        else:
            out.append(("ADDED", right[j]))
            j += 1
    return out


@pytest.mark.parametrize("letters, kept", [("ab", 1), ("abc", 2), ("abcdefgh", 3), ("ab", 1000)])
def test_like_the_whole_table(monkeypatch, letters, kept):
    monkeypatch.setattr(linediff, "KEPT_ROWS", kept + 1)
    monkeypatch.setattr(linediff, "KEPT_BYTES", 0)
    monkeypatch.setattr(linediff, "_OFTEN", 3)
    rng = random.Random(kept)
    for _ in range(400):
        left, right = ([rng.choice(letters) for _ in range(rng.randrange(25))] for _ in range(2))
        assert list(linediff.compare(left, right)) == plainly(left, right)


def test_fifty_thousand_lines():
    """All lines of either side are on the other, many of them often, and the texts are far from equal."""
    rng = random.Random(4)
    left = [str(rng.randrange(20_000)) if rng.random() < 0.7 else "" for _ in range(50_000)]
    right = [line for line in left if rng.random() < 0.9]
    for _ in range(500):
        k = rng.randrange(len(right))
        right[k : k + 10] = sorted(right[k : k + 10])
    tracemalloc.start()
    began = time.time()
    out = list(linediff.compare(left, right))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [line for change, line in out if change != "ADDED"] == left and [line for change, line in out if change != "REMOVED"] == right
    assert sum(change == "UNCHANGED" for change, _ in out) > 40_000
    assert peak < 60_000_000 and time.time() - began < 120


def test_rows_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(linediff, "KEPT_BYTES", 100_000)
    rng = random.Random(6)
    x, y = ([rng.randrange(50) for _ in range(6_000)] for _ in range(2))
    tracemalloc.start()
    pairs = list(linediff.common(x, y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)
    assert peak < 3_000_000  # the whole table has 36 million places
