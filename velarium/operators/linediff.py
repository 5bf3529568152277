"""Line differences by longest common subsequence, a document at a time, in bounded memory.

Rows of the table of common lengths are bit vectors (a big integer each: a zero bit where the length grows), so
a row takes a few operations on as many bits as there are lines. Only some rows are kept: the rows between two
kept ones are made again when the way through the table gets there, by the same rule at each level. So memory is a
bounded number of rows, whatever the number of lines, and no length but those beside the way is ever counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of the rows kept at a level, and rows at least.
KEPT_BYTES, KEPT_ROWS = 4_000_000, 8
#: Lines that occur as often have their bits kept; others' are set anew for each row.
_OFTEN = 64


def common(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of places of a longest common subsequence. Where both places' lines are equal they are a pair; else x's is passed if that costs nothing, or else y's."""
    n, m = len(x), len(y)
    places: dict[int, list[int]] = {}
    for j, line in enumerate(y):
        if line >= 0:
            places.setdefault(line, []).append(m - 1 - j)  # bits count from the end, as lengths do
    whole = (1 << m) - 1
    often = {line: sum(1 << r for r in at) for line, at in places.items() if len(at) >= _OFTEN}

    def above(i: int, below: int) -> int:
        """Row i from row i + 1."""
        match = often.get(x[i])
        if match is None:
            match = 0
            for r in places.get(x[i], ()):
                match |= 1 << r
        hit = below & match
        return ((below + hit) | (below - hit)) & whole

    keep = max(KEPT_ROWS, KEPT_BYTES // (m // 8 + 64))

    def rows(start: int, end: int, last: int) -> Iterator[int]:
        """Rows start to end - 1 in order, of which `last` is the one at end."""
        step = max(1, -(-(end - start) // keep))
        kept = {end: last}
        row = last
        for i in range(end - 1, start - 1, -1):
            row = above(i, row)
            if step == 1 or (i - start) % step == 0:
                kept[i] = row
        if step == 1:
            for i in range(start, end):
                yield kept.pop(i)
            return
        del kept[start]
        for i in range(start, end, step):
            stop = min(i + step, end)
            yield from rows(i, stop, kept.pop(stop))

    j = 0
    following = rows(0, n, whole)
    row = next(following, whole)  # row i
    for i in range(n):
        below = next(following, whole)  # row i + 1
        # Common lengths from here: of row i (here) and of row i + 1 (under).
        rest = (1 << (m - j)) - 1
        here, under = m - j - (row & rest).bit_count(), m - j - (below & rest).bit_count()
        while j < m:
            if x[i] == y[j]:
                yield i, j
                j += 1
                break
            if here == under:
                break  # passing x's line costs nothing
            r = m - 1 - j
            here, under = here - (not row >> r & 1), under - (not below >> r & 1)
            j += 1
        row = below


def compare(before: list[str], after: list[str]) -> Iterator[tuple[str, str]]:
    """(UNCHANGED, REMOVED or ADDED, line) in order. What both begin with is taken first; a common end isn't, as its lines may go with earlier ones."""
    head, short = 0, min(len(before), len(after))
    while head < short and before[head] == after[head]:
        head += 1
    a, b = before[head:], after[head:]
    # Lines that only the first side has are passed wherever they come up; the other side's stand for nothing.
    both = {line: k for k, line in enumerate(set(a) & set(b))}
    x = [i for i, line in enumerate(a) if line in both]
    for line in before[:head]:
        yield "UNCHANGED", line
    p = q = 0
    for i, j in common([both[a[i]] for i in x], [both.get(line, -1) for line in b]):
        i = x[i]
        yield from (("REMOVED", line) for line in a[p:i])
        yield from (("ADDED", line) for line in b[q:j])
        yield "UNCHANGED", a[i]
        p, q = i + 1, j + 1
    yield from (("REMOVED", line) for line in a[p:])
    yield from (("ADDED", line) for line in b[q:])


#: Lines of a batch that goes back to Spark.
_BATCH = 20_000


def line_diff(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, line_number, change, line. A NULL text is the empty text. Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            pack = lambda out, kind=batch.schema.field(0).type: pa.RecordBatch.from_arrays(
                [pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[key, "line_number", "change", "line"]
            )
            for k in range(batch.num_rows):
                name, a, b = (batch.column(c)[k].as_py() for c in range(3))
                for n, (change, line) in enumerate(compare((a or "").split("\n"), (b or "").split("\n"))):
                    for column, value in zip(out, (name, n, change, line), strict=True):
                        column.append(value)
                    if len(out[0]) >= _BATCH:
                        yield pack(out)
                        out = [[], [], [], []]
            yield pack(out)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, before, after).mapInArrow(run, f"`{key}` {kind}, line_number int, change string, line string")
