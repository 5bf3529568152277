import hashlib
from collections import defaultdict

import numpy as np
import pytest

from velarium.llm import exact_dedup
from velarium.llm.exact_dedup import build_index, build_mphf, dedup, digests_of, find_slots, read_index


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out, done = [], set()
    for doc, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        keep = max(ids, default=None)
        kept = doc == keep and (text or "") not in done
        if kept:
            done.add(text or "")
        out.append((doc, keep, len(groups[text or ""]), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_perfect_and_minimal(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    sizes, bits, slots = build_mphf(digests)
    assert sorted(slots) == list(range(n))
    assert (find_slots(digests, sizes, bits) == slots).all()


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 2, "task_rows": 2}])
def test_against_groups(odd, docs, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    for df in (odd, docs):
        got = sorted((tuple(r) for r in dedup(df, **sizes).collect()), key=repr)
        assert got == expected([(r.doc_id, r.text) for r in df.collect()])


def test_one_id_for_all_rows(spark):
    """A doc_id that all rows share is one key among others."""
    rows = [(None, "same" if i % 3 else f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in dedup(df, task_rows=50).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("past", [0.0, 0.3, 1.0])
def test_ids_beside_nulls_and_repeated_rows(spark, past):
    big = 1 << 60
    rows = [(big + 1, "a"), (None, "a"), (big + 3, "a"), (big + 3, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "c"), (7, "d"), (big + 1, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in dedup(df, past=past).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)
    assert sum(r[3] for r in got) == 5


def test_kept_columns_follow_their_row(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "b", "z")]
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string, mark string"), keep=("mark",)).collect()
    assert sorted((r.mark, r.doc_id) for r in got) == [("x", 1), ("y", 1), ("z", None)]


def test_saved_index(spark, odd, none, tmp_path):
    """A batch is compared with an index that an earlier run has left."""
    old = spark.createDataFrame([((1 << 60) + 1, "one"), (None, "one"), (102, "gone"), (None, "no id here")], "doc_id long, text string")
    build_index(digests_of(old), shard_keys=2).save(f"{tmp_path}/index")
    build_index(digests_of(none)).save(f"{tmp_path}/none")
    got = {r.doc_id: r for r in dedup(odd, history=read_index(spark, f"{tmp_path}/index")).collect()}
    assert (got[6].keep_id, got[6].kept, got[6].group_size) == ((1 << 60) + 1, False, 2)
    assert (got[None].keep_id, got[None].kept, got[None].group_size) == (None, False, 1)
    assert (got[7].keep_id, got[7].kept) == (7, True)
    assert all(r.kept == (r.doc_id != 1) or r.doc_id in (2, 3, 4) for r in dedup(odd, history=read_index(spark, f"{tmp_path}/none")).collect())


def test_history(spark, odd):
    old = spark.createDataFrame([(100, "one"), (101, "one"), (102, "gone")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup(odd, history=old).collect()}
    assert (got[6].keep_id, got[6].kept, got[6].group_size) == (101, False, 2)
    assert (got[7].keep_id, got[7].kept) == (7, True) and (got[1].keep_id, got[1].kept) == (2, False)


def test_empty(none):
    assert dedup(none).collect() == []
