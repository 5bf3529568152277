import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from velarium.llm import decontaminate, langid
from velarium.llm.common import crc_mod
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import brute as components


def brute(docs, benchmark):
    """doc_id -> text of what the first four stages keep."""
    kept = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    last = {}
    for d, t in kept:
        last[t] = max(last.get(t, d), d)
    kept = [(d, t) for d, t in kept if last[t] == d]
    least = {d: c for d, _, c in components(kept)}
    kept = [(d, t) for d, t in kept if least[d] == d]
    forms = [decontaminate.normal(t) for _, t in benchmark]
    return {d: t for d, t in kept if not any(f and f in decontaminate.normal(t) for f in forms)}


def test_against_brute_force(spark, sf, docs):
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], benchmark)
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.schema == docs.schema
    assert {r.doc_id: r.text for r in at.collect()} == want
    check_packing(list(want.items()), at)
    rows = P.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(want) and [n for n, _ in P.STAGES][-1] == "pack"


def test_odd_table(spark, sf, odd, monkeypatch):
    for limit in (P.BROADCAST_ROWS, 0):
        monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
        at = odd
        for _, stage in P.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.schema == odd.schema
        # Document 1 is a copy of 2, and 2 of itself; 3, 4, 5 and 10 have no letter.
        assert sorted(r.doc_id or 0 for r in at.collect()) == [0, 2, 6, 7, 8, 9]


def test_rows_without_an_id_of_their_own(spark, sf, tmp_path):
    """Unique rows stay though their id is null, shared, or large; so they do where nothing is labelled."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, words(1)), (None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), ((1 << 60) + 1, words(5)), (None, words(5)), (None, words(6) + " a b"), (None, words(6) + " a b."), (8, words(7))]
    made = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for df in (made, spark.read.parquet(f"{tmp_path}/documents.parquet")):
        at = P.exact_copies(spark, P.language(spark, df, sf), sf)
        assert sorted((r.doc_id or 0, r.text) for r in at.collect()) == sorted({(d or 0, t) for d, t in rows} - {(0, words(5))})
        near = P.near_copies(spark, at, sf).collect()
        left = {t for _, t in rows}
        assert {r.text for r in near} in [left - {words(6) + " a b"}, left - {words(6) + " a b."}, left]
        assert len(near) == len({r.text for r in near})


def test_empty(spark, sf, none):
    at = none
    for _, stage in P.STAGES:
        at = stage(spark, at, sf)
        assert at.collect() == []
    assert langid.train(none, crc_mod(F.col("doc_id"), 4) != 2).languages == []


@pytest.mark.parametrize("name", ["language", "exact_copies", "near_copies", "benchmark_leaks", "pack"])
def test_stages(name):
    assert name in dict(P.STAGES)
