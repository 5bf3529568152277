"""Tables by key and content stores: what a change reads and writes, and who sees what."""

import hashlib
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from velarium.sources import store
from velarium.sources.keyed import Conflict, KeyedTable


@pytest.fixture()
def made(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    return KeyedTable.create(rows, f"{tmp_path}/t", ["k"], buckets=16)


def content(t):
    return {r.k: r.name for r in t.rows().collect()}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, made):
    new = made.upsert(spark.createDataFrame([(5, "five"), (1000, "new")], "k long, name string"))
    changed = {b for b in range(16) if new.folders.get(b) != made.folders.get(b)}
    assert 1 <= len(changed) <= 2 and len(new.folders) == 16
    assert content(new) == {k: f"n{k}" for k in range(200)} | {5: "five", 1000: "new"}
    assert content(made) == {k: f"n{k}" for k in range(200)}, "readers of the old version still see all of it"
    assert content(KeyedTable(spark, made.path)) == content(new) and KeyedTable(spark, made.path, made.version).version == made.version


def test_deletes(spark, made):
    new = made.delete_range("k", 10, 12)
    assert len({b for b in range(16) if new.folders.get(b) != made.folders.get(b)}) <= 2
    assert set(content(new)) == set(range(200)) - {10, 11}
    none = new.delete(F.lit(True))
    assert content(none) == {} and none.folders == {}
    again = none.upsert(spark.createDataFrame([(1, None)], "k long, name string"))
    assert content(again) == {1: None}
    assert content(again.delete(F.col("name") == "x")) == {1: None}


def test_two_writers(spark, made):
    one, two = KeyedTable(spark, made.path), KeyedTable(spark, made.path)
    row = spark.createDataFrame([(1, "a")], "k long, name string")
    first = one.upsert(row)
    with pytest.raises(Conflict):
        two.upsert(row.withColumn("name", F.lit("b")))
    assert content(KeyedTable(spark, made.path)) == content(first) and content(first)[1] == "a"
    named = {f.split("/")[1] for f in first.folders.values()} | {f.split("/")[1] for f in made.folders.values()}
    assert set(os.listdir(f"{made.path}/data")) == named, "what the loser wrote is gone"


def test_keys_and_lookups(spark, made):
    with pytest.raises(ValueError):
        made.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "k long, name string"))
    with pytest.raises(ValueError):
        made.upsert(spark.createDataFrame([(None, "a")], "k long, name string"))
    found = made.get(spark.createDataFrame([(7,), (7,), (5000,)], "k long"))
    assert [tuple(r) for r in found.collect()] == [(7, "n7")] and len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= 2
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, made.path + "x")


def test_vacuum(spark, made):
    new = made.upsert(spark.createDataFrame([(k, "x") for k in range(200)], "k long, name string"))
    assert new.vacuum() == 1 and set(content(new).values()) == {"x"}


def test_filters():
    refs = pd.Series([store.hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)])
    bits = store.make_filter(refs[:1000])
    assert store.may_hold(bits, refs[:1000]).all() and store.may_hold(bits, refs[1000:]).mean() < 0.03
    assert len(bits) == 1250 and store.may_hold(store.make_filter(refs[:1]), refs[:1]).all()


def test_a_put_reads_what_may_hold_it(spark, tmp_path):
    held = store.ContentStore(spark, f"{tmp_path}/s")
    texts = lambda low, high: spark.range(low, high).select(F.concat(F.lit("text "), "id").alias("content"))
    assert held.missing(texts(0, 3)).count() == 3 and held.all().count() == 0
    held.put(texts(0, 400))
    held.put(texts(400, 800))
    assert held.all().count() == 800 and held.all().select("segment").distinct().count() == 2
    again = held.candidates(held.named(texts(5, 7)))
    assert again.count() <= 3 and again.select("segment").distinct().count() == 1, "two texts: their two folders of one segment, and seldom another"
    assert held.candidates(held.named(texts(5000, 5100))).count() <= 30, "of 512 folders, those whose filters are wrong"
    files = held.known(held.named(texts(5, 7))).inputFiles()
    assert len([f for f in files if "/texts/" in f]) <= 3
    assert {r.content for r in held.missing(texts(798, 802)).collect()} == {"text 800", "text 801"}
    held.put(texts(700, 810))
    assert held.all().count() == 810 and held.all().select("ref").distinct().count() == 810
    held.put(texts(0, 10))
    assert held.all().select("segment").distinct().count() == 3, "nothing new, no segment"


def test_a_batch_of_snapshots_and_a_check_of_bodies_are_two_functions(spark):
    rows = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("y", "c")], "batch string, snapshot string")
    found = {r.batch: (r.members, r.identity) for r in store.freeze_batch(rows).collect()}
    assert found == {"x": (["a", "b"], hashlib.sha256(b"a\nb").hexdigest()), "y": (["c"], hashlib.sha256(b"c").hexdigest())}
