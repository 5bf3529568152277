"""The segmented log: two-phase writes, filters, and streams that go on."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from velarium.sources import log as L


@pytest.fixture()
def path(spark, tmp_path):
    L.register(spark)
    return f"{tmp_path}/log"


def append(spark, path, low, high, parts=2):
    spark.range(low, high, 1, parts).select(F.concat(F.lit("é "), "id").alias("payload")).write.format("velarium_log").option("path", path).mode("append").save()


def read(spark, path):
    return spark.read.format("velarium_log").option("path", path).load()


def test_records_keep_their_offsets(spark, path):
    append(spark, path, 0, 10)
    before = {r.payload: r.offset for r in read(spark, path).collect()}
    append(spark, path, 10, 25, 3)
    after = {r.payload: r.offset for r in read(spark, path).collect()}
    assert sorted(after.values()) == list(range(25)) and before.items() <= after.items() and set(after) == {f"é {k}" for k in range(25)}


def test_a_job_that_fails_leaves_nothing(spark, path):
    append(spark, path, 0, 4)
    files = set(os.listdir(f"{path}/data"))
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("payload"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("velarium_log").option("path", path).mode("append").save()
    log = L.Log(path)
    assert read(spark, path).count() == 4 and log.end() == 4 and len(log.manifests()) == 1
    log.clean(0)  # tasks that were killed while they wrote may have left files
    assert set(os.listdir(f"{path}/data")) == files and log.clean(0) == 0 and read(spark, path).count() == 4
    with pytest.raises(Exception, match="append"):
        bad.where("id < 0").write.format("velarium_log").option("path", path).mode("overwrite").save()


def test_writers_at_once(tmp_path):
    log = L.Log(f"{tmp_path}/l")
    log.make()

    def write(k):
        with open(f"{log.path}/data/{k}", "w") as file:
            file.write(json.dumps(f"r{k}") + "\n")
        log.publish([(str(k), 1)])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = [r for part in log.segments(0, log.end()) for r in log.records(part)]
    assert [k for k, _ in found] == list(range(12)) and {p for _, p in found} == {f"r{k}" for k in range(12)}


def test_bounds_choose_segments(spark, path):
    for k in range(5):
        append(spark, path, 10 * k, 10 * k + 10, 1)
    part = lambda low, high: spark.read.format("velarium_log").option("path", path).option("from", low).option("to", high).load()
    assert [r.offset for r in part(12, 31).orderBy("offset").collect()] == list(range(12, 31)) and part(45, 99).count() == 5 and part(60, 70).count() == 0
    assert part(12, 18).rdd.getNumPartitions() == 1 and read(spark, path).rdd.getNumPartitions() == 5
    rows = read(spark, path)
    assert rows.where("offset < 5").count() == 5 and rows.count() == 50, "a filter of one query stays out of the next"


def test_a_restart_neither_loses_nor_repeats(spark, path, tmp_path):
    def run():
        stream = spark.readStream.format("velarium_log").option("path", path).option("reader", "r1").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.offset, r.payload) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    append(spark, path, 0, 30)
    assert [k for k, _ in run()] == list(range(30))
    append(spark, path, 30, 41, 1)
    append(spark, path, 41, 60)
    rows = run()
    assert [k for k, _ in rows] == list(range(60)) and {p for _, p in rows} == {f"é {k}" for k in range(60)}
    assert run() == rows
    with open(f"{path}/readers/r1") as file:
        assert json.load(file)["offset"] in (30, 60)
