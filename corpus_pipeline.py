"""From raw documents to packed training sequences: language, exact and near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return rows of documents as they came. A row is told by its place in its file, never by its doc_id, so
rows that share an id, or have none, stay or go each by itself. A table that no file holds is written first.

Defined cases: null texts are empty, and have no language, so the first stage drops them; where nothing is
labelled with a language, texts with a letter stay; of rows that are equal in all but their place, one
stays; very long texts are read whole; extra columns are passed on; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.llm import decontaminate, exact_dedup, langid, packing, simhash
from velarium.llm.common import crc_mod, materialize
from velarium.llm.queries import tokenizer_path
from velarium.session import table

#: Up to so many removed rows (24 MB of keys), or groups (60 MB), are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A row's key: a hash of its file's path, and its place there.
KEY = ("_velarium_file", "_velarium_place")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with KEY. Both are facts of the files, so every scan gives a row the same ones."""
    key = {KEY[0]: F.xxhash64("_metadata.file_path"), KEY[1]: F.col("_metadata.row_index")}
    try:
        return docs.withColumns(key)
    except AnalysisException:
        return materialize(docs, "documents").withColumns(key)


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of docs whose KEY isn't in removed."""
    removed = materialize(removed.select(*KEY), "removed")
    return docs.join(F.broadcast(removed) if removed.count() <= BROADCAST_ROWS else removed, list(KEY), "left_anti").drop(*KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: without a letter, or with no n-gram of a learned language beyond chance."""
    return langid.keep_known(docs, langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row of the largest doc_id stays."""
    docs = _numbered(docs)
    return _without(docs, exact_dedup.dedup(docs, keep=KEY).where(~F.col("kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints, one row of the least doc_id stays."""
    docs = _numbered(docs)
    found = materialize(simhash.near_dedup(docs, keep=KEY).select("root", "doc_id", *KEY), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = materialize(best, "best")
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    same = (F.col(f"best.{KEY[0]}") == F.col(KEY[0])) & (F.col(f"best.{KEY[1]}") == F.col(KEY[1]))
    return _without(docs, found.join(best, "root").where(~same))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    pieces = packing.tokenize(docs, tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]

#: The fingerprints' links and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
