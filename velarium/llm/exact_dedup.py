"""Exact dedup: minimal perfect hashes over historical distinct digests.

The history's distinct digests are dealt into shards of bounded size. Each shard gets a minimal perfect
hash whose slots hold the full digest, the winner's id and the group's size. Every row looks up its
digest, compares it byte by byte with the slot's, and so is a member or not. Members belong to their
slot; nonmembers are grouped among themselves. An index can be saved, and later batches read it.

A table without a history of its own is taken as one that grows: a part of its rows, dealt by their
numbers, is the history, and the others come after. Members of a slot may then win against the slot's
own winner, so that the result is that of the table as a whole.

Defined cases: a null text is the empty text; an empty table gives an empty result, and an empty
history has no members; of rows that share a doc_id and a text, one stays, which can't be foretold; a
null doc_id never wins against a number, and one such row is kept where its group has no number; ids stay
exact beside nulls; a very long text is read as a whole, of which only the digest goes on; other columns
aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.llm.common import materialize, mix64

#: Digests of a shard's index, and rows that one lookup task takes, on average at most.
SHARD_KEYS = 100_000
TASK_ROWS = 100_000
#: Up to so many winners of groups (70 MB) go to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Bits of a level for each key that is left.
GAMMA = 2.0


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.reshape(-1, 32).view(np.uint64)
    return words[:, 0], words[:, 1]


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(first + np.uint64(level) * second) % np.uint64(size)).astype(np.int64)


def build_mphf(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """digests: n x 32 bytes, distinct. Returns the levels' sizes, their packed bits, and each digest's slot.

    At each level a key that lands alone on a place sets its bit; the others go on. A key's slot is
    the number of bits set before its own, so n keys fill the slots 0 to n-1.
    """
    first, second = _halves(np.ascontiguousarray(digests))
    left, sizes, bits, places, base = np.arange(len(first)), [], [], np.zeros(len(first), np.int64), 0
    while len(left):
        if len(sizes) > 200:
            raise ValueError("digests of an index must be distinct")
        size = max(8, int(np.ceil(GAMMA * len(left) / 8)) * 8)
        at = _place(first[left], second[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        places[left[done]] = base + at[done]
        sizes.append(size)
        bits.append(alone)
        left, base = left[~done], base + size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - flat
    return np.array(sizes, np.int64), np.packbits(flat), rank[places].astype(np.int64)


def find_slots(digests: np.ndarray, sizes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has its bit. Foreign digests may get any slot."""
    first, second = _halves(np.ascontiguousarray(digests))
    flat = np.unpackbits(packed).astype(bool)[: int(sizes.sum())]
    rank = np.cumsum(flat) - flat
    slots, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
    for level, size in enumerate(sizes):
        at = base + _place(first[left], second[left], level, int(size))
        hit = flat[at]
        slots[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + int(size)
    return slots


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


_INDEX = "shard int, sizes binary, bits binary, digests binary, winners binary, known binary, counts binary"


def _build_shard(group: pa.Table) -> pa.Table:
    digests = _digests(group.column("digest"))
    sizes, packed, slots = build_mphf(digests)
    order, winners = np.argsort(slots), group.column("winner")
    held = (sizes, packed, digests[order], winners.fill_null(0).to_numpy()[order], winners.is_valid().to_numpy()[order], group.column("group_size").to_numpy()[order])
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.table([group.column("shard").slice(0, 1).combine_chunks(), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=names)


_FOUND = "row long, doc_id long, digest binary, shard int, slot int, past_id long, past_size long"


def _look_up(rows: pa.Table, index: pa.Table) -> pa.Table:
    """Rows against their shard's index: their slot and what it holds; without an index, all are nonmembers."""
    n = len(rows)
    slots, winner, size, known = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    if n and len(index):
        shard, mine = index.slice(0, 1).to_pylist()[0], _digests(rows.column("digest"))
        stored = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
        slots = find_slots(mine, np.frombuffer(shard["sizes"], np.int64), np.frombuffer(shard["bits"], np.uint8))
        found = np.flatnonzero(slots >= 0)
        same = (stored[slots[found]] == mine[found]).all(axis=1)
        slots[found[~same]] = -1
        found = found[same]
        winner[found] = np.frombuffer(shard["winners"], np.int64)[slots[found]]
        known[found] = np.frombuffer(shard["known"], bool)[slots[found]]
        size[found] = np.frombuffer(shard["counts"], np.int64)[slots[found]]
    columns = [*(rows.column(c) for c in ("row", "doc_id", "digest", "shard")), pa.array(slots.astype(np.int32), mask=slots < 0), pa.array(winner, mask=~known), pa.array(size)]
    return pa.table(columns, names=[x.split()[0] for x in _FOUND.split(", ")])


def digests_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the SHA-256 of the whole text in UTF-8, and the columns of keep."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest"), *keep)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Index:
    """A row for each shard; table also has their number, so that a saved one says how digests are dealt."""

    table: DataFrame
    shards: int

    def save(self, path: str) -> None:
        self.table.withColumn("shards", F.lit(self.shards)).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> Index:
    table = spark.read.parquet(path)
    first = table.select("shards").first()
    return Index(table.drop("shards"), first[0] if first else 1)


def build_index(digests: DataFrame, shard_keys: int = SHARD_KEYS) -> Index:
    """digests (doc_id, digest), a row for each document: of each digest, the largest doc_id is the winner."""
    entries = materialize(digests.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("group_size")), "exact-entries")
    shards = max(1, -(-entries.count() // shard_keys))
    return Index(materialize(entries.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build_shard, _INDEX), "exact-index"), shards)


def look_up(rows: DataFrame, index: Index, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows (row, doc_id, digest) with shard, slot (null for nonmembers), past_id and past_size of the slot."""
    rows = rows.withColumn("shard", _shard(index.shards))
    # One digest, and one doc_id, may hold a third of all rows: a shard's rows go by number to several tasks, each with a copy of the index.
    splits = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(task_rows)).cast("int").alias("splits"))
    dealt = rows.join(splits, "shard").withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int"))
    copies = index.table.join(splits, "shard").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    asked = dealt.select("shard", "split", "row", "doc_id", "digest").groupBy("shard", "split")
    return asked.cogroup(copies.drop("splits").groupBy("shard", "split")).applyInArrow(_look_up, _FOUND)


def _winners(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with keep_id, group_size and kept: of each key's rows, the one with the largest doc_id (then row) stays. Keys of one row, most of all, aren't in the join."""
    best = materialize(rows.groupBy(*key).agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), "winners")
    # Written first, so that the join's shuffle is its own and a key with a third of all rows can be split.
    joined = rows.join(F.broadcast(best) if best.count() <= BROADCAST_KEYS else best, key, "left")
    return joined.withColumns({"keep_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")), "group_size": F.coalesce("n", F.lit(1).cast("long")), "kept": F.coalesce(F.col("best.row") == F.col("row"), F.lit(True))})


def dedup(docs: DataFrame, history: DataFrame | Index | None = None, shard_keys: int = SHARD_KEYS, task_rows: int = TASK_ROWS, past: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the columns of keep: a row for each row of docs.

    With a history (doc_id, text, or an index), texts found there are repeats of its winner and none of
    their rows is kept. Without, about the share `past` of docs is the history of the rest. Of equal texts
    the largest doc_id wins.
    """
    rows = materialize(digests_of(docs, keep).withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    if history is None:
        index = build_index(rows.where(F.pmod(F.xxhash64("row"), F.lit(1000)) < round(1000 * past)), shard_keys)
    else:
        index = history if isinstance(history, Index) else build_index(digests_of(history), shard_keys)
    found = materialize(look_up(rows, index, task_rows), "exact-found")
    members, others = found.where("slot is not null"), found.where("slot is null")
    if history is None:
        members = _winners(members, ["shard", "slot"])
    else:
        members = members.withColumns({"keep_id": F.col("past_id"), "group_size": F.col("past_size"), "kept": F.lit(False)})
    names = ["row", "doc_id", "keep_id", "group_size", "kept", "digest"]
    judged = members.select(*names).unionByName(_winners(others, ["digest"]).select(*names))
    if keep:
        judged = judged.join(rows.select("row", *keep), "row")
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), *keep)
