"""SimHash near-dedup: fingerprints, and all links within a Hamming distance by vantage-point trees.

Distinct fingerprints are dealt into shards by the top of a vantage-point tree, whose vantage points
come from a bounded sample (they decide balance only, never results). A fingerprint also goes as a query
to each shard on whose side of a boundary a partner could be, by the triangle inequality. Inside a
shard a tree over its fingerprints answers all queries exactly. A task puts out a spanning forest of
the links that it found, not the links; components are then joined across shards.

Defined cases: a null text is empty; a text without words has fingerprint zero, linked like any
other; one or two words are one shingle; repeated rows and equal texts share a fingerprint; a null
doc_id is never a component's id unless all of its are null; a very long text is read as a whole, some
shingles at a time; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize, utf8
from velarium.llm.graph import connected_components, merge

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a shard, queries of a task, fingerprints of the sample, and of a leaf.
SHARD, BLOCK, SAMPLE, LEAF = 32_768, 131_072, 8_192, 64
_CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    last = min(SHINGLE, len(words))
    ends = (starts[last : last + n] - 1).tolist()
    starts = starts[:n].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and the columns of keep: a row for each row of docs."""

    def compute(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # few texts at a time as Python objects
                part = batch.slice(start, 256)
                fps = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], names=["doc_id", "fp", *part.schema.names[2:]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(compute, ", ".join(["doc_id long, fp long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])]))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


@dataclass
class Node:
    """Points at most mu from vantage are near, the others far. A leaf has its number or its points."""

    vantage: np.uint64 = np.uint64(0)
    mu: int = 0
    near: Node | None = None
    far: Node | None = None
    leaf: int | np.ndarray | None = None

    def route(self, points: np.ndarray, radius: int, at: np.ndarray, out: list) -> None:
        """Appends (leaf, which of the points could have a partner there)."""
        if self.leaf is not None:
            out.append((self.leaf, at))
            return
        d = _distance(points[at], self.vantage).astype(np.int16)
        for child, mask in ((self.near, d <= self.mu + radius), (self.far, d >= self.mu + 1 - radius)):
            if mask.any():
                child.route(points, radius, at[mask], out)


def top_tree(sample: np.ndarray, depth: int, counter: list[int]) -> Node:
    """A tree of the given depth over a sample of fingerprints, its leaves numbered."""
    if depth == 0 or len(sample) < 2:
        counter[0] += 1
        return Node(leaf=counter[0] - 1)
    d = _distance(sample, sample[0])
    mu = int(np.median(d))
    return Node(sample[0], mu, top_tree(sample[d <= mu], depth - 1, counter), top_tree(sample[d > mu], depth - 1, counter))


def _tree(points: np.ndarray, at: np.ndarray) -> Node:
    if len(at) <= LEAF:
        return Node(leaf=at)
    own = points[at]
    d = _distance(own, own[0])
    mu = int(np.median(d))
    if (d <= mu).all():
        mu -= 1
        if not (d <= mu).any():
            return Node(leaf=at)
    return Node(own[0], mu, _tree(points, at[d <= mu]), _tree(points, at[d > mu]))


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int):
    """Yields arrays (query, point) of all pairs within radius, by a vantage-point tree over points."""
    out: list = []
    if len(points) and len(queries):
        _tree(points, np.arange(len(points))).route(queries, radius, np.arange(len(queries)), out)
    for leaf, at in out:
        step = max(1, (1 << 20) // len(leaf))
        for k in range(0, len(at), step):
            q, p = np.nonzero(np.bitwise_count(queries[at[k : k + step], None] ^ points[None, leaf]) <= radius)
            yield at[k : k + step][q], leaf[p]


def _link_shard(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A spanning forest of the links between this task's queries and its shard's points."""
    fps = rows.fp.to_numpy(np.int64).view(np.uint64)
    asks, home = rows["asks"].to_numpy(bool), rows.home.to_numpy(bool)
    nodes, at = np.unique(fps, return_inverse=True)
    points, queries = np.unique(at[home]), np.unique(at[asks])
    parent, held, size = np.arange(len(nodes)), [], 0
    for q, p in near_pairs(nodes[points], nodes[queries], radius):
        held.append((queries[q], points[p]))
        size += len(q)
        if size > 1 << 20:
            parent, held, size = merge(parent, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        parent = merge(parent, *map(np.concatenate, zip(*held, strict=True)))
    linked = parent != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[linked].view(np.int64), "b": nodes[parent[linked]].view(np.int64)})


def link(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """distinct (fp), each once -> links (a, b) that join all that can be reached in steps of at most radius bits."""
    n = distinct.count()
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    drawn = np.array([row.fp for row in drawn], np.int64).view(np.uint64)
    counter = [0]
    tree = top_tree(drawn, max(0, math.ceil(math.log2(max(1, n / shard)))), counter)
    visits: list = []
    if len(drawn):
        tree.route(drawn, radius, np.arange(len(drawn)), visits)
    asked = sum(len(at) for _, at in visits) / max(1, len(drawn)) * n / 2
    blocks = max(1, math.ceil(asked / counter[0] / block))

    def route(batches):
        names = ["shard", "block", "fp", "asks", "home"]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            everything = np.arange(len(fps))
            homes, goes = [], []
            tree.route(fps, 0, everything, homes)  # with radius 0 each point has one leaf
            tree.route(fps, radius, everything, goes)
            of = np.empty(len(fps), np.int64)
            for leaf, at in homes:
                of[at] = leaf
            for leaf, at in goes:
                # Of two shards' partners, the one of the shard with the lower number asks.
                at = at[of[at] <= leaf]
                for b in range(blocks):
                    home = of[at] == leaf
                    asks = (fps[at] % np.uint64(blocks)).astype(np.int64) == b
                    keep = home | asks
                    m = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, leaf, np.int32)), pa.array(np.full(m, b, np.int32)), pa.array(fps[at[keep]].view(np.int64)), pa.array(asks[keep]), pa.array(home[keep])], names=names)

    dealt = distinct.select("fp").mapInArrow(route, "shard int, block int, fp long, asks boolean, home boolean")
    return dealt.groupBy("shard", "block").applyInPandas(lambda rows: _link_shard(rows, radius), "a long, b long")


def near_dedup(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach), root (the component's least fingerprint, which tells it even without ids), and the columns of keep: a row for each row of docs."""
    rows = materialize(fingerprints(docs, keep), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(link(nodes, radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *keep)
