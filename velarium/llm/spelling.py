"""Spelling variant grouping: pairless wildcard groups.

Two words are near if one inserted, deleted or replaced code point makes one of the other. No pair is made:

* for each place of a word, what stands before and after it (its wildcard) is a key; words under one key differ
  by a replacement. A group under a key keeps its size and its two most frequent words, so each of its words
  knows how many others there are and the best of them;
* for each place, the word without it is a key too; where a word of the vocabulary is that key, it learns of
  the number and the best of the longer words, and these learn of it.

Words go as their places in the order of frequency (ties in code-point order), so the best of a group is the
least number, and keys are 124-bit polynomial hashes of what they stand for, made for all places of a word in
linear time: no text but the vocabulary itself is shuffled. A group under a key has no more words than the
alphabet has characters (times the places, for insertions).

A word's form is its near word of largest count, if that is at least `ratio` times its own. Forms lead to more
frequent words only, so following them ends; each round of root finding goes twice as far.

Counting takes the maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of each text, A-Z lower-cased. Where the crc32 of
`<doc_id>:<run>` divides by `noise`, a code point of the run is deleted first, and it counts as what is left.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the crc32; repeated rows
count as often as they are there; an empty table, or one without frequent words, gives an empty result; words
of any length are compared whole; ties go to the smallest word in code-point order; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import discard, materialize, mix64
from velarium.operators.ranking import places

#: Distinct words that a counting task holds before it passes them on.
HELD = 400_000
#: Code points of the words that are hashed at once.
_CHUNK = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Primes below 2**31, and a base for each.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (911382323, 1972663711, 1340762419, 357913943)
#: What a key stands for.
WORD, WILDCARD = 1, 2


def runs(text: str | None, doc_id: str, noise: int = 97) -> Counter:
    """The runs of a text after the deletions, and how many of each there are."""
    found: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    data = (text or "").encode("utf-8", "replace").lower().decode()  # of bytes, lower() takes A-Z only
    for run, n in Counter(_RUN.findall(data)).items():
        h = zlib.crc32(run.encode(), start)
        if noise and h % noise == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        found[run] += n
    return found


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """docs (doc_id, text) -> word, n: words of so many code points and occurrences at least. Counted in each task before the shuffle."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), F.col("text").cast("string").alias("_text"))

    def count(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                for run, n in runs(text.as_py(), name.as_py(), noise).items():
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        yield flush()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**k modulo prime for k below n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out[:n]


def _mixed(parts: list[np.ndarray], *salts) -> tuple[np.ndarray, np.ndarray]:
    """Four hashes of 31 bits as two of 64, apart for different salts."""
    first, second = parts[0] << np.uint64(32) | parts[1], parts[2] << np.uint64(32) | parts[3]
    for salt in salts:
        salt = np.asarray(salt).astype(np.uint64)
        first, second = mix64(first + salt * np.uint64(0x9E3779B97F4A7C15)), mix64(second + salt * np.uint64(0xC2B2AE3D27D4EB4F))
    return first.view(np.int64), second.view(np.int64)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which word, what kind and the two halves of each key. Kinds: 0 a word without one place, WORD itself, WILDCARD. A word without one place has the key that this string has as a word."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    whole, without, wild = [], [], []
    for prime, base in zip(_PRIMES, _BASES, strict=True):
        p = np.uint64(prime)
        power = _powers(int(lengths.max(initial=0)) + 1, base, prime)
        back = np.uint64(pow(base, -1, prime))
        terms = (codes + np.uint64(1)) * power[place] % p
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])  # below 2**64 for 2**33 terms
        full = (sums[starts + lengths] - sums[starts]) % p
        before = (sums[:-1] - sums[starts][owner]) % p
        behind = (sums[(starts + lengths)[owner]] - sums[1:]) % p
        whole.append(full)
        without.append((before + behind * back) % p)
        wild.append((before + behind) % p)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])  # of a run of one letter, each place leaves the same
    once = np.flatnonzero(~same)
    a = _mixed([x[once] for x in without], lengths[owner[once]] - 1)
    b = _mixed(whole, lengths)
    c = _mixed(wild, lengths[owner], place + 1)
    ids = np.concatenate([owner[once], np.arange(len(words)), owner])
    kind = np.concatenate([np.zeros(len(once), np.int8), np.full(len(words), WORD, np.int8), np.full(len(codes), WILDCARD, np.int8)])
    return ids, kind, np.concatenate([a[0], b[0], c[0]]), np.concatenate([a[1], b[1], c[1]])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (place, word; place distinct, in order of preference) -> place, n_near, best: how many words are near, and the least place of these. Words without one have no row."""

    def explode(batches):
        for batch in batches:
            held, size = [], 0
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for row in rows:
                held.append(row)
                size += len(row[1])
                if size > _CHUNK:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    def table(held):
        ids, kind, k1, k2 = keys([w for _, w in held])
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(np.array([p for p, _ in held], np.int64)[ids]), pa.array(kind)], names=["k1", "k2", "place", "kind"])

    rows = vocabulary.select("place", "word").mapInArrow(explode, "k1 long, k2 long, place long, kind byte")
    # A group's members are words that differ in one place, or that hold one more code point than its own word.
    own = F.min(F.when(F.col("kind") == WORD, F.col("place")))
    others = F.sort_array(F.collect_list(F.when(F.col("kind") != WORD, F.col("place"))))
    groups = rows.groupBy("k1", "k2").agg(own.alias("own"), others.alias("others"), F.max(F.col("kind") == WILDCARD).alias("wild")).where("CASE WHEN wild THEN size(others) > 1 ELSE own IS NOT NULL AND size(others) > 0 END")
    first = F.col("others")[0]
    mate = F.when(~F.col("wild"), F.col("own")).when(F.col("m") == first, F.get("others", F.lit(1))).otherwise(first)
    members = groups.withColumn("m", F.explode("others")).select(F.col("m").alias("place"), F.when(F.col("wild"), F.size("others") - 1).otherwise(1).cast("long").alias("n"), mate.alias("best"))
    owners = groups.where("NOT wild").select(F.col("own").alias("place"), F.size("others").cast("long").alias("n"), first.alias("best"))
    return members.unionByName(owners).groupBy("place").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """links (a, b; a distinct, no cycles) -> a, root: the last that following leads to. Each round goes twice as far."""
    at = materialize(links.select("a", F.col("b").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("a").alias("_a"), F.col("root").alias("_next"))
        step = materialize(at.join(ahead, F.col("root") == F.col("_a"), "left").select("a", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = step.select("a", "root")
        at._scratch_path = step._scratch_path
        if step.where("moved").isEmpty():
            return at


def group(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words (word, n; distinct) -> word, form, root, n, n_near, form_n."""
    order = materialize(places(words.select("word", "n", (-F.col("n")).alias("_order")), ["_order", "word"]).select("place", "word", "n"), "words")
    # The groups are read from both sides, so their summary is written.
    near = materialize(near_words(order), "near")
    best = order.select(F.col("place").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = order.join(near, "place", "left").join(best, "best", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    told = materialize(told.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("best"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    last = roots(told.where("best IS NOT NULL").select(F.col("place").alias("a"), F.col("best").alias("b"))).withColumnRenamed("a", "place").withColumnRenamed("root", "_root")
    names = order.select(F.col("place").alias("_root"), F.col("word").alias("root"))
    out = told.join(last, "place", "left").join(names, "_root", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
