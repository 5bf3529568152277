"""Language ID: language-bitmask n-gram filters.

A Bloom filter for each language, bit-sliced: the languages' bits at one place stand together as a mask,
so one lookup tells all languages that hold an n-gram. A text's hits are counted by language, corrected
for the filters' rates of false positives, and the largest count wins.

An n-gram is four UTF-8 bytes of the text, A-Z lower-cased (other letters by str.lower), with what is
no letter turned into single spaces. A language holds an n-gram if it is at least `ratio` times as
frequent in its training texts as in those of the language where it is most frequent. Training takes
about `per_language` documents of each language, drawn by a hash of doc_id and text; this bounds the model.
There may be any number of languages; the masks take as many words as these need.

Defined cases: `und` with score 0 if the text is null or has no letter; a text whose n-grams no
filter holds gets the most frequent language, with score 0; ties go to the more frequent
language, then to the first by name; without a labelled text, all are `und`; an empty table gives an
empty result; repeated rows get equal answers; a very long text is read as a whole; other columns aren't
read. keep_known() takes short texts with a letter, and all with one where nothing is labelled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize, mix64

PER_LANGUAGE, RATIO = 5_000, 0.25
#: Languages of a word of the masks; n-grams of a text that must be unknown to all filters before it counts as in no language.
BITS, TELLING = 63, 40
#: Places of a filter (a power of two), and hash functions.
PLACES, HASHES = 1 << 20, 3
UND = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray | None:
    """A text's n-grams as 32-bit numbers, repeats included; None if it has no letter."""
    if not text:
        return None
    if not text.isascii():
        text = text.lower()
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    if not words or not any(map(str.isalpha, text)):
        return None
    data = np.frombuffer(b" " + b" ".join(words) + b"   ", np.uint8).astype(np.uint32)
    n = len(data) - 5
    return data[:n] | data[1 : n + 1] << 8 | data[2 : n + 2] << 16 | data[3 : n + 3] << 24


def places(codes: np.ndarray) -> list[np.ndarray]:
    """An n-gram's places, one for each hash function."""
    mixed = mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return [((mixed + np.uint64(k) * step) & np.uint64(PLACES - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """languages: most frequent first. masks: at each place a bit for each language, in as many words (rows) as they need. false: each language's rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if codes is None or not self.languages:
            return UND, 0.0
        at, counts = places(codes), []
        for word in range(len(self.masks)):
            found = None
            for place in at:
                found = self.masks[word][place] if found is None else found & self.masks[word][place]
            n = min(BITS, len(self.languages) - word * BITS)
            if n <= 8:
                by_mask = np.bincount(found, minlength=256)
                counts.append(by_mask @ (np.arange(256)[:, None] >> np.arange(n) & 1))
            else:
                some, times = np.unique(found, return_counts=True)  # few masks are different
                counts.append(np.array([int(times[(some >> some.dtype.type(k) & some.dtype.type(1)) > 0].sum()) for k in range(n)]))
        counts = np.concatenate(counts)
        true = np.maximum(0, (counts - self.false * len(codes)) / np.maximum(1e-9, 1 - self.false))
        best, total = int(np.argmax(true)), float(true.sum())
        return self.languages[best], float(true[best]) / total if total > 0 else 0.0

    def knows(self, text: str | None) -> bool:
        """Whether a text is in some language: its filters hold more of its n-grams than false positives would. Fewer than TELLING n-grams, or no filters, tell nothing against a text with a letter."""
        codes = grams(text)
        if codes is None:
            return False
        return not self.languages or len(codes) < TELLING or self.predict(text)[1] > 0


def train(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE, ratio: float = RATIO) -> Model:
    """docs (doc_id, text, lang): learns from rows where allowed holds and text and lang aren't null."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    languages = [r.lang for r in known]
    words = -(-len(languages) // BITS)
    if not languages:
        return Model([], np.zeros((0, PLACES), np.uint8), np.zeros(0))
    # Rows that share an id, or have none, are told apart by their texts, so that they aren't all drawn at once.
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    number = {name: k for k, name in enumerate(languages)}
    shares = F.create_map(*[F.lit(x) for r in known for x in (r.lang, min(1.0, per_language / r["count"]))])

    def count(batches):
        seen = [Counter() for _ in languages]
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = grams(text)
                if codes is not None and lang in number:
                    seen[number[lang]].update(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True)))
        for k, counter in enumerate(seen):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counter), pa.int64()), "l": pa.array([k] * len(counter), pa.int32()), "n": pa.array(list(counter.values()), pa.int64())})

    counts = materialize(rows.where(drawn < shares[F.col("lang")]).select("text", "lang").mapInArrow(count, "gram long, l int, n long").groupBy("gram", "l").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("l").agg(F.sum("n").alias("total"))  # a row for each language
    rates = counts.join(F.broadcast(totals), "l").select("gram", "l", (F.col("n") / F.col("total")).alias("rate"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("l", "rate")).alias("of"))  # as many as languages at most

    def word(w: int) -> Column:
        """Bits of the languages of one word."""
        holds = lambda x: (F.floor(x["l"] / BITS) == w) & (x["rate"] >= ratio * F.col("most"))
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x["l"] % BITS).cast("int"))
        return F.aggregate("of", F.lit(0).cast("long"), lambda mask, x: mask.bitwiseOR(F.when(holds(x), bit(x)).otherwise(F.lit(0).cast("long"))))

    masked = most.select("gram", *[word(w).alias(f"m{w}") for w in range(words)])
    names = [f"m{w}" for w in range(words)]

    def place(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in places(codes):
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns[1:]], names=["place", *names])

    bits = masked.mapInArrow(place, ", ".join(["place long", *(f"{n} long" for n in names)])).groupBy("place").agg(*[F.bit_or(n).alias(n) for n in names])
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(BITS, len(languages)) <= 8 * t().itemsize)
    masks, got = np.zeros((words, PLACES), width), bits.toArrow()  # no more rows than places
    at = got.column("place").to_numpy()
    for w, name in enumerate(names):
        masks[w, at] = got.column(name).to_numpy().astype(width)
    full = np.array([(masks[k // BITS] >> width(k % BITS) & width(1)).mean() for k in range(len(languages))])
    return Model(languages, masks, full**HASHES)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, with lang_pred and score: a row for each row of docs. Reads the text alone for its answer."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as PLACES

    def predict(batches):
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [model.predict(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(predict, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double"]))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs in some language (see Model.knows), with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            mask = [model.knows(texts[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(mask, pa.bool_()))

    return docs.select("*", F.col("text").cast("string").alias("_velarium_text")).mapInArrow(keep, docs.schema)
