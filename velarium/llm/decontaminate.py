"""Benchmark decontamination: pigeonhole edit matching.

Item and text are compared in a normal form: lower case, and a single space for what stands between runs
of letters and digits. An item of n characters may differ by n // 15 edits. It is split into one piece
more than that, so each copy within the budget holds a piece unchanged. An Aho-Corasick automaton finds
all exact pieces in a text; around each, Myers' bit-parallel algorithm gives the least edit distance of
the item to a passage, and its place.

The benchmark is taken in blocks of bounded size, one pass over the texts each.

Defined cases: null texts and items are empty; an item that is empty in normal form is nowhere; one of
fewer than MIN_ITEM characters counts only as a whole text; equal items are each reported; a passage found from
several pieces is reported once; punctuation of any script is between words; very long texts are read
whole; repeated rows are each reported; an empty table gives an empty result
(or, for clean(), leaves the other as it is); other columns are only passed on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize

#: Characters of an item for each edit that it may differ by; the least length of an item that may be a part of a text.
PER_EDIT, MIN_ITEM = 15, 20
#: Characters of a block of the benchmark.
BLOCK = 4_000_000

#: ASCII in normal form; bytes of other characters stay, as those that are neither letters nor digits are spaces by then.
_SPACED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BETWEEN = re.compile(r"[^\x00-\x7f\w]")


def normal(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _BETWEEN.sub(" ", text)
    return b" ".join(text.encode("utf-8", "replace").translate(_SPACED).split()).decode()


@cache
def _words() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.fromiter((chr(k).isalnum() for k in range(0x110000)), bool, 0x110000)


def _places(text: str) -> np.ndarray:
    """For each character of the normal form, its index in the text."""
    lower, at = text.lower(), None
    if len(lower) != len(text):
        parts = [c.lower() for c in text]
        at = np.repeat(np.arange(len(text)), [len(p) for p in parts])
        lower = "".join(parts)
    word = _words()[np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)]
    keep = word.copy()
    keep[1:] |= word[:-1] & ~word[1:]  # the first character after a word is the space
    found = np.flatnonzero(keep)
    if len(found) and not word[found[-1]]:
        found = found[:-1]
    return found if at is None else at[found]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of pattern to a part of text, and where the first such part ends. anchored: to a beginning of text only; then the last."""
    m, masks = len(pattern), {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full | anchored
        mh = (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best or (anchored and score == best):
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.items, self.whole = [], {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            form = normal(text)
            if len(form) < MIN_ITEM:
                if form:
                    self.whole.setdefault(form, []).append(item_id)
                continue
            budget = len(form) // PER_EDIT
            for k in range(budget + 1):
                a, b = len(form) * k // (budget + 1), len(form) * (k + 1) // (budget + 1)
                pieces.setdefault(form[a:b], []).append((len(self.items), a))
            self.items.append((item_id, form, budget))
        self.pieces = list(pieces.items())
        self.automaton = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(self.pieces):
            self.automaton.add_word(piece, k)
        self.longest = max((len(form) + budget for _, form, budget in self.items), default=0)
        if self.pieces:
            self.automaton.make_automaton()

    def find(self, form: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, distance) of each passage of a normal form."""
        out = [(item_id, 0, len(form), 0) for item_id in self.whole.get(form, ())]
        if not self.pieces:
            return out
        done: dict[int, list[int]] = {}
        for last, k in self.automaton.iter(form):
            piece, uses = self.pieces[k]
            for n, offset in uses:
                item_id, item, budget = self.items[n]
                at = last + 1 - len(piece) - offset  # where the item begins, if no edit comes before
                starts = done.setdefault(n, [])  # of its passages so far, in order
                if _near(starts, at, budget):
                    continue
                low = max(0, at - budget)
                part = form[low : at + len(item) + budget]
                distance, end = myers(item, part)
                if distance > budget:
                    continue
                _, back = myers(item[::-1], part[:end][::-1], anchored=True)
                start, end = low + end - back, low + end
                if not _near(starts, start, budget):
                    out.append((item_id, start, end, distance))
                    insort(starts, start)
        return out


def _near(starts: list[int], at: int, by: int) -> bool:
    """Whether one of ascending numbers is at most so far from a number."""
    k = bisect_left(starts, at - by)
    return k < len(starts) and starts[k] <= at + by


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, str]]]:
    """Items (item_id, text) in blocks of about so many characters."""
    held, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((row[0], row[1] or ""))
        chars += len(held[-1][1]) + 100
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


HITS = "doc_id long, item_id long, start long, end long, distance int"


def find_passages(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text, end exclusive), distance: a row for each passage of an item in each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in blocks(benchmark, block):

        def search(batches, items=docs.sparkSession.sparkContext.broadcast(items)):  # a block's size
            matcher, names = Matcher(items.value), [x.split()[0] for x in HITS.split(", ")]
            for batch in batches:
                out: list[tuple] = []
                for k in range(batch.num_rows):
                    text = batch.column(1)[k].as_py() or ""
                    if hits := matcher.find(normal(text)):
                        at = _places(text)
                        out += [(batch.column(0)[k].as_py(), item, int(at[a]), int(at[b - 1]) + 1, d) for item, a, b, d in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c == 4 else pa.int64()) for c in range(5)], names=names)

        part = materialize(rows.mapInArrow(search, HITS), "passages")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no passage of an item, with their columns."""
    for items in blocks(benchmark, block):

        def keep(batches, items=docs.sparkSession.sparkContext.broadcast(items)):
            matcher = Matcher(items.value)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                mask = [not matcher.find(normal(texts[k].as_py())) for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(mask, pa.bool_()))

        docs = docs.select("*", F.col("text").cast("string").alias("_velarium_text")).mapInArrow(keep, docs.schema)
    return docs
