"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

A lexicon of words and stems is learned from labelled texts. Its trie is intersected with the automaton
that accepts all words within an edit budget; made deterministic, it is one table that runs over all
words of a batch at once. Around each hit, a window of text tells quotation (inside quotation marks, or
next to words that talk about words) from address (second person), and a logistic regression weighs
exact, misspelled, quoted and addressed hits.

Learning takes at most `per_class` labelled documents of each class, those with the least hash of
doc_id, which bounds the lexicon, the model and what reaches the driver. Near copies among them count once.

Defined cases: a null text is empty; a text without hits gets the score of no evidence; labels that are
null, or of documents that aren't there, teach nothing; a document labelled twice counts as often as
it is labelled; without labels of both classes every score is the share of toxic labels (0 without any);
an empty table gives an empty result; repeated rows get equal scores; very long texts are scanned whole;
words of all scripts are alike; other columns aren't read. `per_class` also bounds the rows drawn where many
share an id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize

PER_CLASS, LEXICON, MIN_RATIO, MIN_WORD = 8_000, 200, 8.0, 3
#: Words of at least this length may be misspelled, by one edit.
FUZZY_LENGTH = 5
STEMS = range(3, 9)
#: What a misspelled hit counts against an exact one, and how telling (likelihood ratio statistic) an entry must be.
DAMP, MIN_G2 = 0.7, 25.0
#: Characters before and after a hit.
WINDOW = 60
#: Texts that share so many least hashes of their words count as one in learning.
SKETCH = 4

#: Second-person words, words that talk about words or report speech, and pairs of quotation marks.
YOU = frozenset("you your yours yourself u ur tu toi te vous ton ta tes du dich dir ihr euch sie usted ti tus".split())
ABOUT = frozenset("word words term terms called calling said says wrote quote quoted quoting insult slur mot mots terme wort wörter begriff sagte palabra palabras dijo".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "»": "«"}

_DEAD, _START = 0, 1


#: No code point from here on has another lower case.
_LAST_CASED = 1 + max(k for k in range(0x110000) if chr(k).lower() != chr(k))


@cache
def _alnum() -> np.ndarray:
    """For each code point, whether it is a word's character."""
    return np.fromiter((chr(k).isalnum() for k in range(0x110000)), bool, 0x110000)


def words_in(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


@dataclass(frozen=True)
class Entry:
    """A word, or (stem) what words begin with and go on from; the weight is its log-odds."""

    text: str
    stem: bool
    weight: float


class Automaton:
    """The deterministic intersection of a lexicon's trie with Levenshtein automata."""

    def __init__(self, entries: list[Entry], fuzzy_length: int = FUZZY_LENGTH, budget: int = 1):
        self.entries = entries
        children: list[dict[str, int]] = [{}]
        ends: dict[int, list[int]] = {}
        allowed = [0]
        for k, entry in enumerate(entries):
            edits = 0 if entry.stem or len(entry.text) < fuzzy_length else budget
            at = 0
            allowed[0] = max(allowed[0], edits)
            for c in entry.text:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    allowed.append(0)
                at = children[at][c]
                allowed[at] = max(allowed[at], edits)
            ends.setdefault(at, []).append(k)
        letters = sorted({c for e in entries for c in e.text})
        #: 0: no word character, 1: a word character that no entry has, then the entries' letters.
        number = {c: k + 2 for k, c in enumerate(letters)}
        self.classes = _alnum().astype(np.uint16)
        for code in np.flatnonzero(self.classes[: _LAST_CASED]).tolist():
            low = chr(code).lower()
            self.classes[code] = number.get(low, 1) if len(low) == 1 else 1
        for c, k in number.items():
            self.classes[ord(c)] = k

        def close(state: Iterable[tuple]) -> frozenset:
            """With the letters that a word leaves out."""
            todo, seen = list(state), {}
            while todo:
                node, e = todo.pop()
                if seen.get(node, 99) <= e:
                    continue
                seen[node] = e
                if node >= 0 and e < budget:
                    todo += [(child, e + 1) for child in children[node].values() if allowed[child] > e]
            return frozenset(seen.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            out = []
            for node, e in state:
                if node < 0:  # a stem that has been found goes on for ever
                    out.append((node, e))
                    continue
                for letter, child in children[node].items():
                    if letter == c:
                        out.append((child, e))
                        if e == 0:
                            out += [(-1 - k, 0) for k in ends.get(child, ()) if entries[k].stem]
                    elif allowed[child] > e:
                        out.append((child, e + 1))
                if allowed[node] > e:
                    out.append((node, e + 1))
            return close(out)

        first = close([(0, 0)])
        states, order = {first: _START}, [first]
        table: list[list[int]] = [[0] * (len(letters) + 2)]
        accept: list[tuple[int, int]] = [(-1, 0)]
        for state in order:
            row = [0, *([0] * (len(letters) + 1))]
            for k, c in enumerate([None, *letters]):
                target = step(state, c)
                if target and target not in states:
                    states[target] = len(order) + 1
                    order.append(target)
                row[k + 1] = states[target] if target else _DEAD
            table.append(row)
            found = [(e, -entries[-1 - n].weight, -1 - n) for n, e in state if n < 0]
            found += [(e, -entries[k].weight, k) for n, e in state if n >= 0 for k in ends.get(n, ()) if not entries[k].stem and (e == 0 or len(entries[k].text) >= fuzzy_length)]
            accept.append((min(found)[2], min(found)[0]) if found else (-1, 0))
        self.table = np.array(table, np.int32)
        self.accept = np.array(accept, np.int32)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (code points), entry and distance of each word that the automaton accepts."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[codes]
        edge = np.diff((classes > 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        state = np.full(len(starts), _START, np.int32)
        live, j = np.arange(len(starts)), 0
        while len(live):
            live = live[starts[live] + j < ends[live]]
            state[live] = self.table[state[live], classes[starts[live] + j]]
            live, j = live[state[live] != _DEAD], j + 1
        entry, distance = self.accept[state].T
        hit = entry >= 0
        return starts[hit], ends[hit], entry[hit], distance[hit]


def quoted(text: str, start: int, end: int, window: int = WINDOW) -> bool:
    """Between a pair of quotation marks of one line, or near a word that talks about words."""
    before, after = text[max(0, start - window) : start].rpartition("\n")[2], text[end : end + window].partition("\n")[0]
    for opening, closing in QUOTES.items():
        if closing in after and (before.count(opening) % 2 if opening == closing else before.rfind(opening) > before.rfind(closing)):
            return True
    return not ABOUT.isdisjoint(words_in(before)[-4:] + words_in(after)[:4])


def addressed(text: str, start: int, end: int, window: int = WINDOW) -> bool:
    return not YOU.isdisjoint(words_in(text[max(0, start - window) : start])[-4:] + words_in(text[end : end + window])[:4])


FEATURES = ("strength", "quoted", "addressed", "any")


@dataclass
class Model:
    automaton: Automaton | None
    #: Words that the automaton takes for misspellings, but which clean texts use.
    harmless: frozenset[str]
    weights: np.ndarray  # of FEATURES, then the bias

    def features(self, texts: list[str]) -> np.ndarray:
        """A row of FEATURES for each text; texts are scanned together."""
        out = np.zeros((len(texts), len(FEATURES)))
        if self.automaton is None:
            return out
        joined = "\n\n".join(texts)
        bounds = np.cumsum([0] + [len(t) + 2 for t in texts])
        starts, ends, entries, distances = self.automaton.scan(joined)
        owners = np.searchsorted(bounds, starts, side="right") - 1
        for start, end, k, e, i in zip(starts.tolist(), ends.tolist(), entries.tolist(), distances.tolist(), owners.tolist(), strict=True):
            if e and joined[start:end].lower() in self.harmless:
                continue
            text, at, to = texts[i], start - int(bounds[i]), end - int(bounds[i])
            weight = self.automaton.entries[k].weight
            weight *= DAMP if e else 1
            if quoted(text, at, to):
                out[i, 1] += weight
                continue
            out[i, 0] += weight
            out[i, 2] += weight * addressed(text, at, to)
            out[i, 3] = 1
        out[:, :3] = np.log1p(out[:, :3])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.5) -> np.ndarray:
    """Newton's method with a ridge on all but the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), gradient)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def g2(t: int, c: int, toxic: int, clean: int) -> float:
    """How far t of toxic and c of clean documents are from one rate, as a likelihood ratio statistic."""
    share, total = toxic / (toxic + clean), t + c
    return 2 * sum(n * math.log(n / (total * s)) for n, s in ((t, share), (c, 1 - share)) if n)


def choose_lexicon(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int, size: int = LEXICON, min_ratio: float = MIN_RATIO) -> list[Entry]:
    """counts (text, stem, toxic documents, clean documents) -> entries, most telling first; of stems that overlap, and of a stem and the words that are under it, a stem only if it is the most telling."""
    odds = {(text, stem): math.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))) for text, stem, t, c in counts}
    telling = {(text, stem): g2(t, c, toxic, clean) for text, stem, t, c in counts if odds[text, stem] >= math.log(min_ratio)}
    shared = Counter(text[:n] for text, stem in telling if not stem for n in STEMS if len(text) > n)
    chosen: list[tuple[str, bool]] = []
    # A stem needs three telling words; if stems cover the same texts, the longest says the most.
    for text, stem in sorted(telling, key=lambda x: (-telling[x], -len(x[0]), x)):
        if len(chosen) == size or telling[text, stem] < MIN_G2 or (stem and shared[text] < 3):
            continue
        # A word under a stem stays beside it, for its misspellings.
        if not any((s and stem and text.startswith(c)) or (stem and c.startswith(text)) for c, s in chosen):
            chosen.append((text, stem))
    return [Entry(text, stem, min(6.0, odds[text, stem])) for text, stem in chosen]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS, lexicon: int = LEXICON) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); learns from labels of rows where allowed (over doc_id) holds."""
    usable = labels.where(allowed).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    drawn = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The drawn labels are 2 * per_class rows at most, so they can go to every task.
    sample = materialize(texts.join(F.broadcast(materialize(drawn, "labels")), "doc_id").select("text", "toxic"), "labelled")
    drawn = sample.count()
    if drawn > 2 * per_class:
        # Several rows share a drawn id; their texts are drawn again, so that the sample stays in bounds.
        sample = sample.where(F.pmod(F.xxhash64("text", "toxic", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(2 * per_class / drawn * (1 << 30)))
    # Of near copies one counts: else whatever words a much copied text has would be telling.
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    sketch = F.xxhash64(F.slice(F.array_sort(F.transform(words, lambda w: F.xxhash64(w))), 1, SKETCH))
    sample = materialize(sample.withColumn("sketch", sketch).dropDuplicates(["sketch", "toxic"]).drop("sketch"), "labelled")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = (toxic / (toxic + clean)) if toxic + clean else 0.0
    flat = Model(None, frozenset(), np.r_[np.zeros(len(FEATURES)), math.log(max(1e-9, share) / max(1e-9, 1 - share))])
    if not toxic or not clean:
        return flat

    def count(batches):
        seen: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in words_in(text) if MIN_WORD <= len(w) <= 40}
                for key in {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}:
                    seen.setdefault(key, [0, 0])[label] += 1
        yield pa.RecordBatch.from_pydict({"text": pa.array([k[0] for k in seen], pa.string()), "stem": pa.array([k[1] for k in seen], pa.bool_()), "c": pa.array([v[0] for v in seen.values()], pa.int64()), "t": pa.array([v[1] for v in seen.values()], pa.int64())})

    least = max(3, toxic // 1000)
    counted = sample.mapInArrow(count, "text string, stem boolean, c long, t long").groupBy("text", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    total, part = F.col("t") + F.col("c"), toxic / (toxic + clean)
    telling = sum((F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (total * s))).otherwise(0.0) for n, s in (("t", part), ("c", 1 - part))), F.lit(0.0))  # g2() / 2
    # The most telling ones, many times the lexicon's size, so that overlaps can be left out.
    counts = counted.where((F.col("t") >= least) & (odds >= MIN_RATIO)).orderBy(F.desc(telling), "text", "stem").limit(50 * lexicon).collect()
    entries = choose_lexicon([(r.text, r.stem, r.t, r.c) for r in counts], toxic, clean, lexicon)
    if not entries:
        return flat
    automaton = Automaton(entries)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def misspelled(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts, ends, _, distances = shared.value.scan(text)
                for word in {text[a:b].lower() for a, b, e in zip(starts.tolist(), ends.tolist(), distances.tolist(), strict=True) if e}:
                    seen.setdefault(word, [0, 0])[label] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "c": pa.array([v[0] for v in seen.values()], pa.int64()), "t": pa.array([v[1] for v in seen.values()], pa.int64())})

    near = sample.mapInArrow(misspelled, "word string, c long, t long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    harmless = frozenset(r.word for r in near.where((F.col("c") > 0) & (odds < MIN_RATIO)).collect())  # words near an entry, from the sample
    untrained = Model(automaton, harmless, np.zeros(len(FEATURES) + 1))
    names = [*FEATURES, "y"]

    def featured(batches):
        for batch in batches:
            x = untrained.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1).cast(pa.float64())], names=names)

    table = sample.mapInArrow(featured, ", ".join(f"`{n}` double" for n in names)).toArrow()  # 2 * per_class rows at most
    data = np.column_stack([table.column(n).to_numpy() for n in names])
    data = data[np.lexsort(data.T)]
    return Model(automaton, harmless, _logistic(data[:, :-1], data[:, -1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted: a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as its lexicon

    def judge(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = shared.value.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, score double, predicted int")
