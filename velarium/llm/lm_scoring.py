"""LM scoring: subword lattice likelihood.

A text is a sequence of tokens: its words (A-Z lower-cased, cut at white space), then one end. Each word is a
lattice over its UTF-8 bytes: an edge for each piece of an existing vocabulary that stands there (single bytes
are always pieces, so any word has a way through), and one edge for the word as a whole if it was seen in
training. All ways through the lattice count: a forward recursion in log space adds up their probabilities,
and a text's score is the sum over its tokens, the log10 probability of the text. The model is proper: the
probabilities of all texts add up to one.

    p(end)  = (c(end) + 0.5) / (N + 1)
    p(word) = (1 - p(end)) * (max(c - d, 0) / Nw + d * Vw / Nw * sum over segmentations of the product of piece weights)

c counts the training texts' tokens, N all, Nw those that are words, of which Vw are distinct; d discounts what
was seen to make room for what wasn't (n1 / (n1 + 2 n2), of the numbers of words seen once and twice). The
pieces' first weights are the vocabulary's own scores; a few rounds of expectation-maximisation (forward and
backward over the lattices of all distinct training words) fit them to the training texts, each distinct word
counted once, since what the pieces must spell is words that are new. The vocabulary itself is never trained.

Counts of words stay a table, which grows with the corpus; only the pieces' weights (as many as the vocabulary
has) and the words that make up a fixed share of all tokens (so at most `FREQUENT` of them) go to every task.
Other words of a text meet their counts by a shuffle on the word, and their lattices are computed there.

Defined cases: a null text is the empty text and has the end alone; without a training text, words have their
lattices' probability, the base score is 0 for each token and an end has probability one half; very long texts
and words are read as a whole; repeated rows are each scored; an empty table gives an empty result; columns of
other names aren't read. Rows are told apart by partition and place, so docs should be read from files (or be
written first) if executors may be lost.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize, utf8

#: Words with at least this share of all training tokens (1 / FREQUENT) are known to every task, if not longer than LONG bytes.
FREQUENT, LONG = 1 << 16, 256
ROUNDS = 3
#: Distinct words that a counting task holds before it passes them on, and bytes of the words whose lattices are made at once.
HELD, CHUNK = 400_000, 1 << 19
#: In front of each word, as the mark of a word's start in the vocabulary; the end of a text counts as the empty word.
_MARK, END = b" ", b""
_LN10 = math.log(10)


@dataclass
class Pieces:
    """A vocabulary's pieces as UTF-8 bytes (with a space as the mark of a word's start), and the natural logs of their weights, which add up to one."""

    names: list[bytes]
    logs: np.ndarray
    _trie: tuple = field(default=None, repr=False)

    def __getstate__(self):
        return {"names": self.names, "logs": self.logs, "_trie": None}

    def trie(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Next node by node * width + column of a byte, piece of each node (-1: none). Node 0 is the root, and a dead end. Made once a process."""
        if self._trie is None:
            children: list[dict[int, int]] = [{}]
            ends = [-1]
            for k, name in enumerate(self.names):
                at = 0
                for byte in name:
                    if byte not in children[at]:
                        children[at][byte] = len(children)
                        children.append({})
                        ends.append(-1)
                    at = children[at][byte]
                ends[at] = k
            table = np.zeros((len(children), 256), np.int32)
            for node, to in enumerate(children):
                table[node, list(to)] = list(to.values())
            self._trie = table.reshape(-1), np.array(ends, np.int32)
        return self._trie


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece model, read on the driver. Pieces with capitals, or with white space but at the start, can't match and are left out; each byte is a piece.

    Scores of a unigram model are log probabilities; those of merges are ranks, whose weights fall as 1 / (rank + 10).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    unigram = 0.5 < sum(math.exp(s) for _, s in plain if s < 0) < 2
    weights: dict[bytes, float] = {}
    for piece, score in plain:
        name = piece.replace("▁", " ").encode()
        if name == name.lower() and not set(name[1:]) & set(b" \t\n\x0b\x0c\r"):
            weights[name] = math.exp(score) if unigram else 1 / (10 - score)
    return make_pieces(weights)


def make_pieces(weights: dict[bytes, float]) -> Pieces:
    """Pieces of given weights, and each byte, and the mark, as pieces of small weight where there is none."""
    least = min(weights.values(), default=1.0) / 10
    whole = {bytes([b]): least for b in range(256) if b not in b"\t\n\x0b\x0c\r" and not 65 <= b <= 90} | weights
    names = sorted(whole)
    logs = np.log([whole[n] for n in names])
    return Pieces(names, logs - np.logaddexp.reduce(logs))


def _chunks(words: list[bytes]):
    """Places of words in chunks of like lengths, shortest first."""
    order = np.argsort([len(w) for w in words], kind="stable")
    held: list[int] = []
    for k in order.tolist():
        n = len(words[k]) + 1
        if held and (n > 1.25 * (len(words[held[0]]) + 1) + 2 or n * len(held) > CHUNK):
            yield np.array(held)
            held = []
        held.append(k)
    if held:
        yield np.array(held)


def _lattice(words: list[bytes], pieces: Pieces, expect: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Words of like lengths, shortest first: the log of each word's summed segmentations and, if expected counts are asked for, how often each piece is used in all."""
    table, ends = pieces.trie()
    lengths = np.array([len(w) + 1 for w in words])
    high, many = int(lengths[-1]), len(words)
    data = np.frombuffer(b"".join((_MARK + w).ljust(high, b"\n") for w in words), np.uint8).reshape(many, high).T.astype(np.int32).copy()
    forward = np.full((high + 1, many), -np.inf)
    forward[0] = 0.0
    edges = []  # start, end, words, pieces
    for s in range(high):
        begin = int(np.searchsorted(lengths, s, side="right"))
        at = np.arange(begin, many, dtype=np.int32)
        node = table[data[s, begin:]]
        t = s + 1
        while True:
            alive = node > 0
            if not alive.all():
                at, node = at[alive], node[alive]
            if not len(at):
                break
            piece = ends[node]
            hit = piece >= 0
            if hit.any():
                who, what = (at, piece) if hit.all() else (at[hit], piece[hit])
                forward[t, who] = np.logaddexp(forward[t, who], forward[s, who] + pieces.logs[what])
                if expect:
                    edges.append((s, t, who, what))
            if t == high:
                break
            node = table[node * 256 + data[t, at]]
            t += 1
    total = forward[lengths, np.arange(many)]
    if not expect:
        return total, None
    backward = np.full((high + 1, many), -np.inf)
    backward[lengths, np.arange(many)] = 0.0
    used, shares = [], []
    for s, t, who, what in reversed(edges):  # by falling start, so backward[t] is whole
        value = pieces.logs[what] + backward[t, who]
        backward[s, who] = np.logaddexp(backward[s, who], value)
        used.append(what)
        shares.append(np.exp(forward[s, who] + value - total[who]))
    return total, np.bincount(np.concatenate(used), np.concatenate(shares), minlength=len(pieces.names))


def word_logs(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural logs of the words' summed segmentations."""
    out = np.zeros(len(words))
    for chunk in _chunks(words):
        out[chunk] = _lattice([words[k] for k in chunk.tolist()], pieces, False)[0]
    return out


def expected(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in the words, over all their segmentations."""
    out = np.zeros(len(pieces.names))
    for chunk in _chunks(words):
        out += _lattice([words[k] for k in chunk.tolist()], pieces, True)[1]
    return out


@dataclass
class Model:
    """words: table (word binary, c), the end as the empty word. tokens, distinct: N and V, the end among them; ends: c(end); discount: d."""

    pieces: Pieces
    words: DataFrame
    tokens: int
    distinct: int
    ends: int
    discount: float

    @property
    def p_end(self) -> float:
        return (self.ends + 0.5) / (self.tokens + 1)

    @property
    def spelled(self) -> float:
        """The share of words that is left to the pieces."""
        n, v = self.tokens - self.ends, self.distinct - (self.ends > 0)
        return self.discount * v / n if n else 1.0

    def word_scores(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 of p(word)."""
        n = max(1, self.tokens - self.ends)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - self.discount, 0) / n)
        return (math.log1p(-self.p_end) + np.logaddexp(whole, math.log(self.spelled) + word_logs(words, self.pieces))) / _LN10

    def base(self, count):
        """log10 of a token's share with 0.5 added to each count."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def tokens(data: bytes) -> list[bytes]:
    """The words of a text; both functions of bytes take ASCII only, which is A-Z and the white space meant here."""
    return data.lower().split()


def count(docs: DataFrame) -> DataFrame:
    """docs (text) -> word, c: words, and the end as the empty word. Counted in each task before the shuffle."""

    def task(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for k in range(batch.num_rows):
                held.update(tokens(utf8(batch.column(0).slice(k, 1))[0]))
                held[END] += 1
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Expectation-maximisation of the pieces' weights over all words (word), each once."""
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary

        def expect(batches, shared=shared):
            pieces = shared.value
            total = np.zeros(len(pieces.names))
            for batch in batches:
                total += expected(batch.column(0).to_pylist(), pieces)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "n"])

        found = words.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # no more rows than pieces
        if not found.num_rows:
            break
        counts = np.full(len(pieces.names), 0.1)  # so that no piece dies
        counts[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        pieces = Pieces(pieces.names, np.log(counts / counts.sum()))
    return pieces


def train(docs: DataFrame, allowed: Column, vocabulary: str | Pieces, rounds: int = ROUNDS) -> Model:
    """docs (text): counts and weights from all rows where allowed holds. vocabulary: a SentencePiece model's path, or pieces."""
    pieces = load_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary
    words = materialize(count(docs.where(allowed)), "words")
    is_word = F.length("word") > 0
    of = lambda test: F.coalesce(F.sum(F.when(test, 1)), F.lit(0))
    row = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(~is_word, F.col("c"))), F.lit(0)).alias("ends"),
        of(is_word & (F.col("c") == 1)).alias("once"), of(is_word & (F.col("c") == 2)).alias("twice"),
    ).first()
    discount = row.once / (row.once + 2 * row.twice) if row.once else 0.5
    return Model(fit(words.where(is_word).select("word"), pieces, rounds), words, row.n, row.v, row.ends, min(discount, 0.95))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep (of docs), with n_tokens, n_known, base_score and score: a row for each row of docs."""
    spark = docs.sparkSession
    often = model.words.where((F.col("c") >= max(1, model.tokens / FREQUENT)) & F.length("word").between(1, LONG)).toArrow()  # FREQUENT words at most
    names, counts = often.column("word").to_pylist(), often.column("c").to_numpy().astype(np.int64)
    scores = model.word_scores(names, counts) if names else np.zeros(0)
    frequent = {w: pair for w, *pair in zip(names, model.base(counts).tolist(), scores.tolist(), strict=True)}
    shared = spark.sparkContext.broadcast((frequent, float(model.base(model.ends)), math.log10(model.p_end), int(model.ends > 0)))
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def cut(batches):
        """A row for each text with the sums over its end and frequent words, whose word is like none; a row for each of its other words."""
        frequent, end_base, end_score, end_known = shared.value
        part, row = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                index, ids, words, times, known, sums = [], [], [], [], [], []
                for k, data in enumerate(utf8(batch.column(batch.num_columns - 1))):
                    found = Counter(tokens(data))
                    base, value, n, total = end_base, end_score, end_known, 1
                    ids.append(part + row)
                    for word, count in found.items():
                        total += count
                        pair = frequent.get(word)
                        if pair:
                            base, value, n = base + count * pair[0], value + count * pair[1], n + count
                        else:
                            words.append(word)
                            times.append(count)
                            index.append(k)
                    known.append(n)
                    sums.append((base, value, total))
                    row += 1
                ids, index = np.array(ids, np.int64), np.array(index, np.int64)
                more, none = len(index), len(index)
                base, value, total = zip(*sums, strict=True)
                columns = [
                    pa.array(np.concatenate([ids, ids[index]])),
                    pa.array([b" %d" % i for i in ids.tolist()] + words, pa.binary()),
                    pa.array([0] * len(ids) + times, pa.int64()),
                    pa.array(list(total) + [None] * more, pa.int64()), pa.array(known + [None] * none, pa.int64()),
                    pa.array(list(base) + [None] * none, pa.float64()), pa.array(list(value) + [None] * none, pa.float64()),
                ]
                own = [pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, pa.nulls(more, c.type)]) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, *own], names=["_row", "_word", "_n", "_tokens", "_known", "_base", "_score", *keep])

    shape = "_row long, _word binary, _n long, _tokens long, _known long, _base double, _score double" + (f", {kept}" if kept else "")
    met = rows.mapInArrow(cut, shape).join(model.words.select(F.col("word").alias("_word"), F.col("c").alias("_c")), "_word", "left")
    sizes = model.tokens, model.distinct, model.ends, model.discount
    weights = spark.sparkContext.broadcast(model.pieces)

    def weigh(batches):
        """Rows of words get their sums; a batch makes the lattice of a word once."""
        judge = Model(weights.value, None, *sizes)
        for batch in batches:
            times = batch.column(batch.schema.get_field_index("_n")).to_numpy()
            mine = np.flatnonzero(times > 0)
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            if len(mine):
                coded = columns["_word"].take(pa.array(mine)).dictionary_encode()
                code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                counts = np.zeros(len(words), np.int64)
                of = columns["_c"].fill_null(0).to_numpy()[mine]
                counts[code] = of
                n = times[mine]
                for name, found in (("_known", np.where(of > 0, n, 0)), ("_base", n * judge.base(of)), ("_score", n * judge.word_scores(words, counts)[code])):
                    column = columns[name].fill_null(0).to_numpy().copy()
                    column[mine] = found
                    columns[name] = pa.array(column)
            yield pa.RecordBatch.from_arrays([columns[n] for n in out], names=out)

    out = ["_row", "_tokens", "_known", "_base", "_score", *keep]
    fields = "_row long, _tokens long, _known long, _base double, _score double" + (f", {kept}" if kept else "")
    summed = met.mapInArrow(weigh, fields).groupBy("_row").agg(
        *[F.max(k).alias(k) for k in keep], F.max("_tokens").alias("n_tokens"), F.sum("_known").alias("n_known"), F.sum("_base").alias("base_score"), F.sum("_score").alias("score")
    )
    return summed.drop("_row")
