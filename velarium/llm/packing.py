"""Best-fit packing: token pieces into sequences, improved by swap-based local search.

Tokens: each document's ids by a public tokenizer, then id 0. Documents longer than a sequence are cut
into whole sequences and a rest; all others stay whole. Pieces are dealt into groups of bounded size;
each group is packed best-fit decreasing, then local search exchanges pieces one for one, two for one
or one for two between underfull sequences, or moves them, as long as the sum of squared fills grows,
so that the emptiest sequence empties. It ends when a round over all underfull sequences empties none.

Defined cases: a null or empty text is the single id 0; an empty table gives an empty result; repeated
rows are packed each; a null doc_id is kept, and large ids stay exact beside it; a very long text is
tokenized whole and cut; other columns aren't read.
"""

from __future__ import annotations

import json
import math
import re
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velarium.llm.common import materialize

CAPACITY = 2048
#: Pieces of a group, at most on average.
GROUP = 60_000
#: Chunks whose ids a worker keeps before it starts anew, and bytes of text that it takes at a time.
CACHE, SLICE = 600_000, 8 << 20
#: Stands for id 0 after each text; no plain text has it.
LAST = "\0"

#: Texts of these characters only: lower-casing and splitting at white space can't differ from the tokenizer's.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-įı-ſ‐-‧‰-⁞]*")

#: The tokenizer's own pattern (fixed value); what it matches is tokenized apart from the rest.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The byte-level alphabet: printable bytes are themselves, the others, in order, the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class ChunkTokenizer:
    """Ids of texts, many at a time: chunks between white space, which the tokenizer never joins, are told apart by Arrow, and each is tokenized once."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.path, self.cache = path, cache
        # The same model alone, for words that are cut and spelled in its alphabet already.
        with open(path, encoding="utf-8") as file:
            plain = json.load(file)
        vocabulary = plain["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.model = Tokenizer.from_str(json.dumps(plain | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        self.forget()

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, for texts that aren't plain."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self, kept: list[str] | None = None) -> None:
        """Starts anew, but for some chunks that are known. chunks: each chunk's number; ids: all their ids, one chunk's after the other's; bounds: where each number's begin and end."""
        if kept:
            at = np.array([0, *map(self.chunks.get, kept)], np.int64)
            sizes = self.bounds[at + 1] - self.bounds[at]
            own, ends = self.ids[_ranges(self.bounds[at], sizes)], np.cumsum(sizes)
        else:
            kept, own, ends = [], np.zeros(1, "<u4"), np.ones(1, np.int64)
        self.chunks: dict[str, int] = {LAST: 0} | dict(zip(kept, range(1, len(kept) + 1), strict=True))
        self.ids, self.bounds, self.n_ids = np.zeros(max(1 << 20, len(own)), "<u4"), np.zeros(max(1 << 16, len(kept) + 2), np.int64), len(own)
        self.ids[: len(own)], self.bounds[1 : len(ends) + 1] = own, ends

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the tokenizer's pattern has cut, and how many each has."""
        ids, lengths = [], []
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(_SPELLING) for w in some]
            got = np.array(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(some):
                each = [self.whole(w) for w in some]
                got, stops = np.concatenate(each), np.cumsum([len(e) for e in each])
            ids.append(got)
            lengths.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, chunks: list[str]) -> None:
        """Numbers new chunks and stores their ids."""
        parts = [(c,) if c.isalpha() else _SPLIT.findall(c) for c in chunks]
        known: dict[str, int] = {}
        at = np.array([known.setdefault(w, len(known)) for p in parts for w in p], np.int64)
        ids, lengths = self.words(list(known)) if known else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        flat = ids[_ranges((np.cumsum(lengths) - lengths)[at], lengths[at])]
        # A chunk's ids are those of its words.
        ends = np.concatenate([[0], np.cumsum(lengths[at])])[np.cumsum([len(p) for p in parts])]
        first, last = len(self.chunks), len(self.chunks) + len(chunks)
        if last >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(last, len(self.bounds)), np.int64)])
        if self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), "<u4")])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.bounds[first + 1 : last + 1] = self.n_ids + ends
        self.n_ids += len(flat)
        self.chunks.update(zip(chunks, range(first, last), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of some texts without nulls, each followed by id 0; and where each text's begin, and the last ends."""
        plain = np.array(["<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts.to_pylist()], bool)
        if not plain.all():
            # Rare: each run of texts of one sort by itself.
            edges, parts, sizes = [0, *(np.flatnonzero(np.diff(plain)) + 1).tolist(), len(plain)], [], []
            for a, b in zip(edges, edges[1:], strict=False):
                if plain[a]:
                    ids, bounds = self.encode(texts.slice(a, b - a))
                    parts.append(ids)
                    sizes.append(np.diff(bounds))
                else:
                    each = [np.append(self.whole(t), np.uint32(0)) for t in texts.slice(a, b - a).to_pylist()]
                    parts += each
                    sizes.append(np.array([len(e) for e in each]))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.utf8_split_whitespace(pc.binary_join_element_wise(pc.utf8_lower(texts), LAST, " "))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        del lists  # what is large goes as soon as it can
        names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.chunks) + len(names) > self.cache:
            self.forget([c for c in names if c in self.chunks and c != LAST])  # words that come again; most others never do
        numbers = list(map(self.chunks.get, names))
        if None in numbers:
            self.learn([c for c, x in zip(names, numbers, strict=True) if x is None])
            numbers = list(map(self.chunks.get, names))
        del names
        numbers = np.array(numbers, np.int64)
        starts, lengths = self.bounds[numbers], self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.zeros(len(of) + 1, np.int64)
        np.cumsum(lengths[of], out=ends[1:])
        ids = np.empty(ends[-1], "<u4")
        for k in range(0, len(of), 1 << 17):  # so that the numbers of places stay in the processor's cache
            some = of[k : k + (1 << 17)]
            ids[ends[k] : ends[k + len(some)]] = self.ids[_ranges(starts[some], lengths[some])]
        return ids, ends[offsets]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, all in one array."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def _slices(texts: pa.Array, size: int = SLICE):
    """Starts and lengths of slices of about so many bytes."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size, side="right")))
        yield start, end - start
        start = end


_open: dict[str, ChunkTokenizer] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): a row for each piece of each row of docs."""

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _open:
            _open[tokenizer_path] = ChunkTokenizer(tokenizer_path)
        encode, names = _open[tokenizer_path].encode, ["doc_id", "piece", "start", "length", "ids"]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, n in _slices(texts):
                ids, bounds = encode(texts.slice(first, n))
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), pieces)
                piece = _ranges(np.zeros(n, np.int64), pieces)
                length = np.minimum(capacity, sizes[owner] - piece * capacity)
                edges = np.append(0, np.cumsum(length)) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
                del ids
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), data], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: a bin number for each length."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    mask, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, at, bins = capacity, bins, bins + 1
        out[i] = at
        if room > n:
            free[room - n].append(at)
            mask |= 1 << (room - n)
    return out


class Search:
    """Local search over one group's bins; every move or exchange raises the sum of squared fills.

    For each length, a heap has the bins that hold a piece of it, roomiest first, and for each sum of two
    lengths those that hold both; old entries are dropped when they come up. So the best exchange of all is
    found by its lengths: a bin has at most 63 different ones, as their sum is at most 2048. No bin, piece or pair is left out.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.lengths, self.bins, self.capacity = lengths.astype(np.int64).tolist(), bins.tolist(), capacity
        self.fill = np.bincount(bins, weights=lengths, minlength=1).astype(np.int64).tolist()
        self.items: list[dict[int, list[int]]] = [{} for _ in self.fill]  # by length
        for i, b in enumerate(self.bins):
            self.items[b].setdefault(self.lengths[i], []).append(i)
        #: By taken length (of one, of two): a heap of (-room, bin, version, lengths).
        self.ones: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.twos: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.rooms: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.most = np.full((2, capacity + 1), -1, np.int64)  # the largest room of each heap, or more where its top is old
        self.version = [0] * len(self.fill)  # odd: in the heaps

    def open(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room <= 0 or not self.fill[b] or self.version[b] & 1:
            return
        self.version[b] += 1
        self.rooms[room].add(b)
        sizes = sorted(self.items[b])
        for k, n in enumerate(sizes):
            heappush(self.ones[n], (-room, b, self.version[b], (n,)))
            self.most[0, n] = max(self.most[0, n], room)
            for m in sizes[k + (len(self.items[b][n]) < 2) :]:
                if n + m <= self.capacity:
                    heappush(self.twos[n + m], (-room, b, self.version[b], (n, m)))
                    self.most[1, n + m] = max(self.most[1, n + m], room)

    def close(self, b: int) -> None:
        if self.version[b] & 1:
            self.version[b] += 1
            self.rooms[self.capacity - self.fill[b]].discard(b)

    def put(self, n: int, source: int, target: int) -> None:
        item = self.items[source][n].pop()
        if not self.items[source][n]:
            del self.items[source][n]
        self.items[target].setdefault(n, []).append(item)
        self.bins[item] = target
        self.fill[source] -= n
        self.fill[target] += n

    def top(self, kind: int, n: int) -> tuple | None:
        """The roomiest bin that is open and holds length n (of one piece, or of two)."""
        heap = (self.ones, self.twos)[kind][n]
        while heap and self.version[heap[0][1]] != heap[0][2]:
            heappop(heap)
        self.most[kind, n] = -heap[0][0] if heap else -1
        return heap[0] if heap else None

    def step(self, source: int) -> bool:
        """Move a piece out of source, or else exchange what takes most out of it; into open bins, which are no emptier."""
        own = sorted(self.items[source], reverse=True)
        for n in own:
            room = next((r for r in range(n, self.capacity + 1) if self.rooms[r]), None)
            if room is not None:
                target = min(self.rooms[room])
                self.close(target)
                self.put(n, source, target)
                self.open(target)
                return True
        given = {n: (n,) for n in own}
        for k, n in enumerate(own):
            for m in own[k + (len(self.items[source][n]) < 2) :]:
                given.setdefault(n + m, (n, m))
        best, how, taken = 0, None, np.arange(self.capacity + 1)
        for size, pieces in given.items():
            for kind in (0, 1) if len(pieces) == 1 else (0,):
                gains = size - taken
                left = np.flatnonzero((gains > best) & (gains <= self.most[kind]))  # of small gains last
                for n in left.tolist():
                    if size - n <= best:
                        break
                    found = self.top(kind, n)
                    if found and size - n <= -found[0]:
                        best, how = size - n, (pieces, found)
                        break
        if how is None:
            return False
        pieces, (_, target, _, sizes) = how
        self.close(target)
        for n in pieces:
            self.put(n, source, target)
        for n in sizes:
            self.put(n, target, source)
        self.open(target)
        return True

    def run(self) -> np.ndarray:
        """Round after round over all underfull bins, emptiest first, until a round empties none or no packing can have fewer."""
        least, used = -(-sum(self.lengths) // self.capacity), sum(f > 0 for f in self.fill)
        while used > least:
            before = used
            order = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (self.fill[b], b))
            for b in order:
                self.open(b)
            for b in order:
                if used <= least:
                    break
                # The bins that stay open come after this one, or were filled more since; it goes back only in the next round.
                self.close(b)
                while self.fill[b] and self.step(b):
                    pass
                used -= not self.fill[b]
            for b in order:
                self.close(b)
            if used == before:
                break
        return np.array(self.bins, np.int64)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """A bin from 0 and a gapless offset for each length."""
    bins = Search(lengths, best_fit(lengths, capacity), capacity).run()
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    base = (ends - lengths[order])[first]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = ends - lengths[order] - base[bins[order]]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (length <= capacity, and any columns) with sequence_id and offset.

    Pieces are dealt into groups by their rows' numbers, so a doc_id that many rows share doesn't make a large group.
    """
    names, fields = pieces.columns, pieces.schema.fields
    pieces = materialize(pieces.withColumn("_velarium_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.where(F.col("length") < capacity).count() / group))

    def packed(rows: pa.Table) -> pa.Table:
        # Ids stay in Arrow: a null among them would make them inexact elsewhere.
        rows = rows.sort_by([("length", "descending"), ("_velarium_row", "ascending")])
        bins, offsets = pack_lengths(rows.column("length").to_numpy(), capacity)
        numbers = bins.astype(np.int64) * groups + rows.column("_velarium_group").to_numpy()
        return rows.select(names).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    rest = pieces.where(F.col("length") < capacity).withColumn("_velarium_group", F.pmod(F.xxhash64("_velarium_row"), F.lit(groups)))
    # Whole sequences need no search; their numbers are negative.
    whole = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).drop("_velarium_row")
    return rest.groupBy("_velarium_group").applyInArrow(packed, schema).unionByName(whole)
