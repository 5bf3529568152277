import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velarium.llm import packing
from velarium.llm.queries import tokenizer_path


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, df):
    want = {}
    for (doc, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.setdefault((doc, p // 2048), []).append((p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    pieces = packing.tokenize(df, tokenizer_path())
    got = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()
    seen, bins = {}, {}
    for r in got:
        seen.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r.length for r in got)


def test_round_trip(odd, docs):
    for df in (odd, docs):
        n, total = check([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df)
        assert n <= -(-total // 2048) * 1.02 + 1


def test_empty(none):
    assert packing.pack(packing.tokenize(none, tokenizer_path())).collect() == []


def test_one_id_for_all_rows(spark):
    """A doc_id that all rows share is dealt into several groups."""
    df = spark.createDataFrame([(None, f"some words of text {i}") for i in range(400)], "doc_id long, text string")
    got = packing.pack(packing.tokenize(df, tokenizer_path()).drop("ids"), group=50).collect()
    assert len(got) == 400 and len({r.sequence_id % 8 for r in got}) == 8


def test_ids_stay_exact_beside_nulls(spark):
    rows = [((1 << 60) + 1, "a b"), (None, "c"), ((1 << 60) + 3, None), ((1 << 60) + 3, None)]
    got = packing.pack(packing.tokenize(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).drop("ids")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, (1 << 60) + 1, (1 << 60) + 3, (1 << 60) + 3]


@pytest.mark.parametrize("seed", range(12))
def test_search_ends_where_nothing_improves(seed):
    """In the last round no bin was emptied; a bin that is still worth an exchange would have taken it."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(20, 90, 40) if seed % 2 else rng.choice([31, 33, 34, 50, 67], 40)
    first = packing.best_fit(lengths, 100)
    search = packing.Search(lengths, first, 100)
    before = sum(f * f for f in search.fill)
    bins = search.run()
    fill = np.bincount(bins, weights=lengths, minlength=len(search.fill))
    assert fill.tolist() == search.fill and fill.max() <= 100 and sum(f * f for f in search.fill) >= before
    used = int((fill > 0).sum())
    assert used <= first.max() + 1
    if used > -(-int(lengths.sum()) // 100):
        again = packing.Search(lengths, bins, 100)
        again.run()
        assert sum(f > 0 for f in again.fill) == used


def test_one_step_finds_any_exchange():
    """Against all moves and exchanges of small bins: a step out of a bin is found exactly where there is one."""
    rng, seen = np.random.default_rng(1), set()
    for _ in range(300):
        lengths = rng.integers(1, 60, 9)
        bins = packing.best_fit(rng.permutation(lengths), 100) if rng.random() < 0.5 else np.arange(9) // 3
        fill = np.bincount(bins, weights=lengths)
        if fill.max() > 100:
            continue
        source = int(np.argmin(fill))
        only = np.where(fill == 0, 0, fill)
        search = packing.Search(lengths, bins, 100)
        for b in range(len(fill)):
            if b != source:
                search.open(b)
        items = [sorted(int(n) for n, x in zip(lengths, bins, strict=True) if x == b) for b in range(len(fill))]
        sums = lambda own: {1: set(own), 2: {a + b for k, a in enumerate(own) for b in own[k + 1 :]}}
        want = 0
        for t in range(len(fill)):
            if t == source or not 0 < only[t] < 100:
                continue
            mine, theirs = sums(items[source]), sums(items[t])
            gains = [g for g in mine[1]] + [g - h for n, m in ((1, 1), (2, 1), (1, 2)) for g in mine[n] for h in theirs[m]]
            want = max([want, *(g for g in gains if 0 < g <= 100 - only[t])])
        before = search.fill[source]
        found = search.step(source)
        seen.add(bool(found))
        assert found == (want > 0)
        if found:
            assert 0 < before - search.fill[source] <= want
    assert seen == {True, False}


def test_search_empties_what_best_fit_leaves():
    lengths = np.random.default_rng(0).integers(600, 1000, 3000)
    first = packing.best_fit(lengths, 2048)
    bins, offsets = packing.pack_lengths(lengths)
    assert bins.max() <= first.max() and np.bincount(bins, weights=lengths).max() <= 2048


def encoded(tokenizer, texts):
    ids, bounds = tokenizer.encode(pa.array(texts))
    assert all(ids[b - 1] == 0 for b in bounds[1:])
    return [ids[a : b - 1].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


ODD_TEXTS = ["a  b\u0085c", "İstanbul ΣΑΣ", "don't i'm 'RE x", "e\u0301 ﬁ Ⅷ ² ½", "<|endoftext|> <|startoftext|>x", "1234 56", "\x1c\x1d a\x0bb", "naïve—“quote”…", "ŉ ſ ǅ µ ª", "", " ", "\0", "a\0b"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_tokenizer_equals_whole(text):
    assert encoded(packing.ChunkTokenizer(tokenizer_path()), [text])[0] == np.array(whole_ids([text])[0][:-1], "<u4").tobytes()


def test_texts_of_both_sorts_together():
    texts = [t for pair in zip(ODD_TEXTS, [f"plain text {k}, it's" for k in range(len(ODD_TEXTS))], strict=True) for t in pair]
    assert encoded(packing.ChunkTokenizer(tokenizer_path()), texts) == [np.array(ids[:-1], "<u4").tobytes() for ids in whole_ids(texts)]


def test_small_cache_is_only_slower():
    texts = [f"word{i} w{'abc'[i % 3]}x it's, {i}!?" for i in range(300)]
    want = [np.array(ids[:-1], "<u4").tobytes() for ids in whole_ids(texts)]
    tokenizer = packing.ChunkTokenizer(tokenizer_path(), cache=20)
    assert [x for k in range(0, 300, 7) for x in encoded(tokenizer, texts[k : k + 7])] == want
