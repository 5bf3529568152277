import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.llm import lm_scoring as lm
from velarium.llm.common import crc_mod
from velarium.llm.queries import piece_path

PIECES = lm.make_pieces({b" a": 3.0, b" ab": 2.0, b"b": 2.0, b"ba": 1.0, b"a": 1.5, b" b": 0.5, b"bab": 0.25, "é".encode(): 1.0, b" bab": 0.3})


def marginal(word, pieces):
    """Sum over all segmentations, by plain recursion."""
    weight = dict(zip(pieces.names, np.exp(pieces.logs)))

    def ways(data):
        return 1.0 if not data else sum(weight[data[:k]] * ways(data[k:]) for k in range(1, len(data) + 1) if data[:k] in weight)

    return ways(b" " + word)


def plainly(rows, held, pieces):
    """Every score from the formulas."""
    seen = Counter()
    for doc_id, text in rows:
        if not held(doc_id):
            seen.update((text or "").encode().lower().split() + [b""])
    n, v = sum(seen.values()), len(seen)
    ends = seen.pop(b"", 0)
    once, twice = (sum(c == k for c in seen.values()) for k in (1, 2))
    d = min(0.95, once / (once + 2 * twice)) if once else 0.5
    p_end = (ends + 0.5) / (n + 1)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        score = math.log10(p_end)
        for w in words:
            spelled = d * len(seen) / (n - ends) if n - ends else 1.0
            score += math.log10((1 - p_end) * (max(seen[w] - d, 0) / max(1, n - ends) + spelled * marginal(w, pieces)))
        out.append((doc_id, len(words) + 1, sum(seen[w] > 0 for w in words) + (ends > 0), base(ends) + sum(base(seen[w]) for w in words), score))
    return out, n


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and a[4] == pytest.approx(b[4], rel=1e-9)


def test_lattice_is_the_sum_over_segmentations():
    words = ["".join(w).encode() for n in range(1, 8) for w in itertools.product("ab", repeat=n)] + ["éab".encode(), b"\xf0\x9f\x98\x80", b"zzb" * 9, b"b" * 60]
    found = lm.word_logs(words, PIECES)
    assert np.exp(found) == pytest.approx([marginal(w, PIECES) for w in words], rel=1e-9)


def test_words_add_up_to_one():
    """Over an alphabet of two letters and no other byte, all words together have probability one."""
    names = [b" a", b" ab", b"b", b"ba", b"a", b" b", b" bab"]
    weights = np.array([9.0, 6.0, 1.0, 0.5, 1.0, 5.0, 4.0])
    pieces = lm.Pieces(names, np.log(weights / weights.sum()))
    total = sum(np.exp(lm.word_logs(["".join(w).encode() for w in itertools.product("ab", repeat=n)], pieces)).sum() for n in range(1, 13))
    assert 0.999 < total <= 1 + 1e-9


def test_expected_counts_are_slopes():
    """How often a piece is expected is the slope of the log likelihood by the log of its weight."""
    words = [b"abba", b"bab", b"aabbab", "aé".encode()]
    found = lm.expected(words, PIECES)
    for k in (PIECES.names.index(b"b"), PIECES.names.index(b" ab"), PIECES.names.index(b"bab")):
        logs = [PIECES.logs.copy(), PIECES.logs.copy()]
        logs[0][k] += 1e-5
        logs[1][k] -= 1e-5
        up, down = (lm.word_logs(words, lm.Pieces(PIECES.names, x)).sum() for x in logs)
        assert found[k] == pytest.approx((up - down) / 2e-5, rel=1e-4)
    assert sum(len(PIECES.names[k]) * found[k] for k in range(len(found))) == pytest.approx(sum(len(w) + 1 for w in words))


def test_rounds_raise_the_likelihood(spark):
    words = [w.encode() for w in ("babab", "abab", "ab", "aba", "bab", "babbab")]
    rows = spark.createDataFrame([(w,) for w in words], "word binary")
    sums = [lm.word_logs(words, lm.fit(rows, PIECES, rounds)).sum() for rounds in (0, 1, 2, 4)]
    assert sums == sorted(sums) and sums[0] < sums[-1]


def test_scores_by_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["ab ab ba", "AB\tba bab", "", None, "é ab abba", "bbbb ab", "ab ab ab", "zz ab", " ab ab\x1f", "aab " * 50])] + [(3, "ab zz"), (3, "ab zz"), (None, "ba ba")]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row int")
    for frequent in (1 << 16, 3):  # all words known to each task, or few
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        model = lm.train(docs, crc_mod(F.col("doc_id"), 5) != 1, PIECES, rounds=2)
        want, n = plainly(rows, held, model.pieces)
        assert model.tokens == n
        same(lm.score(docs, model).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect(), want)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    model = lm.train(odd, crc_mod(F.col("doc_id"), 5) != 1, PIECES)
    same(lm.score(odd, model).select("doc_id", "n_tokens", "n_known", "base_score", "score").collect(), plainly(rows, held, model.pieces)[0])
    assert lm.score(none, model).count() == 0
    empty = lm.train(none, F.lit(True), PIECES)
    found = {r.doc_id: r for r in lm.score(odd, empty).collect()}
    assert found[4].score == pytest.approx(math.log10(0.5)) and found[4].base_score == 0 and found[1].base_score == 0
    assert found[6].score == pytest.approx(math.log10(0.5) + math.log10(0.5) + math.log10(marginal(b"one", PIECES)))
    long = spark.createDataFrame([(1, "ab" * 20_000), (2, "ab " * 300_000)], "doc_id long, text string")
    one, two = lm.score(long, model).orderBy("doc_id").collect()
    assert -1e6 < one.score < -1000 and two.n_tokens == 300_001 and math.isfinite(two.score)


def test_held_out_documents(docs):
    """New texts are likelier than under their pieces' first weights, and real words likelier than their letters in another order."""
    held = crc_mod(F.col("doc_id"), 5) == 1
    model = lm.train(docs, ~held, piece_path())
    first = lm.Model(lm.load_pieces(piece_path()), model.words, model.tokens, model.distinct, model.ends, model.discount)
    total = lambda m, d: d.sparkSession.createDataFrame(lm.score(d, m).select("n_tokens", "score").toPandas()).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    test = docs.where(held)
    fitted, start = total(model, test), total(first, test)
    assert fitted > start + 0.1
    turned = test.withColumn("text", F.reverse("text"))
    assert total(model, turned) < fitted - 1
