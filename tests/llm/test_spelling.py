import random
import re
import zlib
from collections import Counter

from velarium.llm import spelling


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def count_plainly(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def group_plainly(counts, ratio=2):
    form, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(others)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], counts[form[w]] if form[w] else None))
    return rows


def as_rows(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_near_by_brute_force(spark):
    rng = random.Random(1)
    for letters, sizes in (("ab", (1, 7)), ("abcé", (5, 6)), ("aáb", (5, 9))):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(300)}
        counts = {w: rng.choice((3, 3, 4, 7, 15, 40, 200)) for w in words}
        found = spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long"))
        assert as_rows(found) == group_plainly(counts)


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = spelling.count_words(docs)
    want = count_plainly(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    by_length = {w: n for w, n in want.items() if w < "e"}
    found = spelling.group(spark.createDataFrame(list(by_length.items()), "word string, n long"))
    assert as_rows(found) == group_plainly(by_length)


def test_chains_end_at_the_last(spark):
    counts = {"a" * k + "b" * (40 - k): 3 * 2**k for k in range(41)}
    assert {r.root for r in spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()} == {"a" * 40}


def test_a_hot_word_has_many_near(spark):
    """Each replacement and insertion of one word."""
    alphabet = [chr(c) for c in (*range(97, 123), *range(0xE0, 0x100))]
    word = "center"
    counts = {word: 1000} | {word[:k] + c + word[k + 1 :]: 3 for k in range(6) for c in alphabet if c != word[k]} | {word[:k] + c + word[k:]: 4 for k in range(7) for c in alphabet}
    counts[word] = 1000
    found = as_rows(spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == group_plainly(counts)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {r.word: r.n for r in spelling.count_words(odd).collect()} == count_plainly(rows)
    assert spelling.group(spelling.count_words(none)).count() == 0
    assert spelling.group(spelling.count_words(odd.where("text IS NULL"))).count() == 0


def test_very_long_words(spark):
    long = "ab" * 30_000
    rows = spark.createDataFrame([(k, f"{long} {long}c {long[:-1]} {long[:200]}x{long[201:]} ") for k in range(1, 6)], "doc_id long, text string")
    counts = spelling.count_words(rows, noise=0)
    found = {r.word: r for r in spelling.group(counts).collect()}
    assert len(found) == 4 and found[long].n_near == 3 and all(r.n == 5 and r.form is None for r in found.values())


def test_deletions_have_the_keys_of_words():
    words = ["hello", "helo", "hllo", "hxllo", "aa", "a", "été", "éé"]
    ids, kind, k1, k2 = spelling.keys(words)
    key = {words[i]: (a, b) for i, k, a, b in zip(ids, kind, k1, k2) if k == spelling.WORD}
    gone = {(words[i], (a, b)) for i, k, a, b in zip(ids, kind, k1, k2) if k == 0}
    assert {("hello", key["helo"]), ("hello", key["hllo"]), ("hxllo", key["hllo"]), ("aa", key["a"]), ("été", key["éé"])} <= gone
    assert sum(k == 0 and words[i] == "hello" for i, k in zip(ids, kind)) == 4
