import random

import pytest

from velarium.llm import decontaminate as D

ITEMS = "item_id long, text string, doc_id long"


def distances(pattern, text):
    """The least distance of pattern to parts of text that end at each place, by dynamic programming."""
    column = list(range(len(pattern) + 1))
    out = []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(column[i] + (p != c), column[i + 1] + 1, new[i] + 1))
        column = new
        out.append(column[-1])
    return out


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(k, "q"), lambda: chars.insert(k, "z"), lambda: chars.pop(k)])()
    return "".join(chars)


@pytest.mark.parametrize("seed", range(20))
def test_myers(seed):
    rng = random.Random(seed)
    pattern, text = "".join(rng.choices("abc", k=rng.randint(1, 90))), "".join(rng.choices("abc", k=rng.randint(1, 200)))
    best, end = D.myers(pattern, text)
    want = distances(pattern, text)
    assert best == min([*want, len(pattern)]) and (end == 0 or want[end - 1] == best)


def test_every_passage_within_the_budget(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnop     "
    items = [(i, "".join(rng.choices(letters, k=rng.randint(60, 250))) + "x") for i in range(6)]
    docs, want = [], set()
    for d in range(40):
        i = rng.randrange(6)
        form = D.normal(items[i][1])
        budget = len(form) // D.PER_EDIT
        docs.append((d, "".join(rng.choices(letters, k=100)) + ". " + edited(rng, form, rng.randint(0, 2 * budget)).upper() + "\n" + "".join(rng.choices(letters, k=100))))
        for k, text in items:
            form = D.normal(text)
            if min(distances(form, D.normal(docs[-1][1]))) <= len(form) // D.PER_EDIT:
                want.add((d, k))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    for size in (D.BLOCK, 1000):
        got = D.find_passages(df, bench, block=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = {r.doc_id for r in D.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_odd_tables(spark, odd, none):
    long = "this passage is long enough to be an item of its own"
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one", 1), (4, long, 1), (4, long, 1), (5, "İstanbul " + long, 1)], ITEMS)
    docs = odd.unionByName(spark.createDataFrame([(20, f"x {long} y {long}", None, None, 0, 1, "x"), (21, f"İİ İSTANBUL, {long.upper()}!", "en", "s", 0, 1, "x")], odd.schema))
    got = sorted((r.doc_id, r.item_id, r.start, r.end) for r in D.find_passages(docs, bench).collect())
    n = len(long)
    assert got == [(6, 3, 0, 3), *[(20, 4, a, a + n) for a in (2, 2, n + 5, n + 5)], (21, 4, 13, 13 + n), (21, 4, 13, 13 + n), (21, 5, 3, 13 + n)]
    assert sorted(r.doc_id or 0 for r in D.clean(docs, bench).collect()) == [0, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10]
    assert D.clean(docs, bench).schema == docs.schema and D.clean(docs, bench.limit(0)).count() == docs.count()
    assert D.find_passages(none, bench).collect() == [] and D.find_passages(docs, bench.limit(0)).collect() == []


def test_punctuation_of_any_script(spark):
    """Typographic quotes and dashes are between words, as straight ones are; places count them."""
    item = "it's said \"so\" - a passage that is long enough, isn't it? yes"
    curly = "\u201cwell\u201d\u2014It\u2019s said \u201cso\u201d \u2014 a passage that is long enough, isn\u2019t it\u2026 yes!"
    docs = spark.createDataFrame([(1, curly), (2, "東京。「日本」"), (3, None)], "doc_id long, text string")
    got = D.find_passages(docs, spark.createDataFrame([(1, item, 1)], ITEMS)).collect()
    assert [(r.doc_id, r.start, r.end, r.distance) for r in got] == [(1, 7, len(curly) - 1, 0)]
    assert D.normal("東京。「日本」_x") == "東京 日本 x"


def test_each_of_many_passages_once(spark):
    """A text that holds an item often, and hits from its pieces in any order."""
    item = "one passage of the benchmark here which is long enough to be one"
    text = " ".join([item] * 12)
    got = D.find_passages(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item, 1)], ITEMS)).collect()
    assert sorted(r.start for r in got) == [k * (len(item) + 1) for k in range(12)]
