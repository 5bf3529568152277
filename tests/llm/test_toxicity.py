import re

import numpy as np
from pyspark.sql import functions as F

from velarium.llm import toxicity as T
from velarium.llm.queries import op2_toxicity

ENTRIES = [T.Entry("idiot", False, 5.0), T.Entry("scum", False, 5.0), T.Entry("disgusting", False, 4.0), T.Entry("réeux", True, 3.0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = np.random.default_rng(0)
    words = ["idiot", "scum", "disgusting", "réeuxpa", "réeux", "RÉEUXÉ", "scums", "Idiots"]
    for w in list(words) * 60:
        w, k = list(w), int(rng.integers(0, 3))
        for _ in range(k):
            p = int(rng.integers(0, len(w)))
            w[p : p + int(rng.integers(0, 2))] = [str(rng.choice(list("idotscumgné1z")))] * int(rng.integers(0, 2))
        words.append("".join(w) or "x")
    automaton, text = T.Automaton(ENTRIES), " ".join(words)
    got = {(a, b): (k, e) for a, b, k, e in zip(*(x.tolist() for x in automaton.scan(text)), strict=True)}
    at = 0
    for w in words:
        low, best = w.lower(), None
        for k, entry in enumerate(ENTRIES):
            d = (0 if low.startswith(entry.text) and len(low) > len(entry.text) - 1 else 99) if entry.stem else distance(low, entry.text)
            if d <= (0 if entry.stem or len(entry.text) < T.FUZZY_LENGTH else 1) and (best is None or d < best[1]):
                best = (k, d)
        assert got.get((at, at + len(w))) == best, w
        at += len(w) + 1


def test_context():
    assert T.quoted('they wrote "you idiot" here', 17, 22) and not T.quoted("you idiot here", 4, 9)
    assert T.quoted("the word idiot is rude", 9, 14) and T.quoted("«quel idiot»", 6, 11)
    assert T.addressed("you are an idiot", 11, 16) and not T.addressed("an idiot", 3, 8)


def test_misspelled_and_quoted(spark):
    rng = np.random.default_rng(0)
    other = lambda: " ".join("".join(rng.choice(list("aeioubcdfg"), 4)) for _ in range(12))
    toxic = [(i, f"{'you' if i % 2 else 'what'} idiot number {other()}", 1) for i in range(60)]
    clean = [(100 + i, f"a plain text number {other()}", 0) for i in range(120)]
    clean += [(300 + i, f'they called it the word "idiot" {other()}', 0) for i in range(10)]
    # Copies of one toxic text teach no more than one of them.
    toxic += [(400 + i, f"you idiot, copied verbiage {'x' * (i % 2)}", 1) for i in range(40)]
    df = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    model = T.train(df, df, F.lit(True))
    scores = model.scores(["what an idiot", "what an idiiot", "what an id1ot", 'the word "idiot" is rude', "a plain text", ""])
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.5).all()
    assert {e.text for e in model.automaton.entries} == {"idiot", "you", "what"}


def test_scripts_and_many_letters():
    """Letters of any script, and more of them than a byte can number."""
    entries = [T.Entry("バカ野郎だ", False, 5.0), T.Entry("𝒜𝒷𝒸", False, 5.0), *(T.Entry("".join(chr(0x4E00 + 5 * k + j) for j in range(5)), False, 4.0) for k in range(60))]
    automaton = T.Automaton(entries)
    text = "バカ野郎だ、 バカ野だ 𝒜𝒷𝒸 " + entries[61].text + " 漢字"
    assert [(k, e) for _, _, k, e in zip(*(x.tolist() for x in automaton.scan(text)), strict=True)] == [(0, 0), (0, 1), (1, 0), (61, 0)]


def test_scores_against_brute_force(spark, docs, sf):
    """Features and scores by plain loops over words, edit distances and windows."""
    model = T.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    entries = [T.Entry("loser", False, 5.0), T.Entry("scum", False, 4.0), T.Entry("moro", True, 3.0)]
    model = T.Model(T.Automaton(entries), frozenset({"closer"}), np.array([2.0, -1.0, 0.5, 1.0, -3.0]))
    extra = ["You loser, moronic!", 'the word "loser" is', "a closer look", "loseer SCUM scums", "", "\u201clozer\u201d said you moron"]

    def features(text):
        found, x = list(re.finditer(r"[^\W_]+", text)), [0.0, 0.0, 0.0, 0.0]
        for m in found:
            low = m[0].lower()
            fits = [(0, -e.weight, k) for k, e in enumerate(entries) if (low.startswith(e.text) if e.stem else low == e.text)]
            fits += [(1, -e.weight, k) for k, e in enumerate(entries) if not e.stem and len(e.text) >= T.FUZZY_LENGTH and distance(low, e.text) == 1]
            if not fits or (min(fits)[0] and low in model.harmless):
                continue
            weight = entries[min(fits)[2]].weight * (T.DAMP if min(fits)[0] else 1)
            if T.quoted(text, m.start(), m.end()):
                x[1] += weight
            else:
                x = [x[0] + weight, x[1], x[2] + weight * T.addressed(text, m.start(), m.end()), 1.0]
        return [*np.log1p(x[:3]), x[3]]

    texts = extra + [r.text or "" for r in docs.limit(40).collect()]
    want = np.array([features(t) for t in texts])
    assert np.allclose(model.features(texts), want) and want[:, 0].any() and want[:, 1].any()
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(want @ model.weights[:-1] + model.weights[-1]))))


def test_rows_that_share_an_id_stay_in_bounds(spark):
    df = spark.createDataFrame([(i % 4, f"text {i} {'idiot' if i % 2 else 'fine'} w{i} v{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    model = T.train(df, labels, F.lit(True), per_class=50)
    assert model.scores(["idiot", "fine"])[0] > 0.5


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    ranks = np.argsort(np.argsort(p + 1e-9 * np.arange(len(p)))) + 1
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and ((p >= 0.5) == y).mean() > 0.96


def test_odd_tables(spark, odd, none, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.train(docs, labels, F.lit(True))
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert T.score(none, model).collect() == []
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        flat = T.train(docs, some, F.lit(True))
        assert max(r.score for r in T.score(odd, flat).collect()) < 1e-6


def test_misspelled_words_under_a_stem():
    """Where a stem tells more than its words, these stay for their misspellings."""
    counts = [("idiot", False, 200, 1), ("idiots", False, 190, 1), ("idiotic", False, 180, 1), ("idio", True, 570, 3), ("idi", True, 560, 60)]
    entries = T.choose_lexicon(counts, 1000, 5000)
    assert [e.text for e in entries if e.stem] == ["idio"] and {e.text for e in entries if not e.stem} == {"idiot", "idiots", "idiotic"}
    hits = T.Automaton(entries).scan("idxot idiotic idiocy idolic")
    assert [(a, e) for a, _, _, e in zip(*(x.tolist() for x in hits), strict=True)] == [(0, 1), (6, 0), (14, 0)]
