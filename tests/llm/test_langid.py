from pyspark.sql import functions as F

from velarium.llm import langid
from velarium.llm.common import crc_mod
from velarium.llm.queries import op4_langid


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def brute(train, text):
    """Languages by sets in place of filters."""
    counts = {}
    for t, lang in train:
        for g in langid.grams(t).tolist():
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    votes = {lang: sum(r.get(g, 0) > 0 and r[g] >= langid.RATIO * max(x.get(g, 0) for x in rate.values()) for g in langid.grams(text).tolist()) for lang, r in rate.items()}
    return votes


def test_filters_against_sets(spark, docs):
    rows = docs.where(crc_mod(F.col("doc_id"), 4) != 2)
    model = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    train = [(r.text, r.lang) for r in rows.collect()]
    for r in docs.where(crc_mod(F.col("doc_id"), 4) == 2).limit(20).collect():
        votes = brute(train, r.text)
        if sorted(votes.values())[-1] > sorted(votes.values())[-2] * 1.02:
            assert model.predict(r.text)[0] == max(votes, key=votes.get)


def test_odd_tables(odd, none, docs):
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5, 10)] == ["und"] * 4
    assert got[8].lang_pred in model.languages and got[9].lang_pred in model.languages and len(got) == 11
    assert model.predict("東京") == (model.languages[0], 0.0)
    assert langid.identify(none, model).collect() == []
    empty = langid.train(none, F.lit(True))
    assert empty.predict("some text") == ("und", 0.0)


def test_many_languages(spark):
    rows = [(i, f"word{chr(97 + i % 20)}{chr(97 + i % 20)} {chr(97 + i % 20) * 6}", f"l{i % 20:02}", 1) for i in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int"), F.lit(True))
    assert len(model.languages) == 20 and model.predict("ccccccc")[0] == "l02"


def test_over_sixty_three_languages(spark):
    """Languages beyond one word of the masks are learned and predicted like the others."""
    letters = lambda k: chr(97 + k // 26) * 3 + chr(97 + k % 26) * 3
    rows = [(i, f"{letters(i % 130)} {letters(i % 130)}x", f"l{i % 130:03}") for i in range(520)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 130 and model.masks.shape[0] == 3
    assert all(model.predict(letters(k))[0] == f"l{k:03}" for k in range(130))


def test_rows_without_an_id_are_drawn_apart(spark):
    rows = [(None, f"text {i} words", "en") for i in range(400)] + [(1, f"mots {i} autres", "fr") for i in range(400)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), per_language=100)
    assert sorted(model.languages) == ["en", "fr"] and model.predict("text words")[0] == "en"


def test_nothing_labelled(spark):
    """Without labels, what has a letter stays; with some, what no filter holds goes."""
    df = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_known(df, langid.train(df, F.lit(True))).collect()] == [1]
    model = langid.train(spark.createDataFrame([(1, "the words of the text", "en")], "doc_id long, text string, lang string"), F.lit(True))
    assert model.knows("words of text " * 9) and model.knows("東京") and not model.knows("東京" * 30) and not model.knows("")
