"""Language ID, toxicity and quality: awkward rows, and accuracy on rows that were not learned from."""

import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality, toxicity
from tallyspark.llm.queries import QUERIES, fold, held_out

SMALL = "/root/testdata/sf0.01"


def test_language_of_awkward_rows(spark):
    df = documents(spark, extra=True)
    got = language_id.identify(df, fold(4) != 2)
    assert got.select("row.*").columns == df.columns
    rows = got.select("row.doc_id", "row.text", "lang_pred", "lang_score").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] in (("en", "fr") if lettered else ("und",))
        assert 0 <= r["lang_score"] <= 1 and (lettered or r["lang_score"] == 0)
    assert language_id.identify(documents(spark, []), F.lit(True)).collect() == []
    nothing = language_id.identify(df, F.lit(False)).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_codewords_differ():
    for n in (2, 3, 4, 7, 12):
        words = language_id.codewords(n)
        assert len(words) == n and min((a != b).sum() for i, a in enumerate(words) for b in words[:i]) >= max(1, words.shape[1] // 4)


def test_held_out_language(spark):
    got = QUERIES["op6_language_id"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


TRIGRAM_TEXT = "the idiot and the clown were stupid but the moron was pathetic scum and trash is disgusting loser worthless " * 20


@pytest.mark.parametrize("seen, plain", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("tra$h", "trash"), ("p@thetic", "pathetic"), ("$tupid", "stupid"), ("cl0wn,", "clown"), ("LOSER!!", "loser")])
def test_restores_disguised_words(spark, seen, plain):
    df = spark.createDataFrame([(TRIGRAM_TEXT,)], "text string")
    if not hasattr(test_restores_disguised_words, "model"):
        test_restores_disguised_words.model = toxicity.Trigrams(toxicity.character_counts(df))
    assert plain in toxicity.Words(test_restores_disguised_words.model).of(f"you {seen} there")


EDGES = [("!diot", "idiot"), ("|diot", "idiot"), ("(lown", "clown"), ("<lown", "clown"), ("+rash", "trash"), ("$$tupid", "stupid"), ('"$tupid', "stupid"), ("($cum)", "scum"), ("idio+", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("455", "ass")]
SPELT = [("a m o r o n", "moron"), ("m o r o n u", "moron"), ('"m o r o n"', "moron"), ("a s s", "ass"), ("m   o   r   o   n", "moron"), ("i d i o t  m o r o n", "moron"), ("i d i o t   m o r o n", "idiot")]


@pytest.mark.parametrize("seen, plain", EDGES + SPELT)
def test_restores_signs_at_edges_and_spelt_words(spark, seen, plain):
    df = spark.createDataFrame([(TRIGRAM_TEXT + "an ass " * 20,)], "text string")
    got = test_restores_signs_at_edges_and_spelt_words
    if not hasattr(got, "model"):
        got.model = toxicity.Trigrams(toxicity.character_counts(df))
    assert plain in toxicity.Words(got.model).of(f"you are {seen} there")


def test_plain_words_stay(spark):
    model = toxicity.Trigrams(toxicity.character_counts(documents(spark)))
    assert {"hello", "naïve", "été"} <= toxicity.Words(model).of("Hello, naïve --- (ÉTÉ) 123 $$$ !!")


def toxic_rows():
    rows = [(i, f"some quiet words number{i} about rivers and hills and trees", "en", "s", 0) for i in range(60)]
    return rows + [(100 + i, f"some words number{i} you 1diot and m0ron about hills", "en", "s", 0) for i in range(20)] + [(200 + i, f"text {i} an idiot a moron", "en", "s", 0) for i in range(20)]


def test_toxicity_learns_restored_words(spark):
    docs = documents(spark, toxic_rows())
    model = toxicity.learn(docs, docs.withColumn("toxic", (F.col("doc_id") >= 200).cast("int")).filter("doc_id < 60 or doc_id >= 200").select("doc_id", "text", "toxic"))
    assert {"idiot", "moron"} <= set(model.weights)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == (i >= 100) for i in found)
    odd = toxicity.score(documents(spark, extra=True), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(documents(spark, []), model).collect() == []
    unlabelled = toxicity.learn(docs, docs.withColumn("toxic", F.lit(0)).limit(0).select("doc_id", "text", "toxic"))
    assert {r["score"] for r in toxicity.score(docs, unlabelled).collect()} == {0.5}


def test_rare_toxic_words_count_on_large_data(spark):
    """A word in eight of 1,500 toxic texts and in no clean one is evidence, as it is among fewer texts."""
    rows = [(f"quiet words number{i} about rivers and hills", 0) for i in range(9000)] + [(f"an idiot says number{i}" + (" grobian" if i < 8 else ""), 1) for i in range(1500)]
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    assert {"idiot", "grobian"} <= set(toxicity.learn(labelled, labelled).weights)


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, SMALL).join(labels, "doc_id").toPandas()
    got = got[got.held_out]
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() == 0 and (got.predicted == got.toxic).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_awkward_rows(spark):
    df = documents(spark, extra=True)
    x = quality.measured(df)
    rows = x.withColumn("label", (F.col("doc_id") % 2).cast("int")).withColumn("fitted", F.col("doc_id") % 3 > 0).filter("doc_id is not null").select("x", "label", "fitted")
    got = quality.score(x, quality.learn(rows)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(quality.measured(documents(spark, [])), quality.learn(rows)).collect() == []
    assert {r["score"] for r in quality.score(x, quality.learn(rows.limit(0))).collect()} == {0.5}


def test_isotonic_is_monotone():
    x, y = quality.isotonic(*(quality.np.array(v, float) for v in ([1, 2, 3, 4, 5], [0, 1, 0, 1, 1], [1, 1, 1, 1, 2])))
    assert (quality.np.diff(y) > 0).all() and x[0] == 1


def test_held_out_quality(spark):
    got = QUERIES["op9_quality_classifier"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").toPandas()
    got = got[got.held_out]
    assert (got.predicted == got.quality).mean() > 0.93


def test_folds(spark):
    rows = documents(spark, [(7, "x", None, None, 0), (None, "y", None, None, 0)]).select(held_out(4, fold_of(7, 4)).alias("h")).collect()
    assert [r["h"] for r in rows] == [True, False]


def fold_of(doc_id, n):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % n
