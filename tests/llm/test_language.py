import tracemalloc

import numpy as np

from tessera.llm.language import BUCKETS, UNKNOWN, LanguageModel, codewords, fit, held_out, identify, keep_identified, op2_language
from pyspark.sql import functions as F


def test_codewords_are_apart():
    for k in (2, 3, 5, 7, 20):
        c = codewords(k)
        assert c.shape[0] == k and len({tuple(r) for r in c}) == k
        apart = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else c.shape[1] // 4)


def test_one_wrong_bit_is_corrected():
    code = codewords(5)
    for row in range(5):
        margin = 3 * code[row].copy()
        margin[2] *= -1
        m = LanguageModel(list("abcde"), code, np.eye(len(margin), dtype=np.float32), np.zeros(len(margin)), np.ones(len(margin)))
        assert m.predict(margin[None, :].astype(np.float32))[0][0] == row


def test_held_out_accuracy(spark, sf):
    got = op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert held.score.between(0, 1).all()


def test_edge_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, ~held_out())
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "the and of", "x"), (4, "the and of", "x"), (None, "der die das " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = identify(df, model, keep=("doc_id", "lang_pred")).collect()
    assert [r["lang_pred"] for r in got[:3]] == [UNKNOWN] * 3 and got[0]["score"] == 0
    assert got[3] == got[4] and got[5]["lang_pred"] == "de"
    assert keep_identified(df, model).columns == df.columns
    assert keep_identified(df, model).count() == 3
    assert identify(df.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert fit(df, F.lit(True)).langs == []
    assert identify(df, fit(df, F.lit(True))).first()["lang_pred"] == UNKNOWN
    more = df.union(spark.createDataFrame([(2, "12", None)], df.schema))
    assert [r["doc_id"] for r in keep_identified(more, fit(df, F.lit(True))).collect()] == [1]


def test_mixed_texts_are_ambiguous_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, ~held_out())
    one = {lang: docs.where(F.col("lang") == lang).orderBy("doc_id").first()["text"] for lang in ("de", "en", "fr")}
    # Shares of both languages at which the two codewords are about equally near.
    half = [(i, one["de"][: 40 * i] + " " + one["fr"][: 40 * (20 - i)]) for i in range(21)]
    got = identify(spark.createDataFrame(half, "doc_id long, text string"), model).collect()
    assert any(r["ambiguous"] for r in got)
    assert identify(docs, model).where("ambiguous").count() <= 0.05 * docs.count()
    assert keep_identified(docs, model).count() == docs.count()


def test_fit_holds_one_matrix_on_the_driver(spark, sf):
    """Rows of features reach the driver small, and there is one dense copy of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null")
    docs = docs.crossJoin(spark.range(6)).select("doc_id", F.concat("text", F.lit(" x"), "id").alias("text"), "lang")
    rows = docs.select("lang", "text").distinct().count()
    tracemalloc.start()
    model = fit(docs, F.lit(True), per_language=10**6, most_texts=10**7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.langs) > 1
    assert peak < 1.9 * rows * 2 * BUCKETS * 4
