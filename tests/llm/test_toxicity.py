import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from tessera.llm.toxicity import END, Automaton, ToxicityModel, edits_allowed, features, fit, held_out, keep_clean, op8_toxicity, score

TERMS = ["idiot$", "worthless$", "scum$", "lowei", "ab$"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def verdict(word):
    if any(not t.endswith(END) and word.startswith(t) for t in TERMS):
        return 3
    best = [distance(word, t[:-1]) for t in TERMS if t.endswith(END) and distance(word, t[:-1]) <= edits_allowed(t)]
    return 0 if not best else 1 if min(best) == 0 else 2


AUTOMATON = Automaton.build(TERMS)


def match(word):
    _, _, v = AUTOMATON.match(np.frombuffer(word.encode("utf-32-le"), np.uint32))
    return v.tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("idotworthlesscumxab", min_size=1, max_size=11), st.sampled_from(["idiot", "worthless", "lowei"]).flatmap(lambda w: st.tuples(st.just(w), st.integers(0, len(w)), st.sampled_from("xid"))).map(lambda t: t[0][: t[1]] + t[2] + t[0][t[1] :])))
def test_automaton_is_the_edit_distance(word):
    assert match(word) == [verdict(word)]


def test_known_words():
    for word, want in (("idiot", 1), ("idiott", 2), ("idot", 2), ("wurthles", 2), ("scun", 0), ("loweichen", 3), ("ídiot", 2)):
        assert match(word) == [want], word


def test_quotation_is_not_abuse():
    x = features(pa.array(['he said "you idiot" and left', "you idiot and scum", None, ""]), AUTOMATON)
    assert x[0, 0] == 0 and x[0, 3] > 0
    assert x[1, 0] > x[0, 0] and x[1, 3] == 0 and x[1, 4] > 0
    assert not x[2].any() and not x[3].any()


def test_held_out_accuracy_and_edges(spark, sf):
    got = op8_toxicity(spark, sf)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert got.count() == docs.count()
    pdf = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (pdf.predicted == pdf.toxic).mean() > 0.8
    model = fit(docs, labels, ~held_out())
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "", "c"), (None, "x" * 300_000, "c")], "doc_id long, text string, score string")
    rows = score(df, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] < 0.5 for r in rows)
    assert keep_clean(df, model).columns == df.columns and keep_clean(df, model).count() == 4
    assert score(df.limit(0), model).count() == 0


def test_learns_planted_words(spark):
    rows = [(i, f"w{i} fine words here " + ("nastyterm " if i % 3 == 0 else "") + f"q{i * 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = fit(docs, labels, held_out().isNotNull())
    assert any(t.startswith("nasty") for t in model.terms)
    test = spark.createDataFrame([(1, "some nastiterm there"), (2, "some fine words")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in score(test, model).collect()}[2] == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), held_out().isNotNull())
    assert isinstance(model, ToxicityModel) and score(docs, model).first()["predicted"] == 0
