import corpus_pipeline as P
from tessera.llm.common import materialise, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "language_id", "line_dedup", "near_dedup", "packing"]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf))
        assert out.columns == columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - ids
        if name == "toxicity":
            assert sum(labels.get(i, 1) == 0 for i in gone) <= 2
            assert sum(labels.get(i, 0) == 1 for i in gone) >= 1
        if name in ("language_id", "line_dedup"):
            assert not gone
        docs = out
    assert 0 < docs.count() < before
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.count()


def test_null_and_empty_rows_pass_through(spark, sf):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", None), (None, "the of and to a in is it", "en", "s", 3), (3, "the of and to a in is it", "en", "s", 3)]
    docs = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for _, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf))
    assert {r["doc_id"] for r in docs.collect()} == {None, 3}
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
