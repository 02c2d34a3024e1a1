"""Every operator and stage on documents with extra columns whose names have dots, backticks or clash with inner ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, media, merkle, near_dup, packing, passages, pieces, sharding


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    extra = {"a.b": F.col("doc_id") * 2, "c0": F.lit("x"), "n0": F.lit(1), "q`x.": F.array(F.lit(1)), "digest": F.lit("d"), "h": F.lit(3)}
    return rows.select("*", *[c.alias(n) for n, c in extra.items()]).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf)
    if name != "packing":
        assert got.columns == docs.columns
        assert got.where("`a.b` <> doc_id * 2 or c0 <> 'x' or n0 <> 1 or h <> 3").count() == 0
    assert got.count() > 0


@pytest.mark.parametrize("operator", [line_dedup.remove_repeats, line_dedup.remove_passages, near_dup.near_duplicates, near_dup.keep_one, packing.pack, passages.remove_passages_between, merkle.manifest, sharding.place, pieces.encode_documents, media.to_media])
def test_operator(docs, operator):
    assert operator(docs).count() > 0
