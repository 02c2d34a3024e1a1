"""A corpus from raw documents to packed windows, one written stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet under the shared folder and reads it back for the next. All stages
but the last return the columns of documents, whatever else these are named.

Null and empty texts are never toxic, have no language and so go at the second
stage; rows with a null doc_id keep their text and are never duplicates. Repeated
rows are judged each on its own until the fourth stage, where one doc_id is one
document: rows that repeat it stay or go together. Ties fall to the least doc_id.
An empty table passes through all stages and gives no rows; without labels
nothing is toxic, and without languages every text with letters stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, near_dup, packing, toxicity
from tessera.llm.common import materialise, quoted, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, under a model fitted on the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are not far from every learned language."""
    model = language.fit(docs, F.lit(True))
    return language.keep_identified(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows the text."""
    cleaned = line_dedup.remove_passages(docs)
    count = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", count).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return near_dup.keep_one(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_windows),
]

#: Learned models and tokenization have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
