"""Queries over whole texts against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.search_queries import entropy_by_doc, text_facts
from tessera.sources.tables import read

_PLAIN = str.maketrans("àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def bits(t):
    return -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) if t else 0.0


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in read(spark, sf, "documents", "doc_id", "text").collect()}


def test_entropy_of_odd_texts(spark):
    odd = ["", "a", "aAbB", "𝔘ä𝔘 €\n", "x" * 5000 + "y", ".*$1\\E"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", X.entropy(F.col("t")).alias("bits")).collect()
    assert all(r["bits"] == pytest.approx(bits(r["t"]), abs=1e-9) for r in got)


def test_entropy_is_of_the_whole_text(spark, sf):
    docs = texts(spark, sf)
    got = {r["doc_id"]: r["bits"] for r in entropy_by_doc(spark, sf).collect()}
    assert {i: got[i] for i in docs if docs[i]} == pytest.approx({i: bits(t) for i, t in docs.items() if t}, abs=2e-6)
    assert max(map(len, docs.values())) > 200


def test_slug_and_ngrams_are_of_the_whole_text(spark, sf):
    docs = texts(spark, sf)
    for r in text_facts(spark, sf).select("doc_id", "slug", "ngrams").collect():
        t = docs[r["doc_id"]]
        slug = re.sub(r"^-+|-+$", "", re.sub("[^a-z0-9]+", "-", t.lower().translate(_PLAIN)))
        assert r["slug"] == (slug or "untitled")
        assert r["ngrams"] == max(len(t.lower().strip(" ")), 1)
