"""Nearest vectors against all pairs, over many blocks, ties and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory

KIND = "id long, v array<double>, g string"


def all_pairs(rows, asked, top, least):
    unit = {i: [x / max(math.hypot(*v), 1e-300) for x in v] for i, v, _ in rows}
    out = set()
    for i, v, g in asked:
        near = [(-round(sum(x * y for x, y in zip(unit[i], unit[j])), 6), j) for j, w, h in rows if j != i and h == g and len(w) == len(v)]
        out |= {(i, j, -s, k) for k, (s, j) in enumerate(sorted(n for n in near if -n[0] >= least)[:top], 1)}
    return out


@pytest.mark.parametrize("block", [7, 100, 32768])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "FEW_QUERIES", 20)
    rng = random.Random(block)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    rows = [(i, rng.choice(some) if i % 2 else [rng.gauss(0, 1) for _ in range(4)], rng.choice("aaab")) for i in range(700)]
    rows += [(1000 + i, [rng.random() for _ in range(3)], "a") for i in range(9)]
    odd = [(2000, None, "a"), (2001, [1.0, None, 0.0, 0.0], "a"), (2002, [math.nan] * 4, "a"), (2003, [math.inf, 0.0, 0.0, 0.0], "b"), (2004, some[0], None), (None, some[0], "a")]
    df = spark.createDataFrame(rows + odd, KIND)
    got = memory.nearest(df, df.where("id % 3 = 0"), top=3, group="g", least=0.2, block=block)
    assert {(r["query_id"], r["id"], round(r["similarity"], 6), r["rank"]) for r in got.collect()} == all_pairs(rows, [r for r in rows if r[0] % 3 == 0], 3, 0.2)


def test_similarities_that_differ_beyond_six_digits_tie_by_id(spark):
    rows = [(0, [1.0, 0.0], "a"), *((i, [1.0, 0.5 - i * 1e-9], "a") for i in range(1, 10))]
    df = spark.createDataFrame(rows, KIND)
    got = memory.nearest(df, df.where("id = 0"), top=3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3]


def test_many_small_groups_are_a_block_each(spark):
    rows = spark.range(30_000).select(F.col("id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("v"), (F.col("id") % 10).cast("string").alias("g"), F.lit(2).alias("dim"))
    assert memory._several_blocks(rows, rows, 32768).count() == 0
    assert [r[:] for r in memory._several_blocks(rows.withColumn("g", F.lit("")), rows.withColumn("g", F.lit("")), 32768).collect()] == [("", 2, 1, 4)]
