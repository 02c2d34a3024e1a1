"""Version ranges, stacks and windows on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import graph as G
from tessera.operators import ranges as V
from tessera.operators import tables as T

CASES = [
    ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("2.0.0-rc.1", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False),
    ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.4.9", "1.x", True), ("2.0.0", "1.x", False), ("1.2.3", "=1.2.3", True), ("1.2.4", "1.2.3", False),
    ("1.5.0", "1.2.0 - 1.5.0", True), ("1.5.1", "1.2.0 - 1.5.0", False), ("3.1.0", "<1.0.0 || >= 3.0.0", True), ("2.0.0", "<1.0.0 || >= 3.0.0", False), ("9.9.9", "*", True),
    ("1.0.0-alpha", ">=1.0.0", False), ("1.0.0", ">1.0.0-alpha", True), (None, "*", False), ("1.0.0", None, False), ("", "*", False), ("1.0.0", "", True),
]


def test_ranges(spark):
    rows = spark.createDataFrame(CASES, "v string, r string, want boolean")
    got = rows.withColumn("got", V.satisfies(F.col("v"), F.col("r"))).where("got <> want").collect()
    assert got == []


def test_windows_begin_with_the_first_event_after_the_last(spark):
    rows = [(1, 0), (1, 5), (1, 10), (1, 11), (1, 500), (2, 3), (2, 3), (None, 1), (3, None)]
    df = spark.createDataFrame(rows, "k long, t long").select("k", F.timestamp_seconds("t").alias("t"))
    got = T.sessions_from_first(df, "k", "t", 10).select("k", F.unix_seconds(F.col("start").cast("timestamp")).alias("s"), "n")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2), (1, 10, 2), (1, 500, 1), (2, 3, 2)]
    assert T.sessions_from_first(df.limit(0), "k", "t", 10).count() == 0


def test_components_of_a_graph_with_tails(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 8)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(map(tuple, G.cycles(df).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert G.cycles(df.limit(0)).count() == 0


def test_tenant_must_be_named(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "workspace_id string, x int")
    assert [r["x"] for r in T.of_tenant(df, "a").collect()] == [1]
    with pytest.raises(ValueError):
        T.of_tenant(df, None)


def test_code_patterns_begin_on_the_line_reported(spark):
    rows = [("a.py", "python", 1, "ok"), ("a.py", "python", 2, "eval(x)"), ("a.py", "python", 3, None), ("tests/b.py", "python", 1, "eval(x)"), ("c.md", "markdown", 1, "eval(x)")]
    df = spark.createDataFrame(rows, "path string, language string, line_no int, line string")
    assert [(r["path"], r["rule"], r["line_no"]) for r in A.code_patterns(df).collect()] == [("a.py", "python-exec", 2)]


def test_prereleases_order_part_by_part(spark):
    rising = ["0.9.9", "1.0.0-1", "1.0.0-9", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.9", "1.0.0-alpha.10", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-0", "1.0.1"]
    df = spark.createDataFrame([(v,) for v in rising], "v string")
    assert [r.v for r in df.orderBy(V.version_key(df.v)).collect()] == rising
    pairs = [("1.0.0-alpha.10", ">1.0.0-alpha.9", True), ("1.0.0-alpha.9", ">1.0.0-alpha.10", False), ("1.0.0-2", "<1.0.0-10", True), ("1.0.0-rc.1", ">=1.0.0-beta.11 <1.0.0", True)]
    got = spark.createDataFrame(pairs, "v string, r string, want boolean").select("want", F.exists(V.intervals(F.col("r")), lambda i: (i.lo <= V.version_key(F.col("v"))) & (V.version_key(F.col("v")) < i.hi)).alias("got"))
    assert all(r.want == r.got for r in got.collect())
