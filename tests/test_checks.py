"""Limits of snapshots against plain loops, schemas, nested redaction, pairs of large baskets."""

import json
import random
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import memory as M
from tessera.operators.tables import running

KIND = "repo string, path string, bytes long, binary boolean, text string"


def plain(files, files_most, file_bytes, total_bytes, depth):
    """Files of one repository one after another."""
    near = sorted((f for f in files if f[0].count("/") <= depth), key=lambda f: (f[0].count("/"), f[0]))[:files_most]
    out, spent = {}, 0
    for path, size, binary in sorted(near):
        truncated = size > file_bytes or spent >= total_bytes
        out[path] = (truncated, binary and not truncated, not truncated and not binary)
        if not truncated and not binary:
            spent += size
    return out


def test_limits_equal_a_plain_loop(spark):
    rng = random.Random(5)
    repos = {"big": 10_000, "small": 40, "one": 1}
    rows = {r: list({"/".join(rng.choices("abcdef", k=rng.randrange(1, 7))) + f"/f{k}": (rng.randrange(2000), rng.random() < 0.1) for k in range(n)}.items()) for r, n in repos.items()}
    df = spark.createDataFrame([(r, p, size, b, "t") for r, fs in rows.items() for p, (size, b) in fs], KIND).repartition(7)
    for limits in ({"files": 6000, "file_bytes": 1800, "total_bytes": 2_000_000, "depth": 5}, {"files": 50, "file_bytes": 10_000, "total_bytes": 1, "depth": 1}):
        got = {(x.repo, x.path): (x.truncated, x.binary, x.text is not None) for x in C.within_limits(df, limits=limits).collect()}
        want = {(r, p): v for r, fs in rows.items() for p, v in plain([(p, *s) for p, s in fs], *limits.values()).items()}
        assert got == want
    stats = {x.repo: x for x in C.snapshot_stats(df, C.within_limits(df, limits={"depth": 3})).collect()}
    assert stats["big"].partial and stats["big"].included < stats["big"].total_files == len(rows["big"])


def test_within_standing_limits_nothing_is_cut(spark):
    df = C.entries(spark.createDataFrame([("r", "./a.ts", "é"), ("r", "././b", None), ("r", ".c", "")], "repo string, path string, text string"))
    kept = C.within_limits(df)
    assert {(x.path, x.bytes, x.truncated) for x in kept.collect()} == {("a.ts", 2, False), ("b", 0, False), (".c", 0, False)}
    assert C.snapshot_stats(df, kept).first().partial is False
    assert C.within_limits(df.limit(0)).count() == 0


def test_prefix_sums_with_ties(spark):
    df = spark.createDataFrame([("k", i // 3, i) for i in range(200)], "g string, o int, v int").repartition(5)
    got = [(r.v, r.s) for r in running(df, "g", ["o", "v"], {"s": F.col("v")}).collect()]
    assert sorted(got) == [(i, i * (i - 1) // 2) for i in range(200)]


def found(spark, schema, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return {(r.field, r.message) for r in C.schema_problems(df, "k", "t", schema).collect()}


def test_schemas(spark):
    person = {"type": "object", "required": ["age", "name"], "properties": {"age": {"type": "integer"}, "name": {"type": "string"}}}
    assert found(spark, person, '{"age": "x", "name": "a"}') == {("body.age", "expected integer, received string")}
    assert found(spark, person, '{"age": 1.0}') == {("body.name", "is required")}
    assert found(spark, person, "[]") == {("body", "expected object, received array")}
    assert found(spark, person, "null") == {("body", "is required")} and found(spark, person, None) == {("body", "is required")}
    assert found(spark, person, "{broken") == {("body", "is no JSON")}
    assert found(spark, {"type": "object", "nullable": True}, "null") == set() and found(spark, {}, "3") == set()
    deep = {"type": "array", "items": {"type": "object", "properties": {"t": {"type": "array", "items": {"enum": [1, "a", True]}}}}}
    assert found(spark, deep, '[{"t": [1, "a", true, 2]}, {}, 4, {"t": ["b"]}]') == {
        ("body[0].t[3]", "must be one of: 1, a, True"), ("body[2]", "expected object, received number"), ("body[3].t[0]", "must be one of: 1, a, True")
    }
    number = {"type": ["number", "null"], "minimum": 1, "maximum": 2}
    assert found(spark, number, "3") == {("body", "must be <= 2")} and found(spark, number, "0.5") == {("body", "must be >= 1")} and found(spark, number, "null") == set()
    assert found(spark, {"type": "boolean"}, "true") == set() and found(spark, {"type": "integer"}, "1.5") == {("body", "expected integer, received number")}


def test_redaction_walks_types(spark):
    inner = "struct<name: string, api_key: string>"
    deep = "struct<a: struct<b: struct<c: struct<d: struct<e: struct<f: struct<g: string>>>>>>>"
    row = ("s", {"id": 1, "cookies": None, "list": [{"name": "n", "api_key": "k"}, None], "m": {"token": "t", "x": "y"}}, json.loads('{"a":{"b":{"c":{"d":{"e":{"f":{"g":"x"}}}}}}}'), None)
    df = spark.createDataFrame([row], f"session string, v struct<id: int, cookies: array<string>, list: array<{inner}>, m: map<string,string>>, w {deep}, n {inner}")
    got = C.redacted_rows(df).first()
    assert got.session == got.v.cookies == C.COVER and got.v.id == 1 and got.n is None
    assert got.v.list[0].name == "n" and got.v.list[0].api_key == C.COVER and got.v.list[1] is None and got.v.m == {"token": C.COVER, "x": "y"}
    assert got.w.a.b.c.d.e.f == C.DEEP


def test_pairs_of_a_large_basket(spark):
    names = {1: [f"n{k}" for k in range(300)], 2: ["a", "b"], 3: ["x"], 4: ["b", "a", "a", None]}
    df = spark.createDataFrame([(k, n) for k, ns in names.items() for n in ns], "k int, n string")
    want = sorted((a, b, k) for k, ns in names.items() for a, b in combinations(sorted({n for n in ns if n}), 2))
    for block in (16, 256, 1000):
        assert sorted((r.a, r.b, r.k) for r in M.basket_pairs(df, "k", "n", block).collect()) == want
    assert {(r.a, r.b): r.weight for r in M.co_occurrence(df, "k", "n").collect()}["a", "b"] == 2
