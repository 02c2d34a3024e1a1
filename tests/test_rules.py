"""Rules, templates, hashed vectors and ordered groups on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import rules


def test_file_and_function_rules(spark):
    files = spark.createDataFrame([("a", 100, 40, 6, False), ("b", 1300, 2, 1, False), ("t", 1300, 900, 9, True)], "path string, code int, complexity int, nesting int, is_test boolean")
    got = {(r["path"], r["rule"], r["severity"]) for r in rules.file_rules(files).collect()}
    assert got == {("a", "branch-density", "critical"), ("a", "nesting", "medium"), ("b", "oversize", "high")}
    functions = spark.createDataFrame([("a", "f", 41, 10, 7), ("b", "g", 21, 121, 1)], "path string, name string, complexity int, lines int, parameters int")
    found = rules.function_rules(functions)
    assert {(r["name"], r["rule"], r["severity"]) for r in found.collect()} == {
        ("f", "function-complexity", "critical"), ("f", "parameters", "low"), ("g", "function-complexity", "medium"), ("g", "function-length", "medium")
    }
    assert {(r["path"], r["rule"]) for r in rules.unless_function_found(rules.file_rules(files), found).collect()} == set()


def test_untested_and_undocumented(spark):
    files = spark.createDataFrame([("src/a.py", 20, 80, 0), ("src/b.py", 20, 130, 9)], "path string, complexity int, code int, comment int")
    tests = spark.createDataFrame([("tests/src/test_b.py",)], "path string")
    assert [r["path"] for r in rules.untested(files, tests).collect()] == ["src/a.py"]
    assert rules.undocumented(files).count() == 0


def test_coupling(spark):
    nodes = spark.createDataFrame([("x", 26, 41), ("y", 1, 1)], "node string, fan_in int, fan_out int")
    assert {(r["rule"], r["severity"]) for r in rules.coupling_rules(nodes).collect()} == {("fan-out", "high"), ("fan-in", "low")}


def test_templates(spark):
    df = spark.createDataFrame([("Hi {{a}} and {{b}} {{a}}", {"a": "x"})], "t string, v map<string,string>")
    r = df.select(rules.render(F.col("t"), F.col("v")).alias("o"), rules.template_variables(F.col("t")).alias("n")).first()
    assert (r["o"], r["n"]) == ("Hi x and {{b}} x", ["a", "b"])


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "parse the repository"), (2, "parse the repository"), (3, "unrelated words entirely")], "doc_id long, text string")
    v = {r["doc_id"]: r["v"] for r in rules.hashed_vectors(df, size=64).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert dot(1, 2) == pytest.approx(1) and dot(1, 3) < 0.6 and math.isclose(dot(3, 3), 1)


def odd_texts(rng):
    words = ["parseHTTPRequest", "the", "snake_case_name", "$x", "_a_", "ABCdEFg", "Ünï", "İst", "ΣΑΣ", "😀", "x1Y", "a", "\t", "  ", "9", "--", "日本語", "fooBar", "FOO", "foo"]
    return ["", " ", "a", " Z ", "ab", *("".join(rng.choice([*words, " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(40))]


def test_hashed_features_are_those_of_tokens_and_trigrams(spark, monkeypatch):
    monkeypatch.setattr(rules, "SLICE_ROWS", 7)
    texts = odd_texts(random.Random(7))
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    said = df.select("id", text.tokens(F.col("text")).alias("words"), text.ngrams(F.col("text")).alias("grams")).where("words is not null")
    hashes = {r["f"]: r["h"] for r in said.select(F.explode(F.concat("words", "grams")).alias("f")).distinct().select("f", text.fnv1a32(F.col("f")).alias("h")).collect()}
    got = {r["id"]: r["v"] for r in rules.hashed_vectors(df, "id", 64).collect()}
    assert set(got) == set(range(len(texts)))
    for r in said.collect():
        want = [0.0] * 64
        for share, features in ((1, r["words"]), (0.25, r["grams"])):
            for f in set(features):
                want[hashes[f] % 64] += share * (1 + math.log(features.count(f))) * (-1 if hashes[f] >> 16 & 1 else 1)
        norm = max(math.sqrt(sum(x * x for x in want)), 1e-12)
        assert got[r["id"]] == pytest.approx([x / norm for x in want], abs=1e-9), texts[r["id"]]


def test_trigrams_of_a_text_in_several_steps():
    low = ["", "abcabcab", "日本語", "x", " ".join(map(str, range(50)))]
    whole, parts = (sorted(zip(*map(list, rules._gram_features(low, step)))) for step in (1 << 20, 5))
    assert whole == parts and sum(n for _, _, n in whole) == sum(max(len(t), 1) for t in low)


def test_similarity_of_two_texts_moves_neither(spark):
    texts = odd_texts(random.Random(8))
    other = [texts[-1 - i] if i % 3 else t for i, t in enumerate(texts)]
    rows = [*((i, a, b) for i, (a, b) in enumerate(zip(texts, other))), (-1, "a", None), (-2, None, "b"), (-3, None, None)]
    got = rules.hashed_similarity(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    both = {(r["side"], r["id"]): r["v"] for side, ts in (("a", texts), ("b", other)) for r in rules.hashed_vectors(spark.createDataFrame([*enumerate(ts)], "id long, text string"), "id").withColumn("side", F.lit(side)).collect()}
    for r in got.collect():
        if r["id"] < 0:
            assert r["similarity"] is None
        else:
            dot = sum(x * y for x, y in zip(both["a", r["id"]], both["b", r["id"]]))
            assert r["similarity"] == pytest.approx(min(max(dot, 0), 1), abs=1e-9)


def test_leader_groups_are_one_pass_in_order(spark):
    rng = random.Random(4)
    pairs = {(a, b) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.2}
    leader: dict[int, int] = {}
    for i in range(14):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, 14):
                if (i, j) in pairs and j not in leader:
                    leader[j] = i
    rows = spark.createDataFrame([(i, i) for i in range(14)], "id int, created int")
    got = rules.leader_groups(rows, spark.createDataFrame(sorted(pairs), "a int, b int"))
    assert {r["id"]: r["leader"] for r in got.collect()} == leader


def test_merge_by_alias(spark):
    rows = [(1, "A", ["X"]), (2, "B", ["X", "Y"]), (3, "C", ["Y"]), (4, "D", None)]
    got = rules.merge_by_alias(spark.createDataFrame(rows, "seq int, id string, aliases array<string>"))
    assert sorted(r["id"] for r in got.collect()) == ["A", "C", "D"]


def test_touched_functions(spark):
    f = spark.createDataFrame([("p", "f", 1, 5), ("p", "g", 7, 9)], "path string, name string, line_no int, end_line int")
    added = spark.createDataFrame([("p", 3), ("q", 8)], "path string, new_line int")
    assert [r["name"] for r in rules.touched_functions(f, added).collect()] == ["f"]
