"""Column functions and operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import changes, findings, graph, lines, memory, tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, X.tokens(F.col("t")), t="parseRepository of HTTPServer_x the a7")
    assert got == ["parserepository", "parse", "repository", "httpserver_x", "http", "server", "a7"]
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_fuzzy_score(spark):
    f = X.fuzzy_score(F.col("q"), F.col("t"))
    assert one(spark, f, q="wk", t="wkx") == pytest.approx(4 + 5 - 0.1)
    assert one(spark, f, q="zz", t="abc") is None
    assert one(spark, f, q="", t="abc") == 0


def test_small_text_functions(spark):
    assert one(spark, X.ngrams(F.col("t")), t="Ab") == [" ab", "ab "]
    assert one(spark, X.edit_distance(F.col("a"), F.col("b"), 2), a="abc", b="xyz") == 3
    assert one(spark, X.entropy(F.col("t")), t="aabb") == pytest.approx(1.0)
    assert one(spark, X.slug(F.col("t")), t="  Étude No. 1!") == "etude-no-1"
    assert one(spark, X.slug(F.col("t")), t="!!") == "untitled"
    assert one(spark, X.title_case(F.col("t")), t="fooBar-baz_q") == "Foo Bar Baz Q"
    assert one(spark, X.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    h = 2166136261
    for c in b"hello":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, X.fnv1a32(F.col("t")), t="hello") == h


def test_lines(spark):
    df = spark.createDataFrame([(1, "// a\n\ncode\n"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["total"], r["code"], r["comment"], r["blank"]) for r in lines.line_counts(lines.lines(df)).collect()}
    assert got == {1: (3, 1, 1, 1), 2: (1, 0, 0, 1), 3: (1, 0, 0, 1)}


def test_nesting_and_complexity(spark):
    assert one(spark, lines.nesting(F.col("t")), t="}{ { {} } }") == 3
    assert one(spark, lines.complexity(F.col("t")), t="if (a && b) x ?? y") == 4


def test_secret_preview_hides_value(spark):
    ls = spark.createDataFrame([(1, 1, 'token = "' + "ab12" * 10 + '"'), (1, 2, "password = change_me_now")], "doc_id long, line_no int, line string")
    rows = findings.secrets(ls).collect()
    assert [(r["rule"], r["preview"]) for r in rows] == [("hex-token", "ab12....")]


def test_cycles_and_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    assert {r["node"]: r["component"] for r in graph.cycles(edges).collect()} == {1: 1, 2: 1, 3: 1}
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, edges).collect()} == {5: 0, 6: 0, 1: None, 2: None, 3: None, 4: None}
    assert [r["node"] for r in graph.orphans(nodes, edges).collect()].sort() == [5, 6].sort()


def test_folded_path(spark):
    assert one(spark, graph.folded(F.col("p")), p="a/./b/../c//d") == "a/c/d"


def test_versions_order(spark):
    rows = [("1.2.0-beta",), ("1.10",), ("1.2.0",), ("v2",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").orderBy(changes.version(F.col("v"))).collect()]
    assert got == ["1.2.0-beta", "1.2.0", "1.10", "v2"]


def test_commits(spark):
    rows = [(1, "feat(api)!: add x", None), (2, "Fix stuff", "closes #4 and #4"), (3, "fix: y #7", "BREAKING CHANGE: z")]
    got = {r["sha"]: r for r in changes.parse_commits(spark.createDataFrame(rows, "sha int, subject string, body string")).collect()}
    assert (got[1]["kind"], got[1]["scope"], got[1]["breaking"]) == ("feat", "api", True)
    assert (got[2]["kind"], got[2]["refs"]) == ("other", ["4"])
    assert (got[3]["breaking"], got[3]["refs"]) == (True, ["7"])


def test_decay(spark):
    f = memory.decayed_importance(F.col("i"), F.col("a"), F.col("u"))
    assert one(spark, f, i=1.0, a=45.0, u=0) == pytest.approx(0.5)
    assert one(spark, f, i=1.0, a=200.0, u=30) == pytest.approx(1.0)
    assert one(spark, f, i=1.0, a=200.0, u=0) < math.pow(0.5, 4)


def test_chunks_cover_text(spark):
    text = " ".join(f"Sentence number {i}." for i in range(400))
    rows = memory.chunk_text(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("chunk_no").collect()
    assert all(r["doc_id"] == 1 for r in rows)
    assert rows[0]["start"] == 0 and rows[-1]["start"] + len(rows[-1]["chunk"]) >= len(text) - 2
    assert all(b["start"] <= a["start"] + 1200 for a, b in zip(rows, rows[1:]))


def test_upsert_and_patch(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 3)], "k int, v string, ver int")
    b = spark.createDataFrame([(1, "z", 1), (2, "w", 2)], "k int, v string, ver int")
    assert {r["k"]: r["v"] for r in tables.upsert(a, b, "k", "ver").collect()} == {1: "z", 2: "y"}
    p = spark.createDataFrame([(1, None), (2, "q")], "k int, v string")
    assert {r["k"]: r["v"] for r in tables.patched(a, p, "k").collect()} == {1: "x", 2: "q"}


def test_comments_keep_quotes_and_line_ends(spark):
    from tessera.operators import code

    text = 'a("// no"); // yes\n/* one\ntwo */ b \'/*\' c'
    assert one(spark, code.without_comments(F.col("t")), t=text) == 'a("// no"); \n\n b \'/*\' c'
    assert one(spark, code.without_comments(F.col("t"), "hash"), t='x = "#" # note\ny') == 'x = "#" \ny'


def test_functions_and_imports(spark):
    from tessera.operators import code

    text = "function alpha(a, b) {\n  if (a) {\n    return b;\n  }\n}\nfunction nil() { return 1; }\nimport x from './y';\n// import z from 'no'"
    ls = lines.lines(spark.createDataFrame([("f.ts", text)], "path string, text string"), "path")
    got = {r["name"]: (r["line_no"], r["end_line"], r["parameters"], r["complexity"]) for r in code.brace_functions(ls).collect()}
    assert got == {"alpha": (1, 5, 2, 2), "nil": (6, 6, 0, 1)}
    assert {(r["specifier"], r["kind"]) for r in code.imports(ls.where("line_no < 8")).collect()} == {("./y", "static")}
    assert one(spark, code.package_name(F.col("s")), s="@a/b/c") == "@a/b"


def test_ignore_rules(spark):
    from tessera.operators import code

    for path, want in (("a/node_modules/x.js", True), ("keep.log", False), ("x/y.log", True), ("src/deep/z.ts", False), ("build/a", True)):
        assert one(spark, code.ignored(F.col("p"), ["node_modules/", "*.log", "!keep.log", "/build/"]), p=path) is want, path


def test_snapshot(spark, tmp_path):
    from tessera.operators import code

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.txt").write_bytes("﻿hé".encode())
    (tmp_path / "b.bin").write_bytes(b"x\x00y")
    (tmp_path / "skip.log").write_text("no")
    got = {r["path"]: (r["binary"], r["text"]) for r in code.snapshot(spark, str(tmp_path), ["*.log"]).collect()}
    assert got == {"a/t.txt": (False, "hé"), "b.bin": (True, None)}


def test_manifests(spark):
    from tessera.operators import code

    toml = '[project]\nname = "x"\n[tool.poetry.dependencies]\nrequests = "^2.1" # c\n[other]\ny = "1"'
    ls = lines.lines(spark.createDataFrame([("p", toml)], "path string, text string"), "path")
    assert [(r["name"], r["range"]) for r in code.section_dependencies(ls, "dependencies$").collect()] == [("requests", "^2.1")]
    files = spark.createDataFrame([("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}')], "path string, text string")
    assert {(r["scope"], r["name"], r["range"]) for r in code.json_dependencies(files).collect()} == {("runtime", "a", "^1"), ("dev", "b", "2")}


def test_routes(spark):
    from tessera.operators import code

    assert one(spark, code.route_template(F.col("p")), p="/u/{name}/7/<int:k>") == "/u/:id/:id/:id"
    t = spark.createDataFrame([("/u/:id",), ("/u/new",), ("/:id/x",)], "template string")
    r = spark.createDataFrame([(1, "/u/new"), (2, "/u/9"), (3, "/q/x"), (4, "/none")], "request_id int, path string")
    assert {x["request_id"]: x["template"] for x in code.match_routes(r, t).collect()} == {1: "/u/new", 2: "/u/:id", 3: "/:id/x", 4: None}
