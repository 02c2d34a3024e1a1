"""Queries over source files spelled from orders and parts; the SQL states what each file was built to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as G
from tessera.operators import code as K
from tessera.operators import source as S
from tessera.sources.scratch import shared_path
from tessera.sources.tables import read

# k branches, n notes and e empty lines in a file of each language.
_K, _N, _E = "o_custkey % 3", "o_custkey % 5", "o_orderkey % 4"
_TS = f"""concat('/* head\\n "quoted" and // more\\n*/\\nimport x from "./f', o_orderkey + 50, '"\\n', repeat('\\n', {_E}), 'function run', o_orderkey, '(a, b) {{\\n',
    repeat('  // if (a) note\\n', {_N}), repeat('  if (a && b) {{ go("// if /* kept"); }}\\n', {_K}), '}}\\n')"""
_PY = f"""concat('\"\"\"Head\\nof if\"\"\"\\ndef run', o_orderkey, '(a, b, c):\\n', repeat('    # if note\\n', {_N}), repeat('    if a:  # why\\n        go("# if kept")\\n', {_K}),
    repeat('\\n', {_E}), 'from .f', o_orderkey + 50, ' import x\\n')"""
_SRC_PATH = "'m' || o_orderkey % 50 || '/f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.py' ELSE '.ts' END"


def _sources(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    text = F.when(F.expr("o_orderkey % 3 = 0"), F.expr(_PY)).otherwise(F.expr(_TS))
    return K.with_language(rows.select("o_orderkey", F.expr(_SRC_PATH).alias("path"), text.alias("text")))


def source_lines(spark, sf_dir):
    """Lines of each file by class, comment blocks and literals told apart."""
    return S.line_totals(_sources(spark, sf_dir)).select("path", "language", "total", "code", "comment", "blank")


def source_metrics(spark, sf_dir):
    """Branches and depth of each file's code alone."""
    files = _sources(spark, sf_dir)
    bare = S.stripped(F.col("text"), F.col("language"), literals=False)
    return files.select("path", (1 + S.branches(bare, F.col("language"))).alias("complexity"), S.depth(bare, F.col("language")).alias("nesting"))


def function_spans(spark, sf_dir):
    return S.function_units(_sources(spark, sf_dir)).select("path", "name", "line_no", "end_line", "lines", "parameters", "complexity")


_SHAPES = """CASE o_orderkey % 6 WHEN 0 THEN concat('function s', o_orderkey, '(\\n  x,\\n  y\\n) {\\n', repeat('  if (x) { y(); }\\n', {k}), '}\\n')
    WHEN 1 THEN concat('def s', o_orderkey, '(\\n    a,\\n    b,\\n):\\n', repeat('    if a:\\n        b()\\n', {k}), '    return a\\n')
    WHEN 2 THEN concat('class C {{\\n  public int s', o_orderkey, '(int x, Map<K, V> y)\\n  {{\\n', repeat('    if (x > 0) {{ y(); }}\\n', {k}), '  }}\\n}}\\n')
    WHEN 3 THEN concat('class C {{\\n  async s', o_orderkey, '(cb = () => 1, b, c) {{\\n', repeat('    if (b) {{ c(); }}\\n', {k}), '  }}\\n}}\\n')
    WHEN 4 THEN concat('func (r *R) s', o_orderkey, '(a int, b ...string) {{\\n', repeat('\\tfor a > 1 {{\\n\\t}}\\n', {k}), '}}\\n')
    ELSE concat('def s', o_orderkey, '(a)\\n', repeat('  go(a) unless a\\n', {k}), 'end\\n') END"""


def function_shapes(spark, sf_dir):
    """Functions, methods and receivers whose headers take one line or several, in six shapes of five languages."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    language = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'java' WHEN 3 THEN 'typescript' WHEN 4 THEN 'go' ELSE 'ruby' END")
    text = F.expr(_SHAPES.replace("{{", "{").replace("}}", "}").replace("{k}", "CAST(o_custkey % 4 AS INT)"))
    files = rows.select(F.concat(F.lit("f"), "o_orderkey").alias("path"), language.alias("language"), text.alias("text"))
    return S.function_units(files).select("path", "name", "line_no", "end_line", "lines", "parameters", "complexity")


def _links(files):
    found = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ('import x from "([^"]+)"', "(?m)^from (\\S+) import")])
    return files.select("path", found.alias("specifier"))


_IMPORTS = """CASE o_orderkey % 8 WHEN 0 THEN concat('import {\\n  a,\\n  b,\\n} from "./m', o_custkey, '"\\n// import x from "gone"\\nconst c = require("r"); import("./d")\\nexport * from "e"\\n')
    WHEN 1 THEN concat('from .m', o_custkey, ' import (\\n    a,\\n    b,\\n)\\nimport os, sys as s\\n# import gone\\n')
    WHEN 2 THEN concat('package p\\nimport (\\n\\t"fmt"\\n\\tx "m', o_custkey, '"\\n)\\nimport "os"\\n')
    WHEN 3 THEN concat('use std::io;\\nuse m', o_custkey, '::{\\n  a,\\n  b,\\n};\\nmod inner;\\n/* use gone; */\\n')
    WHEN 4 THEN concat('package a;\\nimport java.util.*;\\nimport static m', o_custkey, '.X;\\n')
    WHEN 5 THEN concat('require "set"\\nrequire_relative \\'m', o_custkey, '\\'\\n# require "gone"\\n')
    WHEN 6 THEN concat('#include <stdio.h>\\n  # include "m', o_custkey, '.h"\\n')
    ELSE concat('@import url("m', o_custkey, '.css");\\n/* @import "gone"; */\\n@import "b";\\n') END"""


def module_imports(spark, sf_dir):
    """What files of eight languages bring in, over one line or several, comments left out."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    language = F.expr("element_at(array('typescript', 'python', 'go', 'rust', 'java', 'ruby', 'c', 'css'), CAST(o_orderkey % 8 AS INT) + 1)")
    files = rows.select(F.concat(F.lit("f"), "o_orderkey").alias("path"), language.alias("language"), F.expr(_IMPORTS).alias("text"))
    return S.module_imports(files)


def import_targets(spark, sf_dir):
    """The file that each file's import means, over extensions and both relative forms."""
    files = _sources(spark, sf_dir)
    return S.resolve_imports(_links(files), files).select("path", "specifier", "target")


def alias_targets(spark, sf_dir):
    """Imports by an alias that a project's configuration declares."""
    files = _sources(spark, sf_dir)
    text = '{\n// paths\n"compilerOptions": {"baseUrl": "./", "paths": {"@/*": ["./*"], "~five/*": ["m5/*"],},},}'
    config = read(spark, sf_dir, "region", "r_regionkey").select(F.lit(text).alias("text"))
    renamed = {r["prefix"]: r["replacement"] for r in S.aliases(config).distinct().collect()}
    links = files.select("path", F.expr("CASE WHEN o_orderkey % 50 = 5 THEN '~five/f' || o_orderkey ELSE '@/m' || o_orderkey % 50 || '/f' || o_orderkey END").alias("specifier"))
    return S.resolve_imports(links, files, renamed).select("path", "target")


_LAYER_PATH = "CASE o_custkey % 6 WHEN 0 THEN 'app/components/' WHEN 1 THEN 'app/api/' WHEN 2 THEN 'src/services/' WHEN 3 THEN 'src/domain/' WHEN 4 THEN 'src/db/' ELSE 'lib/' END || o_custkey || CASE o_custkey % 7 WHEN 0 THEN '.test.ts' ELSE '.ts' END"


def layer_rollup(spark, sf_dir):
    """Modules, size and links to other layers of each layer; customers as modules, nations' links as edges."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.expr(_LAYER_PATH).alias("path"), F.expr(_LAYER_PATH.replace("o_custkey", "(o_custkey + o_orderkey % 4)")).alias("dst"))
    modules = rows.groupBy("path").agg(F.count("*").alias("loc"))
    got = S.layer_summary(modules, rows.select(F.col("path").alias("src"), "dst"))
    return got.select("layer", "modules", "loc", F.array_join(F.transform(F.map_entries("depends_on"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ").alias("depends_on"))


_MANIFEST = """CASE p_partkey % 3
    WHEN 0 THEN concat('<project>', repeat(concat('<dependency>\\n<groupId>g', p_size, '</groupId><artifactId> a', p_partkey, ' </artifactId>', CASE WHEN p_size % 2 = 0 THEN '<version>1.2</version>' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN '<scope>test</scope>' ELSE '' END, '</dependency>'), CAST(1 + p_size % 2 AS INT)), '</project>')
    WHEN 1 THEN concat('<ItemGroup><PackageReference Include="P', p_partkey, '"', CASE WHEN p_size % 2 = 0 THEN ' Version="3.1"' ELSE '' END, ' /></ItemGroup>')
    ELSE concat('dependencies {\\n', CASE WHEN p_size % 5 = 0 THEN 'testImplementation' ELSE 'implementation' END, '("g', p_size, ':a', p_partkey, CASE WHEN p_size % 2 = 0 THEN ':4.0' ELSE '' END, '")\\n}') END"""


def xml_manifests(spark, sf_dir):
    path = F.concat(F.col("p_partkey"), F.expr("CASE p_partkey % 3 WHEN 0 THEN '/pom.xml' WHEN 1 THEN '/x.csproj' ELSE '/build.gradle' END"))
    return S.xml_dependencies(read(spark, sf_dir, "part", "p_partkey", "p_size").select(path.alias("path"), F.expr(_MANIFEST).alias("text")))


_ROUTES = """CASE s_suppkey % 5 WHEN 0 THEN concat('from fastapi import API\\n@api.get("/s/{id}")\\n# @api.get("/no")\\n@api.post("/n', s_nationkey, '")\\n')
    WHEN 1 THEN concat('from flask import Flask\\n@app.route("/n', s_nationkey, '", methods=["POST", "PUT"])\\n@app.route("/all/")\\n')
    WHEN 2 THEN concat('r.GET("/n', s_nationkey, '", show)\\n') WHEN 3 THEN concat('import e from "express"\\nrouter.all("/any", f); app.get(`/n', s_nationkey, '`, g)\\n')
    ELSE concat('api.get("/client/n', s_nationkey, '")\\n') END"""


def _registered(spark, sf_dir):
    path = F.expr("s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.ts' END")
    return S.registered_routes(read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(path.alias("path"), F.expr(_ROUTES).alias("text")))


def route_registrations(spark, sf_dir):
    return _registered(spark, sf_dir)


def route_operations(spark, sf_dir):
    """Registered routes as operations, how many files have each."""
    return G.operations(_registered(spark, sf_dir)).groupBy("id", "method", "path", "tag").agg(F.count("*").alias("files"))


_API = """concat('{"paths": {"/p/{id}/', p_size, '": {"get": {"operationId": "', CASE WHEN p_size % 4 = 0 THEN 'same' ELSE concat('get', p_partkey) END, '", "parameters": [', CASE WHEN p_size % 3 = 0 THEN '' ELSE '{"name": "id", "in": "path"}' END,
    '], "responses": {', CASE WHEN p_size % 5 = 0 THEN '' ELSE '"200": {"description": "ok"}, "404": {}' END, '}}, "post": {"operationId": "', CASE WHEN p_size % 4 = 0 THEN 'same' WHEN p_size % 4 = 1 THEN '' ELSE concat('post', p_partkey) END,
    '", "summary": "Add", "parameters": [{"name": "id", "in": "path"}], "responses": {"201": {}}', CASE WHEN p_size % 2 = 0 THEN ', "requestBody": {"required": true}' ELSE '' END, '}}}}')"""


def _described(spark, sf_dir):
    return G.flattened(read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.expr(_API).alias("text")), "p_partkey")


def api_operations(spark, sf_dir):
    got = _described(spark, sf_dir)
    return got.select("p_partkey", "method", "path", "id", F.coalesce("summary", F.lit("")).alias("summary"), F.array_join("parameters", ",").alias("parameters"), F.array_join("statuses", ",").alias("statuses"), "has_body")


def api_lint(spark, sf_dir):
    return G.lint_operations(_described(spark, sf_dir), "p_partkey")


def entity_merge(spark, sf_dir):
    """Entities that several files define: the fullest one, with references to known entities alone."""
    part = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    cols = part.select((F.col("l_orderkey") % 97).alias("path"), F.concat(F.lit("e"), F.col("l_suppkey") % 40).alias("entity"), F.concat(F.lit("c"), F.col("l_partkey") % 30).alias("column"), F.concat(F.lit("e"), F.col("l_partkey") % 60).alias("refers_to"))
    return G.merged_entities(cols.groupBy("path", "entity", "column").agg(F.min("refers_to").alias("refers_to")), "path")


def output_scores(spark, sf_dir):
    """Answers in conversations scored against the turn before them by seven scorers; totals of each."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    expected = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.when(F.col("turn") % 3 != 2, F.col("text")).alias("expected"))
    words = F.split("expected", " ")
    cases = turns.join(expected, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("output"), "expected", F.slice(words, 1, 2).alias("must"), F.slice(words, 3, 1).alias("never")
    )
    got = G.scored_outputs(cases, "case_id", "[0-9]", 20, 400).where("scorer <> 'similarity'")
    return got.groupBy("scorer").agg(F.count("*").alias("cases"), F.round(F.sum(F.col("score") * F.col("weight")), 4).alias("score"), F.round(F.sum("weight"), 4).alias("weight"))


def similarity_scores(spark, sf_dir):
    """Each document scored against itself as the expected text, which gives one, where it has a token."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text rlike '[a-z]{4}'")
    cases = docs.select("doc_id", F.col("text").alias("output"), F.col("text").alias("expected"))
    return G.similarity(cases, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


def commit_log_rows(spark, sf_dir):
    """Orders written as a commit log and read back from its files."""
    path = shared_path(spark, "commit-log")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    line = F.concat(F.concat_ws("\x1f", "o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.lit("two\nlines")), F.lit("\x1e"))
    orders.select(line).write.text(path)
    return G.commit_log(spark, path).select("sha", "author", "date", "subject", F.length("body").alias("body_chars"))


def stored_records(spark, sf_dir):
    """Two versions of customers kept by segment, then the newest of one collection."""
    path = shared_path(spark, "records")
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_name").select(
        F.col("c_mktsegment").alias("workspace"), F.expr("CASE c_nationkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END").alias("collection"), F.col("c_custkey").alias("id"), F.lit(1).alias("version"), F.col("c_name").alias("payload")
    )
    G.store_records(rows, path)
    G.store_records(rows.where("id % 3 = 0").select("workspace", "collection", "id", F.lit(2).alias("version"), F.concat(F.col("payload"), F.lit("*")).alias("payload")), path)
    return G.list_records(spark, path, "BUILDING", "even")


QUERIES = {f.__name__: f for f in (source_lines, source_metrics, function_spans, function_shapes, module_imports, import_targets, alias_targets, layer_rollup, xml_manifests, route_registrations, route_operations, api_operations, api_lint, entity_merge, output_scores, similarity_scores, commit_log_rows, stored_records)}

_F = f"f AS (SELECT o_orderkey AS o, {_SRC_PATH} AS path, o_orderkey % 3 = 0 AS py, CAST({_K} AS INTEGER) AS k, CAST({_N} AS INTEGER) AS n, CAST({_E} AS INTEGER) AS e FROM orders)"
_LAYER = lambda c: f"CASE WHEN ({c}) % 7 = 0 THEN 'test' ELSE CASE ({c}) % 6 WHEN 0 THEN 'presentation' WHEN 1 THEN 'interface' WHEN 2 THEN 'application' WHEN 3 THEN 'domain' WHEN 4 THEN 'persistence' ELSE 'shared' END END"
_R = """s AS (SELECT s_suppkey AS k, '/n' || s_nationkey AS n FROM supplier),
    r AS (SELECT k || '.py' AS path, 'fastapi' AS framework, 'GET' AS method, '/s/{id}' AS route FROM s WHERE k % 5 = 0 UNION ALL SELECT k || '.py', 'fastapi', 'POST', n FROM s WHERE k % 5 = 0
      UNION ALL SELECT k || '.py', 'flask', unnest(['POST', 'PUT']), n FROM s WHERE k % 5 = 1 UNION ALL SELECT k || '.py', 'flask', 'GET', '/all' FROM s WHERE k % 5 = 1
      UNION ALL SELECT k || '.go', 'go-http', 'GET', n FROM s WHERE k % 5 = 2 UNION ALL SELECT k || '.ts', 'express', 'ANY', '/any' FROM s WHERE k % 5 = 3 UNION ALL SELECT k || '.ts', 'express', 'GET', n FROM s WHERE k % 5 = 3)"""
_O = """o AS (SELECT p_partkey, p_size AS z, 'get' AS method, '/p/:id/' || p_size AS path, CASE WHEN p_size % 4 = 0 THEN 'same' ELSE 'get' || p_partkey END AS id, '' AS summary, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'id' END AS parameters,
      CASE WHEN p_size % 5 = 0 THEN '' ELSE '200,404' END AS statuses, false AS has_body FROM part
    UNION ALL SELECT p_partkey, p_size, 'post', '/p/:id/' || p_size, CASE p_size % 4 WHEN 0 THEN 'same' WHEN 1 THEN '' ELSE 'post' || p_partkey END, 'Add', 'id', '201', p_size % 2 = 0 FROM part)"""
ORACLES = {
    "source_lines": f"""WITH {_F}, c AS (SELECT path, CASE WHEN py THEN 'python' ELSE 'typescript' END AS language, CASE WHEN py THEN 2 + 2 * k ELSE 3 + k END AS code, CASE WHEN py THEN 2 ELSE 3 END + n AS comment, e AS blank FROM f)
        SELECT path, language, code + comment + blank AS total, code, comment, blank FROM c""",
    "source_metrics": f"WITH {_F} SELECT path, 1 + CASE WHEN py THEN k ELSE 2 * k END AS complexity, CASE WHEN py THEN CASE WHEN k > 0 THEN 2 ELSE 0 END ELSE CASE WHEN k > 0 THEN 2 ELSE 1 END END AS nesting FROM f",
    "function_spans": f"""WITH {_F}, s AS (SELECT path, 'run' || o AS name, CASE WHEN py THEN 3 ELSE 5 + e END AS line_no, CASE WHEN py THEN 1 + n + 2 * k + e ELSE 2 + n + k END AS lines, CASE WHEN py THEN 3 ELSE 2 END AS parameters,
        1 + CASE WHEN py THEN k ELSE 2 * k END AS complexity FROM f) SELECT path, name, line_no, line_no + lines - 1 AS end_line, lines, parameters, complexity FROM s""",
    "function_shapes": """WITH o AS (SELECT 'f' || o_orderkey AS path, 's' || o_orderkey AS name, o_orderkey % 6 AS m, o_custkey % 4 AS k FROM orders),
        s AS (SELECT path, name, CASE WHEN m IN (2, 3) THEN 2 ELSE 1 END AS line_no, CASE m WHEN 0 THEN 5 + k WHEN 1 THEN 5 + 2 * k WHEN 2 THEN 4 + k WHEN 3 THEN 3 + k WHEN 4 THEN 2 + 2 * k ELSE 1 + k END AS end_line,
          CASE m WHEN 3 THEN 3 WHEN 5 THEN 1 ELSE 2 END AS parameters, 1 + k AS complexity FROM o)
        SELECT path, name, line_no, end_line, end_line - line_no + 1 AS lines, parameters, complexity FROM s""",
    "module_imports": """WITH o AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 8 AS k, 'm' || o_custkey AS m, ['typescript', 'python', 'go', 'rust', 'java', 'ruby', 'c', 'css'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS language FROM orders),
        h(k, line_no, head, tail, kind) AS (VALUES (0, 1, './', '', 'static'), (1, 1, '.', '', 'static'), (2, 2, '', '', 'static'), (3, 2, '', '', 'static'), (4, 3, '', '.X', 'static'), (5, 2, '', '', 'require'), (6, 2, '', '.h', 'include'), (7, 1, '', '.css', 'static')),
        n(k, line_no, specifier, kind) AS (VALUES (0, 6, 'r', 'require'), (0, 6, './d', 'dynamic'), (0, 7, 'e', 'reexport'), (1, 5, 'os', 'static'), (1, 5, 'sys', 'static'), (2, 2, 'fmt', 'static'), (2, 6, 'os', 'static'), (3, 1, 'std::io', 'static'), (3, 6, 'inner', 'module'),
          (4, 2, 'java.util.*', 'static'), (5, 1, 'set', 'require'), (6, 1, 'stdio.h', 'include'), (7, 3, 'b', 'static'))
        SELECT path, language, line_no, head || m || tail AS specifier, kind FROM o JOIN h USING (k) UNION ALL SELECT path, language, line_no, specifier, kind FROM o JOIN n USING (k)""",
    "import_targets": f"WITH {_F} SELECT a.path, CASE WHEN a.py THEN '.f' ELSE './f' END || (a.o + 50) AS specifier, b.path AS target FROM f a LEFT JOIN f b ON b.o = a.o + 50",
    "alias_targets": f"WITH {_F} SELECT path, path AS target FROM f",
    "layer_rollup": f"""WITH p AS (SELECT o_custkey AS s, o_custkey + o_orderkey % 4 AS d FROM orders), l AS (SELECT {_LAYER("s")} AS layer, {_LAYER("d")} AS "to", s FROM p),
        e AS (SELECT layer, "to", count(*) AS n FROM l WHERE layer <> "to" GROUP BY ALL), t AS (SELECT layer, string_agg("to" || '=' || n, ' ' ORDER BY "to") AS depends_on FROM e GROUP BY layer)
        SELECT layer, count(DISTINCT s) AS modules, count(*) AS loc, any_value(depends_on) AS depends_on FROM l LEFT JOIN t USING (layer) GROUP BY layer""",
    "xml_manifests": """WITH p AS (SELECT *, p_partkey % 3 AS m, p_size % 2 = 0 AS v, CASE WHEN p_size % 5 = 0 THEN 'development' ELSE 'runtime' END AS sc FROM part)
        SELECT p_partkey || '/pom.xml' AS path, 'maven' AS ecosystem, 'g' || p_size || ':a' || p_partkey AS name, CASE WHEN v THEN '1.2' ELSE '*' END AS range, sc AS scope FROM (SELECT *, unnest(range(1 + p_size % 2)) FROM p WHERE m = 0)
        UNION ALL SELECT p_partkey || '/x.csproj', 'nuget', 'P' || p_partkey, CASE WHEN v THEN '3.1' ELSE '*' END, 'runtime' FROM p WHERE m = 1
        UNION ALL SELECT p_partkey || '/build.gradle', 'maven', 'g' || p_size || ':a' || p_partkey, CASE WHEN v THEN '4.0' ELSE '*' END, sc FROM p WHERE m = 2""",
    "route_registrations": f"WITH {_R} SELECT * FROM r",
    "route_operations": f"""WITH {_R} SELECT lower(method) || '_' || regexp_replace(regexp_replace(route, '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS id, lower(method) AS method, route AS path, string_split(route, '/')[2] AS tag, count(*) AS files
        FROM r WHERE method <> 'ANY' GROUP BY ALL""",
    "api_operations": f"WITH {_O} SELECT p_partkey, method, path, id, summary, parameters, statuses, has_body FROM o",
    "api_lint": f"""WITH {_O}, n AS (SELECT *, upper(method) || ' ' || path AS operation, row_number() OVER (PARTITION BY p_partkey, id ORDER BY path, method) AS no FROM o),
        x AS (SELECT p_partkey, operation, 'error' AS severity, 'no-id' AS problem, '' AS detail FROM n WHERE id = ''
        UNION ALL SELECT p_partkey, operation, 'error', 'repeated-id', id FROM n WHERE id <> '' AND no > 1 UNION ALL SELECT p_partkey, operation, 'error', 'undeclared-parameter', 'id' FROM n WHERE parameters = ''
        UNION ALL SELECT p_partkey, operation, 'error', 'no-response', '' FROM n WHERE statuses = '' UNION ALL SELECT p_partkey, operation, 'warning', 'no-success-response', '' FROM n WHERE statuses = ''
        UNION ALL SELECT p_partkey, operation, 'warning', 'no-error-response', '' FROM n WHERE statuses NOT LIKE '%404%' UNION ALL SELECT p_partkey, operation, 'warning', 'no-summary', '' FROM n WHERE summary = ''
        UNION ALL SELECT p_partkey, operation, 'warning', 'no-body', '' FROM n WHERE method = 'post' AND NOT has_body) SELECT * FROM x""",
    "entity_merge": """WITH c AS (SELECT l_orderkey % 97 AS path, 'e' || l_suppkey % 40 AS entity, 'c' || l_partkey % 30 AS "column", min('e' || l_partkey % 60) AS refers_to FROM lineitem GROUP BY ALL),
        n AS (SELECT entity, path, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, path) AS place FROM c GROUP BY entity, path)
        SELECT entity, path, "column", CASE WHEN refers_to IN (SELECT entity FROM c) THEN refers_to END AS refers_to FROM c JOIN n USING (entity, path) WHERE place = 1""",
    "output_scores": """WITH t AS (SELECT a.text AS o, CASE WHEN b.turn % 3 <> 2 THEN b.text END AS e FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
        w AS (SELECT *, coalesce(string_split(e, ' ')[1:2], []) AS m, coalesce(string_split(e, ' ')[3:3], []) AS b, lower(o) AS l FROM t),
        x AS (SELECT unnest(['exact-match', 'contains', 'not-contains', 'json-valid', 'regex', 'length']) AS scorer,
          unnest([CASE WHEN lower(trim(regexp_replace(o, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(e, '\\s+', ' ', 'g'))) THEN 1.0 ELSE 0.0 END, CASE WHEN len(m) > 0 THEN len(list_filter(m, lambda s: contains(l, lower(s)))) / len(m) ELSE 0.0 END,
            CASE WHEN len(list_filter(b, lambda s: contains(l, lower(s)))) = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN json_valid(o) THEN 1.0 ELSE 0.0 END, CASE WHEN regexp_matches(o, '[0-9]') THEN 1.0 ELSE 0.0 END, CASE WHEN length(trim(o)) BETWEEN 20 AND 400 THEN 1.0 ELSE 0.0 END]) AS score,
          unnest([CASE WHEN e IS NULL THEN 0.0 ELSE 1.0 END, CASE WHEN len(m) > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN len(b) > 0 THEN 1.0 ELSE 0.0 END, 1.0, 1.0, 1.0]) AS weight FROM w)
        SELECT scorer, count(*) AS cases, round(sum(score * weight), 4)::DOUBLE AS score, round(sum(weight), 4)::DOUBLE AS weight FROM x GROUP BY scorer""",
    "similarity_scores": "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE regexp_matches(text, '[a-z]{4}')",
    "commit_log_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS sha, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS subject, 9 AS body_chars FROM orders",
    "stored_records": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version, c_name || CASE WHEN c_custkey % 3 = 0 THEN '*' ELSE '' END AS payload FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0",
}
