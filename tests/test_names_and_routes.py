"""Names in texts, registered routes and code rules on texts of many shapes."""

from tessera.operators.audit import code_patterns
from tessera.operators.lines import line_counts, lines
from tessera.operators.memory import entities
from tessera.operators.source import registered_routes


def names(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {(r["name"], r["kind"]) for r in entities(df).collect()}


def test_entities_by_shape(spark):
    assert names(spark, "see ./src/lib/auth.ts, and a/b/.") == {("src/lib/auth.ts", "file")}
    assert names(spark, "call `parseIt` or `x` or `a b` now `y") == {("parseit", "symbol")}
    assert names(spark, "uses react-dom and @scope/core-kit, x-, -y") >= {("react-dom", "package"), ("@scope/core-kit", "package")}
    assert names(spark, "we decided to keep one index; it agreed on x. chose plain files\nthen") == {("keep one index", "decision"), ("plain files", "decision")}
    got = names(spark, "Vector Search Engine Room beats The Old Way, Big Data. Abc Abcd")
    assert got == {("vector search engine", "concept"), ("room", "concept"), ("big data", "concept"), ("abc abcd", "concept")}
    assert names(spark, "`src/a/b.ts` `Parser` Parser") == {("src/a/b.ts", "file"), ("parser", "symbol")}
    assert names(spark, "") == set()


def test_null_text_has_no_names(spark):
    assert entities(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def routes(spark, declared=(), **files):
    rows = [(p.replace("__", "/").replace("_", "."), t) for p, t in files.items()]
    df = spark.createDataFrame(rows, "path string, text string")
    return {(r["framework"], r["method"], r["route"]) for r in registered_routes(df, declared).collect()}


def test_calls(spark):
    text = "import express from 'express'\napp.get('/a', f); router.post(\n  \"/b\", g)\nclient.get('/no')\n// app.get('/gone')\napp.all(`/c`, h)\nmap.get('k')"
    assert routes(spark, a_ts=text) == {("express", "GET", "/a"), ("express", "POST", "/b"), ("express", "ANY", "/c")}
    assert routes(spark, a_ts="app.get('/a', f)") == set()
    assert routes(spark, ("express",), a_ts="app.get('/a', f)") == {("express", "GET", "/a")}
    assert routes(spark, m_go='r.GET("/x", show)\nr.get("/y")') == {("go-http", "GET", "/x")}


def test_decorators_annotations_statements(spark):
    assert routes(spark, a_py="from fastapi import FastAPI\n@app.get('/i/{id}')\n@app.route('/no')\nrequests.get('/x')") == {("fastapi", "GET", "/i/{id}")}
    flask = "import flask\n@app.route('/a', methods=['GET', 'POST'])\n@app.route('/b')\n@app.route('/c', methods=(\"PUT\",))"
    assert routes(spark, a_py=flask) == {("flask", "GET", "/a"), ("flask", "POST", "/a"), ("flask", "GET", "/b"), ("flask", "PUT", "/c")}
    spring = '@GetMapping("/a")\n@PostMapping(value = "/b")\n@RequestMapping("/c")\n@Get("/d")'
    assert routes(spark, A_java=spring) == {("spring", "GET", "/a"), ("spring", "POST", "/b")}
    assert routes(spark, config__routes_rb="get '/a', to: 'x'\npost \"/b\"\nresources '/c'") == {("rails", "GET", "/a"), ("rails", "POST", "/b")}
    assert routes(spark, lib__other_rb="get '/a', to: 'x'") == set()


def test_code_rules(spark):
    def rules(line, language="typescript"):
        df = spark.createDataFrame([("a", language, 1, line)], "path string, language string, line_no int, line string")
        return {r["rule"] for r in code_patterns(df).collect()}

    assert rules("verify=False", "python") == rules('"rejectUnauthorized" : false') == {"tls-not-verified"}
    assert rules("verify = True", "python") == rules('u = "http://localhost/x"') == rules("fetch('http://127.0.0.1/')") == set()
    assert rules("fetch(`http://api.shop.net/x`)") == {"plain-http"}
    assert rules("app.debug = True", "python") == rules("DEBUG=1", "python") == {"debug-on"} and rules("debug = True") == set()
    assert rules("el.innerHTML += x") == {"raw-html-write"} and rules("el.innerHTML === x") == rules("el.innerHTML = DOMPurify.sanitize(x)") == set()
    assert rules("k = process.env.NEXT_PUBLIC_STRIPE_SECRET") == {"key-in-browser"} and rules("NEXT_PUBLIC_URL") == set()


def test_comment_lines(spark):
    df = spark.createDataFrame([(1, "  // a\n\t# b\n* c\n-- d\n<!-- e\nx // f\n\n - g")], "doc_id long, text string")
    (r,) = line_counts(lines(df)).collect()
    assert (r["total"], r["code"], r["comment"], r["blank"]) == (8, 2, 5, 1)
