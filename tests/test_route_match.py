"""Routes matched on keys against every template tried on every path."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import code


def matched(spark, paths, templates):
    r = spark.createDataFrame([*enumerate(paths)], "request_id int, path string")
    return {x["request_id"]: x["template"] for x in code.match_routes(r, spark.createDataFrame([(t,) for t in templates], "template string")).collect()}


def tried(paths, templates):
    """As the SQL: a template is an expression in which :name stands for a segment's text."""
    rank = lambda t: (len(re.findall(":[a-z]+", t)), -len(t), t.encode())
    each = sorted(set(templates), key=rank)
    patterns = [(t, re.compile(re.sub(":[a-z]+", "[^/]+", t))) for t in each]
    return {i: p if p is None else next((t for t, x in patterns if x.fullmatch(p)), None) for i, p in enumerate(paths)}


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    piece = ["a", "b", ".", "ab", "a.b", "b.a.a", ":id", ":user", "a:id", ":id.b", "é😀", "x+", "(a)", "a|b", "[ab]", "b?", "1", "", ":", "a.b.a.b.a.b"]
    templates = ["/" + "/".join(rng.choice(piece) for _ in range(rng.randint(1, 3))) for _ in range(150)] + ["", "/", "no/slash.first"]
    text = ["a", "b", "ab", "a.b", "axb", "a/b", "b.a.a", "1", "", ".", "é😀", "xx", "x+", "q.b", "aé", "a😀b", "a.b.a/b.a.b", ":id"]
    paths = ["/" + "/".join(rng.choice(text) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["", "/", "no/slashxfirst", None, *templates]
    want = tried(paths, templates)
    got = matched(spark, paths, templates)
    assert {i: (paths[i], t, want[i]) for i, t in got.items() if t != want[i]} == {} and len(got) == len(paths)


def test_dots_stand_for_any_sign_and_names_of_parameters_do_not_count(spark):
    templates = ["/en/7.html", "/:lang/:page", "/:user/x", "/f/:id.txt"]
    paths = ["/en/7.html", "/en/7/html", "/en/7xhtml", "/q/x", "/f/9.txt", "/f/.txt", "/a/b/c"]
    got = matched(spark, paths, templates)
    assert [got[i] for i in range(len(paths))] == ["/en/7.html"] * 3 + ["/:user/x", "/f/:id.txt", "/:lang/:page", None]


def test_candidates_grow_with_requests_and_not_with_templates(spark):
    r = spark.range(3000).select(F.col("id").alias("request_id"), F.concat(F.lit("/en/"), F.col("id"), F.when(F.col("id") % 3 == 0, ".html").otherwise("")).alias("path"))
    t = r.select(code.route_template(F.col("path")).alias("template")).distinct()
    keyed = code._keyed_templates(t)
    shapes = keyed.select("shape").distinct()
    pairs = code._keyed_paths(r, shapes).join(keyed, ["shape", "key"]).count()
    # Each path meets the template of its own, those of files /en/:id as well.
    assert pairs == 4000 and shapes.count() < 12
