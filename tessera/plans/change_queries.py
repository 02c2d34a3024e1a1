"""Queries of changes, versions and evaluations, over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import changes as C
from tessera.sources.tables import read

_SUBJECT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'fix(orders): settle #' || o_custkey WHEN '2-HIGH' THEN 'feat: add order ' || o_orderkey
    WHEN '3-MEDIUM' THEN 'docs(clerk): Note order ' || o_orderkey || '.' WHEN '4-NOT SPECIFIED' THEN 'Reworked things for #' || o_custkey
    ELSE 'chore' || CASE WHEN o_totalprice > 400000 THEN '!' ELSE '' END || ': drop ' || o_orderkey END"""
_BODY = "CASE WHEN o_totalprice > 450000 THEN 'BREAKING CHANGE: price' WHEN o_orderstatus = 'F' THEN 'closes #' || o_orderkey END"


def _commits(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("sha"), F.expr(_SUBJECT).alias("subject"), F.expr(_BODY).alias("body"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("author"))


def commit_classes(spark, sf_dir):
    got = C.parse_commits(_commits(spark, sf_dir))
    return got.select("sha", "kind", "scope", "breaking", "description", F.size("refs").alias("refs"))


def release_kinds(spark, sf_dir):
    return C.release_kind(C.parse_commits(_commits(spark, sf_dir)), "month")


def changelog(spark, sf_dir):
    """Entries of every month by section, and the first of them."""
    got = C.parse_commits(_commits(spark, sf_dir)).where("kind not in ('chore', 'other')")
    return got.groupBy("month", "kind", "scope").agg(F.count("*").alias("entries"), F.min("description").alias("first_entry"), F.countDistinct("author").alias("contributors"))


def commit_lint(spark, sf_dir):
    return C.lint(C.parse_commits(_commits(spark, sf_dir)), "sha").groupBy("issue").agg(F.count("*").alias("n"), F.min("sha").alias("first_sha"))


def _dependencies(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_quantity", "l_suppkey", "l_returnflag")
    return items.select(
        F.col("l_returnflag").alias("ecosystem"), F.concat(F.lit("Part-"), F.col("l_partkey")).alias("name"),
        F.concat_ws(".", F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_suppkey") % 10).alias("version"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 7, F.when(F.col("l_suppkey") % 2 == 0, "/sub").otherwise(""), F.lit("/manifest-"), F.col("l_suppkey")).alias("manifest"),
    )


def _advisories(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size > 40")
    return parts.select(
        F.lit("R").alias("ecosystem"), F.concat(F.lit("PART-"), F.col("p_partkey")).alias("package"), F.concat(F.lit("ADV-"), F.col("p_partkey")).alias("advisory"),
        F.when(F.col("p_size") > 45, "high").otherwise("low").alias("severity"), F.lit("1.10").alias("low"), F.concat(F.lit("4."), F.col("p_size")).alias("high"),
    )


def vuln_match(spark, sf_dir):
    got = C.vulnerable(_dependencies(spark, sf_dir), _advisories(spark, sf_dir))
    return got.groupBy("advisory", "severity").agg(F.count("*").alias("matches"), F.countDistinct("version").alias("versions"))


def dep_merge(spark, sf_dir):
    per = _dependencies(spark, sf_dir).groupBy("ecosystem", "name", "manifest").agg(F.count("*").alias("lines"))
    return C.first_declared(per)


def _cases(spark, sf_dir):
    """Documents as outputs of variants, one for each language; quality from their labels."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("variant"), F.col("doc_id"), (0.6 * F.col("quality") + 0.4 * (1 - F.col("toxic"))).alias("quality"),
        F.col("n_chars").cast("double").alias("latency"), (F.col("n_chars") / 1e6).alias("cost"), (F.col("n_chars") < 200).alias("failed"),
    )


def eval_scores(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    scorers = F.array(
        F.struct(F.lit("length").alias("scorer"), F.when(F.length("text").between(200, 5000), 1.0).otherwise(0.0).alias("score"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("not-contains").alias("scorer"), F.when(F.col("text").contains("!!"), 0.0).otherwise(1.0).alias("score"), F.lit(2.0).alias("weight")),
        F.struct(F.lit("quality").alias("scorer"), F.col("quality").cast("double").alias("score"), F.lit(1.5).alias("weight")),
    )
    return C.weighted_quality(docs.select("doc_id", F.explode(scorers).alias("s")).select("doc_id", "s.*"), "doc_id")


def eval_summary(spark, sf_dir):
    return C.summarise(_cases(spark, sf_dir))


def eval_winner(spark, sf_dir):
    return C.winner(C.summarise(_cases(spark, sf_dir))).select("variant", "quality", "cost")


def compare_variants(spark, sf_dir):
    """Each metric of each variant, marked where it is the best."""
    s = C.summarise(_cases(spark, sf_dir)).select("variant", *[F.col(c).cast("double").alias(c) for c in ("quality", "pass_rate", "latency", "cost")])
    long = s.unpivot("variant", ["quality", "pass_rate", "latency", "cost"], "metric", "value")
    w = Window.partitionBy("metric")
    best = F.when(F.col("metric").isin("quality", "pass_rate"), F.max("value").over(w)).otherwise(F.min("value").over(w))
    return long.withColumn("better", F.col("value") == best)


def monthly_cost(spark, sf_dir):
    s = C.summarise(_cases(spark, sf_dir))
    return s.select("variant", F.round(F.col("cost") / F.col("cases") * 1000 * 30, 4).alias("monthly"))


QUERIES = {f.__name__: f for f in (commit_classes, release_kinds, changelog, commit_lint, vuln_match, dep_merge, eval_scores, eval_summary, eval_winner, compare_variants, monthly_cost)}

_H = "^([a-zA-Z]+)(?:\\(([^)]*)\\))?(!)?: (.+)$"
_P = f"""c AS (SELECT o_orderkey AS sha, {_SUBJECT} AS subject, {_BODY} AS body, strftime(o_orderdate, '%Y-%m') AS month, o_custkey AS author FROM orders),
    k AS (SELECT *, lower(regexp_extract(subject, '{_H}', 1)) AS k0 FROM c),
    p AS (SELECT *, k0 IN ('feat', 'fix', 'docs', 'perf', 'refactor', 'test', 'build', 'chore') AS conventional,
      regexp_extract(subject, '{_H}', 3) = '!' OR regexp_matches(coalesce(body, ''), '(?m)^BREAKING CHANGE') AS breaking FROM k),
    q AS (SELECT *, CASE WHEN conventional THEN k0 ELSE 'other' END AS kind, CASE WHEN conventional THEN regexp_extract(subject, '{_H}', 2) ELSE '' END AS scope,
      CASE WHEN conventional THEN regexp_extract(subject, '{_H}', 4) ELSE subject END AS description,
      len(list_distinct(regexp_extract_all(concat_ws(chr(10), subject, body), '#([0-9]+)', 1))) AS refs FROM p)"""
_E = """cs AS (SELECT lang AS variant, 0.6 * quality + 0.4 * (1 - toxic) AS quality, CAST(n_chars AS DOUBLE) AS latency, n_chars / 1e6 AS cost, n_chars < 200 AS failed FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT variant, count(*) AS cases, round(avg(CASE WHEN NOT failed THEN CAST(quality AS DOUBLE) END), 4) AS quality, round(count(*) FILTER (NOT failed AND quality >= 0.6) / count(*), 4) AS pass_rate,
      round(avg(CASE WHEN NOT failed THEN latency END), 4) AS latency, quantile_disc(CASE WHEN NOT failed THEN latency END, 0.95) AS p95, round(sum(cost), 6) AS cost, count(*) FILTER (failed) AS errors FROM cs GROUP BY variant)"""
_DEP = """d AS (SELECT l_returnflag AS ecosystem, 'Part-' || l_partkey AS name, l_linenumber AS ma, CAST(l_quantity AS INTEGER) AS mi, l_suppkey % 10 AS pa,
    's' || (l_suppkey % 7) || CASE WHEN l_suppkey % 2 = 0 THEN '/sub' ELSE '' END || '/manifest-' || l_suppkey AS manifest, l_partkey FROM lineitem)"""
ORACLES = {
    "commit_classes": f"WITH {_P} SELECT sha, kind, scope, breaking, description, CAST(refs AS INTEGER) AS refs FROM q",
    "release_kinds": f"WITH {_P} SELECT month, CASE WHEN bool_or(breaking) THEN 'major' WHEN bool_or(kind = 'feat') THEN 'minor' ELSE 'patch' END AS release, count(*) AS commits FROM q GROUP BY month",
    "changelog": f"WITH {_P} SELECT month, kind, scope, count(*) AS entries, min(description) AS first_entry, count(DISTINCT author) AS contributors FROM q WHERE kind NOT IN ('chore', 'other') GROUP BY ALL",
    "commit_lint": f"""WITH {_P}, i AS (SELECT sha, unnest(list_filter([CASE WHEN NOT conventional THEN 'not-conventional' END, CASE WHEN length(subject) > 72 THEN 'subject-too-long' END,
        CASE WHEN subject LIKE '%.' THEN 'trailing-period' END, CASE WHEN regexp_matches(description, '^[A-Z]') THEN 'capitalised-description' END,
        CASE WHEN breaking AND coalesce(body, '') = '' THEN 'breaking-without-body' END], lambda x: x IS NOT NULL)) AS issue FROM q)
        SELECT issue, count(*) AS n, min(sha) AS first_sha FROM i GROUP BY issue""",
    "vuln_match": f"""WITH {_DEP} SELECT 'ADV-' || p_partkey AS advisory, CASE WHEN p_size > 45 THEN 'high' ELSE 'low' END AS severity, count(*) AS matches, count(DISTINCT (ma, mi, pa)) AS versions
        FROM d JOIN part ON l_partkey = p_partkey WHERE p_size > 40 AND ecosystem = 'R' AND (ma, mi, pa) >= (1, 10, 0) AND (ma, mi, pa) < (4, p_size, 0) GROUP BY ALL""",
    "dep_merge": f"""WITH {_DEP}, g AS (SELECT ecosystem, name, manifest, count(*) AS lines FROM d GROUP BY ALL)
        SELECT ecosystem, name, manifest, lines FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY len(string_split(manifest, '/')), manifest) AS place FROM g) WHERE place = 1""",
    "eval_scores": """SELECT doc_id, floor((CASE WHEN length(text) BETWEEN 200 AND 5000 THEN 1.0 ELSE 0.0 END + 2.0 * CASE WHEN contains(text, '!!') THEN 0.0 ELSE 1.0 END + 1.5 * quality)::DOUBLE / 4.5 * 10000 + 0.5) / 10000 AS quality
        FROM documents JOIN labels USING (doc_id)""",
    "eval_summary": f"WITH {_E} SELECT * FROM s",
    "eval_winner": f"WITH {_E} SELECT variant, quality, cost FROM s WHERE quality >= (SELECT max(quality) FROM s) - 0.02 ORDER BY cost, latency, variant LIMIT 1",
    "compare_variants": f"""WITH {_E}, u AS (SELECT variant, 'quality' AS metric, quality AS value FROM s UNION ALL SELECT variant, 'pass_rate', pass_rate FROM s UNION ALL SELECT variant, 'latency', latency FROM s UNION ALL SELECT variant, 'cost', cost FROM s)
        SELECT *, value = CASE WHEN metric IN ('quality', 'pass_rate') THEN max(value) OVER (PARTITION BY metric) ELSE min(value) OVER (PARTITION BY metric) END AS better FROM u""",
    "monthly_cost": f"WITH {_E} SELECT variant, round(cost / cases * 1000 * 30, 4) AS monthly FROM s",
}
