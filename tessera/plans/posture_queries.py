"""Queries over one table of findings of every kind, and over what repositories are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import code as K
from tessera.operators import overview as O
from tessera.operators import posture as P
from tessera.operators import rules as R
from tessera.plans import audit_queries as Q
from tessera.sources.tables import read
from tessera.streaming import jobs

_PATH = "'r' || o_custkey % 20 || '/f' || o_orderkey || CASE " + Q._CODE_LANG + " WHEN 'python' THEN '.py' ELSE '.ts' END"


def _repos(spark, sf_dir):
    return read(spark, sf_dir, "customer", "c_custkey").select(F.concat(F.lit("r"), F.col("c_custkey") % 25).alias("repo")).distinct()


def all_findings(spark, sf_dir):
    """Secrets and insecure code in what orders add, environment files of customers' trees, and vulnerable parts."""
    added = read(spark, sf_dir, "orders").select(F.expr("'r' || o_custkey % 20").alias("repo"), F.expr(_PATH).alias("path"), F.expr(Q._CODE_LANG).alias("language"), F.expr(Q._ADDED_TEXT).alias("text"))
    scanned = jobs.scan_added(added, "repo").where("kind <> 'injection'")
    lines = scanned.withColumn("place", F.concat_ws(":", "path", "line_no")).withColumn("confidence", F.when(F.col("kind") == "secret", F.when(F.col("rule") == "hex-token", "high").otherwise("medium")))
    trees = read(spark, sf_dir, "customer", "c_custkey").select(F.expr("'r' || c_custkey % 20 || '/' || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 20 < 12 THEN '.env' ELSE 'a.ts' END").alias("path")).distinct()
    env = A.env_files(trees, K.ignored(F.col("path"), [])).select(F.substring_index("path", "/", 1).alias("repo"), F.lit("env").alias("kind"), F.lit("env-file").alias("rule"), F.col("path").alias("place"))
    part = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    matched = Q.advisory_ranges(spark, sf_dir).select(
        F.concat(F.lit("r"), part % 20).alias("repo"), F.lit("dependency").alias("kind"), F.col("advisory").alias("rule"), "severity", F.col("name").alias("place"), "match_kind", F.when(part % 4 == 0, "9.9.9").alias("fix")
    )
    return P.finding_table(lines, env, matched)


def finding_rows(spark, sf_dir):
    return all_findings(spark, sf_dir)


def posture_all(spark, sf_dir):
    """Posture of every repository, those without a finding included."""
    return P.posture_report(all_findings(spark, sf_dir), _repos(spark, sf_dir))


def compliance_all(spark, sf_dir):
    """Sixteen controls for every repository."""
    return P.compliance_report(all_findings(spark, sf_dir), _repos(spark, sf_dir))


def remediation_all(spark, sf_dir):
    plan = P.remediation_plan(all_findings(spark, sf_dir))
    return plan.select("repo", "priority", "step", "n", F.size("affected").alias("places"), F.get("affected", F.lit(0)).alias("first"), "effort")


_FILE = "'f' || o_orderkey"


def _measured(spark, sf_dir):
    """Files and functions with measures that orders spell, and each file's repository."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("*", F.expr(_FILE).alias("path"), F.expr("'r' || o_custkey % 20").alias("repo"))
    files = rows.select("repo", "path", (F.col("o_orderkey") % 1500).alias("code"), (F.col("o_orderkey") % 40).alias("comment"), (F.col("o_orderkey") * 7 % 400).alias("complexity"), (F.col("o_custkey") % 9).alias("nesting"), (F.col("o_orderkey") % 11 == 0).alias("is_test"))
    functions = rows.where("o_orderkey % 2 = 0").select("path", F.lit("go").alias("name"), (F.col("o_orderkey") % 50).alias("complexity"), (F.col("o_orderkey") % 200).alias("lines"), (F.col("o_custkey") % 9).alias("parameters"))
    return files, functions


def rule_findings(spark, sf_dir):
    """Rules on files and functions; a file's finding gives way to one of its functions in the same category."""
    files, functions = _measured(spark, sf_dir)
    own = R.function_rules(functions)
    kept = R.unless_function_found(R.file_rules(files), own)
    undocumented = R.undocumented(files).select("path", F.lit("undocumented").alias("rule"), F.lit("documentation").alias("category"), F.lit("low").alias("severity"))
    return kept.select("path", "rule", "category", "severity").unionByName(own.drop("name")).unionByName(undocumented)


def debt_by_repo(spark, sf_dir):
    files, _ = _measured(spark, sf_dir)
    found = rule_findings(spark, sf_dir).join(files.select("path", "repo"), "path")
    got = P.debt_report(found, files.groupBy("repo").agg(F.sum("code").alias("code")))
    counts = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return got.withColumn("by_category", counts)


_LAYOUT = "CASE doc_id % 8 WHEN 0 THEN 'README.md' WHEN 1 THEN 'src/a.test.ts' WHEN 2 THEN '.github/workflows/ci.yml' WHEN 3 THEN 'docker/Dockerfile' WHEN 4 THEN 'LICENSE' ELSE 'src/f' || doc_id || '.ts' END"


def tree_facts(spark, sf_dir):
    """What each repository's tree shows: documents as files, by language and remainder as repositories."""
    files = read(spark, sf_dir, "documents", "doc_id", "lang", "text").select(F.expr("lang || doc_id % 37").alias("repo"), F.expr(_LAYOUT).alias("path"), F.octet_length("text").cast("long").alias("bytes"))
    return O.tree_facts(files)


def repo_descriptions(spark, sf_dir):
    """Each document's own repository: described by its manifest, by its README, or not at all."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    head = F.concat(F.lit("# Title\n\n![x](y)\n[![b]](c)\n"), F.when(F.col("doc_id") % 4 == 1, "> ").otherwise(""), "text")
    files = docs.select(F.col("doc_id").alias("repo"), F.when(F.col("doc_id") % 4 != 3, "readme.md").otherwise("docs/readme.md").alias("path"), head.alias("text"))
    manifests = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("repo"), F.explode(F.array(F.struct(F.lit("a/package.json").alias("path"), F.lit("deep").alias("description")), F.struct(F.lit("package.json").alias("path"), F.concat(F.lit("about "), "doc_id").alias("description")), F.struct(F.lit("b.json").alias("path"), F.lit("").alias("description")))).alias("m")).select("repo", "m.*")
    return O.described(files, manifests)


def stack_lines(spark, sf_dir):
    """The surest framework, interface and database of each supplier's parts."""
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    kinds = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'framework' WHEN 1 THEN 'ui' WHEN 2 THEN 'database' ELSE 'other' END")
    found = items.where("l_suppkey % 10 <> 0 or l_partkey % 4 = 3").select(F.col("l_suppkey").alias("repo"), F.concat(F.lit("t"), F.col("l_partkey") % 40).alias("name"), kinds.alias("category"), (F.col("l_partkey") % 7 / 10.0).alias("confidence"))
    return O.stack_summary(found, read(spark, sf_dir, "supplier", F.col("s_suppkey").alias("repo")))


def portfolio(spark, sf_dir):
    """Orders as analyses of customers' projects: totals of each segment over the latest ones."""
    orders, customers = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), read(spark, sf_dir, "customer", F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = orders.join(customers, "o_custkey").select(F.col("c_mktsegment").alias("workspace"), F.col("o_custkey").alias("project"), F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderkey") % 1000).alias("code"), (F.col("o_orderkey") % 101).cast("double").alias("health"), (F.col("o_orderkey") % 5).alias("critical"), (F.col("o_orderkey") % 3).alias("cycles"))
    return O.portfolio(rows)


def reached_nodes(spark, sf_dir):
    """Lines of orders as nodes that lead to the next line and to the one of twice their number; returned ones failed."""
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").dropDuplicates(["l_orderkey", "l_linenumber"])
    traces = items.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("node"), F.when(F.col("l_linenumber") % 3 == 0, "failed").otherwise("succeeded").alias("status"))
    edges = items.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("src"), F.explode(F.array(F.col("l_linenumber") + 1, F.col("l_linenumber") * 2)).alias("dst"))
    got = O.reached(traces, edges)
    return got.groupBy("run").agg(F.count("*").alias("nodes"), F.count_if("reached").alias("reached"), F.count_if(~F.col("reached")).alias("skipped"))


_ASK = "CASE conv_id % 9 WHEN 0 THEN 'How to deploy ' WHEN 1 THEN 'Show ' WHEN 2 THEN 'A vs. B: ' WHEN 3 THEN 'Summarize: ' WHEN 4 THEN 'What does it mean? ' WHEN 5 THEN 'but why ' WHEN 6 THEN 'please draft, ' WHEN 7 THEN 'Rewritten lists ' ELSE 'What is better? ' END"


def intent_classes(spark, sf_dir):
    """Intents of what users ask, behind words that show one."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    asked = F.expr(_ASK)
    return turns.groupBy(O.intent(asked).alias("intent")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (finding_rows, posture_all, compliance_all, remediation_all, rule_findings, debt_by_repo, tree_facts, repo_descriptions, stack_lines, portfolio, reached_nodes, intent_classes)}

_F = f"""o AS (SELECT 'r' || o_custkey % 20 AS repo, {_PATH} AS path, {Q._CODE_LANG} AS language, o_orderkey % {len(Q.SNIPPETS)} AS k, o_custkey % 4 AS c FROM orders),
    f AS (SELECT repo, 'code' AS kind, rule, category, severity, path || ':1' AS place, NULL AS confidence, NULL AS match_kind, NULL AS fix FROM o JOIN (VALUES {", ".join(map(str, Q.LINE_HOLDS))}) AS h(k, rule, category, severity, languages) USING (k) WHERE languages = '' OR contains(languages, language)
      UNION ALL SELECT repo, 'secret', 'hex-token', 'secrets', 'critical', path || ':2', 'high', NULL, NULL FROM o WHERE c = 0
      UNION ALL SELECT DISTINCT 'r' || c_custkey % 20, 'env', 'env-file', NULL, NULL, 'r' || c_custkey % 20 || '/.env', NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 20 < 12
      UNION ALL SELECT 'r' || CAST(name[6:] AS BIGINT) % 20, 'dependency', advisory, NULL, severity, name, NULL, match_kind, CASE WHEN CAST(name[6:] AS BIGINT) % 4 = 0 THEN '9.9.9' END FROM ({Q.ORACLES["advisory_ranges"]})),
    rp AS (SELECT DISTINCT 'r' || c_custkey % 25 AS repo FROM customer)"""
_W = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 1 END"
_GRADE = "CASE WHEN score >= {} THEN 'A' WHEN score >= {} THEN 'B' WHEN score >= {} THEN 'C' WHEN score >= {} THEN 'D' ELSE 'F' END AS grade"
_CONTROL = {
    "A01": "rule IN ('any-origin', 'path-from-request')", "A02": "category IN ('crypto', 'transport')", "A03": "category IN ('injection', 'cross-site')", "A04": None, "A05": "kind = 'env' OR category = 'configuration'",
    "A06": "kind = 'dependency'", "A07": "rule IN ('open-cookie', 'unsigned-jwt')", "A08": "category = 'deserialisation'", "A09": None, "A10": None, "LLM01": "rule = 'prompt-from-input'", "LLM02": "rule = 'model-output-run'",
    "LLM06": "rule = 'key-in-browser'", "LLM08": "rule = 'endless-tools'", "CC6.1": "kind = 'secret' AND confidence <> 'low'", "CC7.1": "kind = 'dependency' AND severity IN ('critical', 'high')",
}
_M = """m AS (SELECT 'r' || o_custkey % 20 AS repo, 'f' || o_orderkey AS path, o_orderkey % 1500 AS code, o_orderkey % 40 AS comment, o_orderkey * 7 % 400 AS cx, o_custkey % 9 AS nest, o_orderkey % 11 = 0 AS test, o_orderkey % 2 = 0 AS fn, o_orderkey % 50 AS fcx, o_orderkey % 200 AS fl FROM orders),
    g AS (SELECT path, 'function-complexity' AS rule, 'complexity' AS category, CASE WHEN fcx > 40 THEN 'critical' WHEN fcx > 28 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE fn AND fcx > 20
      UNION ALL SELECT path, 'function-length', 'size', 'medium' FROM m WHERE fn AND fl > 120 UNION ALL SELECT path, 'parameters', 'complexity', 'low' FROM m WHERE fn AND nest > 6),
    h AS (SELECT path, 'branch-density' AS rule, 'complexity' AS category, CASE WHEN cx / greatest(code, 1) > 0.35 THEN 'critical' ELSE 'high' END AS severity FROM m WHERE NOT test AND cx / greatest(code, 1) > 0.2 AND cx >= 40
      UNION ALL SELECT path, 'oversize', 'size', CASE WHEN code > 1200 THEN 'high' ELSE 'medium' END FROM m WHERE NOT test AND code > 600 UNION ALL SELECT path, 'nesting', 'complexity', 'medium' FROM m WHERE NOT test AND nest > 5),
    a AS (SELECT * FROM g UNION ALL SELECT * FROM h WHERE (path, category) NOT IN (SELECT path, category FROM g) UNION ALL SELECT path, 'undocumented', 'documentation', 'low' FROM m WHERE code >= 120 AND comment / (code + comment) < 0.03)"""
ORACLES = {
    "finding_rows": f"WITH {_F} SELECT * FROM f",
    "posture_all": f"""WITH {_F}, p AS (SELECT repo, count(*) FILTER (severity = 'critical' OR kind = 'env') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
        sum(CASE WHEN kind = 'env' THEN 40.0::DOUBLE ELSE {_W} * CASE WHEN kind = 'dependency' AND match_kind <> 'exact' THEN 0.6::DOUBLE ELSE 1 END END) AS penalty FROM f GROUP BY repo),
        s AS (SELECT repo, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, round(coalesce(penalty, 0.0), 4)::DOUBLE AS penalty, floor(4500 / (coalesce(penalty, 0.0) + 45) * 10 + 0.5) / 10 AS score FROM rp LEFT JOIN p USING (repo))
        SELECT *, {_GRADE.format(90, 75, 55, 35)} FROM s""",
    "compliance_all": f"WITH {_F}, c AS ("
    + " UNION ALL ".join(
        f"SELECT repo, '{k}' AS control, '{'OWASP LLM Top 10' if k.startswith('LLM') else 'SOC 2' if k.startswith('CC') else 'OWASP Top 10'}' AS framework, {f'(SELECT count(*) FROM f WHERE f.repo = rp.repo AND ({w}))' if w else 'NULL'} AS n FROM rp" for k, w in _CONTROL.items()
    )
    + ") SELECT repo, control, framework, coalesce(n, 0) AS findings, CASE WHEN n IS NULL THEN 'not-assessed' WHEN n > 0 THEN 'fail' ELSE 'pass' END AS state FROM c",
    "remediation_all": f"""WITH {_F}, s AS (SELECT repo, place, unnest([CASE WHEN kind = 'secret' THEN '1rotate-secrets' WHEN kind = 'env' THEN '1untrack-env-files' WHEN kind = 'code' AND severity = 'critical' THEN '2fix-critical-code' WHEN kind = 'dependency' AND fix IS NOT NULL THEN '3upgrade-dependencies'
          WHEN kind = 'code' AND severity = 'high' THEN '4review-high-code' WHEN kind = 'dependency' THEN '5mitigate-dependencies' END]) AS x FROM f),
        g AS (SELECT repo, CAST(x[1] AS INTEGER) AS priority, x[2:] AS step, count(*) AS n, count(DISTINCT place)::INTEGER AS places, min(place) AS "first" FROM s WHERE x IS NOT NULL GROUP BY repo, x)
        SELECT *, CASE WHEN step IN ('rotate-secrets', 'untrack-env-files') OR (step = 'upgrade-dependencies' AND places <= 5) THEN 'small' WHEN step = 'mitigate-dependencies' THEN 'large' ELSE 'medium' END AS effort FROM g""",
    "rule_findings": f"WITH {_M} SELECT * FROM a",
    "debt_by_repo": f"""WITH {_M}, t AS (SELECT repo, sum(code)::BIGINT AS code FROM m GROUP BY repo), j AS (SELECT repo, category, severity FROM a JOIN m USING (path)),
        n AS (SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
          sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 8 WHEN 'medium' THEN 3 ELSE 1 END) AS penalty, sum(CASE severity WHEN 'critical' THEN 8.0::DOUBLE WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 0.5 END) AS hours FROM j GROUP BY repo),
        c AS (SELECT repo, string_agg(category || '=' || k, ' ' ORDER BY category) AS by_category FROM (SELECT repo, category, count(*) AS k FROM j GROUP BY ALL) GROUP BY repo),
        s AS (SELECT repo, code, critical, high, medium, low, by_category, floor(hours / 6 * 10 + 0.5) / 10 AS effort_days, floor(2200 / (penalty / (greatest(500, code) / 1000) + 22) * 10 + 0.5) / 10 AS score FROM t JOIN n USING (repo) JOIN c USING (repo))
        SELECT *, {_GRADE.format(90, 75, 60, 40)} FROM s""",
    "tree_facts": f"""WITH p AS (SELECT lang || doc_id % 37 AS repo, doc_id % 8 AS k, strlen(text) AS bytes FROM documents), s AS (SELECT repo, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (k = 1) AS test_files, bool_or(k = 0) AS has_readme, bool_or(k = 4) AS has_license,
        false AS has_contributing, bool_or(k = 2) AS has_ci, bool_or(k = 3) AS has_dockerfile FROM p GROUP BY repo) SELECT *, CASE WHEN files = test_files THEN 0.0 ELSE floor(test_files / (files - test_files) * 1000 + 0.5) / 1000 END AS test_ratio FROM s""",
    "repo_descriptions": """WITH d AS (SELECT doc_id AS repo, doc_id % 4 AS k, list_filter(list_transform(string_split(CASE WHEN doc_id % 4 = 1 THEN '> ' ELSE '' END || text, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')),
          lambda s: s <> '' AND NOT starts_with(s, '#') AND NOT starts_with(s, '!') AND NOT starts_with(s, '[![')) AS ls FROM documents)
        SELECT repo, CASE k WHEN 0 THEN 'about ' || repo WHEN 3 THEN '' ELSE coalesce(substr(regexp_replace(ls[1], '^[>*-][ \\t]*', ''), 1, 300), '') END AS description FROM d""",
    "stack_lines": """WITH t AS (SELECT l_suppkey AS repo, 't' || l_partkey % 40 AS name, l_partkey % 4 AS c, l_partkey % 7 AS sure FROM lineitem WHERE l_partkey % 4 < 3 AND l_suppkey % 10 <> 0),
        b AS (SELECT repo, c, name FROM t QUALIFY row_number() OVER (PARTITION BY repo, c ORDER BY sure DESC, name DESC) = 1), s AS (SELECT repo, string_agg(name, ' · ' ORDER BY c) AS stack FROM b GROUP BY repo)
        SELECT s_suppkey AS repo, coalesce(stack, 'No framework detected') AS stack FROM supplier LEFT JOIN s ON s_suppkey = repo""",
    "portfolio": """WITH l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey)
        SELECT c_mktsegment AS workspace, count(*) AS projects, sum(k % 1000)::BIGINT AS code, floor(avg(k % 101) * 10 + 0.5) / 10 AS mean_health, sum(k % 5)::BIGINT AS critical, sum(k % 3)::BIGINT AS cycles FROM l JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "reached_nodes": """WITH t AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS node FROM lineitem), e AS (SELECT run, node AS src, node + 1 AS dst FROM t UNION ALL SELECT run, node, 2 * node FROM t),
        i AS (SELECT run, dst AS node, bool_or(src % 3 <> 0) AS ok FROM e GROUP BY ALL) SELECT run, count(*) AS nodes, count(*) FILTER (coalesce(ok, true)) AS reached, count(*) FILTER (NOT coalesce(ok, true)) AS skipped FROM t LEFT JOIN i USING (run, node) GROUP BY run""",
    "intent_classes": """SELECT CASE conv_id % 9 WHEN 0 THEN 'howto' WHEN 1 THEN 'list' WHEN 2 THEN 'compare' WHEN 3 THEN 'summarise' WHEN 4 THEN 'define' WHEN 5 THEN 'explain' WHEN 6 THEN 'generate' WHEN 7 THEN 'unknown' ELSE 'compare' END AS intent,
        count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1""",
}
