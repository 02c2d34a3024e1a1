"""Queries of source-like rows that the given tables hold or spell out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code as K
from tessera.operators import findings as R
from tessera.operators.lines import lines
from tessera.sources.tables import read

_EXT = "CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.min.ts' WHEN 'de' THEN '' ELSE '.md' END"
_PATH = f"source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'Dockerfile' ELSE 'doc' || doc_id END || {_EXT}"
IGNORE = ["src1*/", "!src12/", "*.md"]


def _files(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"), "text")


def language_detection(spark, sf_dir):
    got = K.with_language(_files(spark, sf_dir))
    return got.groupBy("language", "category").agg(F.count("*").alias("files"))


def ignored_paths(spark, sf_dir):
    out = _files(spark, sf_dir).withColumn("ignored", K.ignored(F.col("path"), IGNORE))
    return out.groupBy(F.split("path", "/")[0].alias("folder")).agg(F.count_if("ignored").alias("ignored"), F.count("*").alias("files"))


def html_comments(spark, sf_dir):
    """Pages' length without comments; quoted text is left alone."""
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    left = K.without_comments(F.col("html"), "html")
    return pages.select("page_id", F.length("html").alias("chars"), F.regexp_count(left, F.lit("<!--")).alias("left"))


def external_packages(spark, sf_dir):
    """The leading segment of pages' links as a package, how often and on how many pages."""
    links = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("s"))
    return links.select("page_id", K.package_name(F.col("s")).alias("package")).where("package is not null").groupBy("package").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))


_REQ = "lower(replace(p_name, ' ', '-')) || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '[extra]' ELSE ' ' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE '>=' || p_size || '.1 ; python' END"


def manifest_deps(spark, sf_dir):
    """Parts as lines of a manifest for each brand."""
    ls = read(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line_no"), F.expr(_REQ).alias("line"))
    got = K.line_dependencies(ls)
    return got.groupBy("path", "name").agg(F.count("*").alias("lines"), F.max("range").alias("range"))


def env_vars(spark, sf_dir):
    """Names in capitals in documents against those in conversations: where each is and is not."""
    found = lambda t, c: t.select(F.explode(F.regexp_extract_all(c, F.lit("([A-Z]{6,})"), F.lit(1))).alias("name"))
    used = found(read(spark, sf_dir, "documents", "text"), "text").groupBy("name").agg(F.count("*").alias("used"))
    known = found(read(spark, sf_dir, "conversations", "text"), "text").groupBy("name").agg(F.count("*").alias("known"))
    both = used.join(known, "name", "full_outer")
    return both.select("name", F.col("used").isNotNull().alias("in_code"), F.col("known").isNotNull().alias("documented"), F.coalesce("used", F.lit(0)).alias("uses"))


def _paths(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", F.col("page_id").alias("request_id"), "url")
    return pages.select("request_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).where("path <> ''")


def route_match(spark, sf_dir):
    """Every page's path with the template that fits it."""
    paths = _paths(spark, sf_dir)
    return K.match_routes(paths, paths.select(K.route_template(F.col("path")).alias("template")).distinct())


_DDL = """'CREATE TABLE c' || c_custkey || ' (id BIGINT PRIMARY KEY, nation INT REFERENCES nation(n_nationkey), name VARCHAR(25) UNIQUE, balance DECIMAL(10,' || c_nationkey % 4 || '), CHECK (id > 0))'"""


def ddl_catalog(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_DDL).alias("ddl"))
    got = K.table_definitions(rows, "c_custkey")
    return got.groupBy("column", "type", "role", "refers_to").agg(F.count("*").alias("tables"), F.max("entity").alias("last_entity"))


def _diffs(spark, sf_dir):
    """Documents as diffs: every third line removed, every second of the rest added."""
    ls = lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    body = ls.select("doc_id", (F.col("line_no") + 3).alias("line_no"), F.concat(F.when(F.col("line_no") % 3 == 0, "-").when(F.col("line_no") % 2 == 0, "+").otherwise(" "), "line").alias("line"))
    heads = ls.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(t).alias("line")) for i, t in ((1, "--- a/doc.txt"), (2, "+++ b/doc.txt"), (3, "@@ -1,9 +10,9 @@"))])).alias("h"))
    return body.unionByName(heads.select("doc_id", "h.line_no", "h.line"))


def diff_summary(spark, sf_dir):
    got = K.diff_lines(_diffs(spark, sf_dir), "doc_id")
    return got.groupBy("doc_id", "file").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("add", "remove", "context")], F.max("new_line").alias("last_line"))


def review_added_lines(spark, sf_dir):
    """Findings on added lines alone, with a risk and a verdict for each document that has one."""
    added = K.diff_lines(_diffs(spark, sf_dir), "doc_id").where("kind = 'add'").select("doc_id", F.col("new_line").alias("line_no"), F.col("text").alias("line"))
    found = R.secrets(added)
    weight = R.by_weight(F.col("severity"), {"critical": 25, "high": 8, "medium": 2, "low": 1})
    out = found.groupBy("doc_id").agg(F.least(F.sum(weight), F.lit(100)).alias("risk"), F.count("*").alias("comments"), F.min("line_no").alias("first_line"))
    return out.withColumn("verdict", F.when(F.col("risk") >= 25, "request-changes").when(F.col("risk") >= 8, "comment").otherwise("approve"))


QUERIES = {f.__name__: f for f in (language_detection, ignored_paths, html_comments, external_packages, manifest_deps, env_vars, route_match, ddl_catalog, diff_summary, review_added_lines)}

_DIFF = """l0 AS (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS n, unnest(parts) AS line FROM l0),
    k AS (SELECT doc_id, n, line, CASE WHEN n % 3 = 0 THEN 'remove' WHEN n % 2 = 0 THEN 'add' ELSE 'context' END AS kind FROM l),
    d AS (SELECT *, 9 + count(*) FILTER (kind <> 'remove') OVER (PARTITION BY doc_id ORDER BY n) AS new_line FROM k)"""


def _secrets_on_added() -> str:
    from tessera.plans.findings_queries import _secret_sql

    return f"ls AS (SELECT doc_id, new_line AS line_no, line FROM d WHERE kind = 'add'), sec AS ({_secret_sql()})"


ORACLES = {
    "language_detection": f"""WITH f AS (SELECT lower(string_split({_PATH}, '/')[-1]) AS b FROM documents),
        g AS (SELECT CASE WHEN string_split(b, '.')[1] = 'dockerfile' THEN 'dockerfile' WHEN b LIKE '%.py' THEN 'python' WHEN b LIKE '%.ts' THEN 'typescript' WHEN b LIKE '%.md' THEN 'markdown' END AS language FROM f)
        SELECT language, CASE language WHEN 'dockerfile' THEN 'data' WHEN 'markdown' THEN 'prose' WHEN 'python' THEN 'programming' WHEN 'typescript' THEN 'programming' END AS category, count(*) AS files FROM g GROUP BY ALL""",
    "ignored_paths": f"""WITH f AS (SELECT source AS folder, {_PATH} AS path FROM documents)
        SELECT folder, count(*) FILTER (path LIKE '%.md' OR (folder LIKE 'src1%' AND folder <> 'src12')) AS ignored, count(*) AS files FROM f GROUP BY folder""",
    "external_packages": """WITH l AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)), '^node:', '') AS s FROM pages),
        p AS (SELECT page_id, regexp_extract(s, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package FROM l WHERE NOT regexp_matches(s, '^[./]'))
        SELECT package, count(*) AS uses, count(DISTINCT page_id) AS pages FROM p GROUP BY package""",
    "manifest_deps": """SELECT p_brand AS path, lower(replace(p_name, ' ', '-')) AS name, count(*) AS lines, max(CASE WHEN p_size % 5 = 0 THEN '' ELSE '>=' || p_size || '.1' END) AS range FROM part GROUP BY ALL""",
    "env_vars": """WITH u AS (SELECT name, count(*) AS used FROM (SELECT unnest(regexp_extract_all(text, '([A-Z]{6,})', 1)) AS name FROM documents) GROUP BY name),
        k AS (SELECT name, count(*) AS known FROM (SELECT unnest(regexp_extract_all(text, '([A-Z]{6,})', 1)) AS name FROM conversations) GROUP BY name)
        SELECT name, used IS NOT NULL AS in_code, known IS NOT NULL AS documented, coalesce(used, 0) AS uses FROM u FULL OUTER JOIN k USING (name)""",
    "route_match": """WITH p AS (SELECT page_id AS request_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages), q AS (SELECT * FROM p WHERE path <> ''),
        t AS (SELECT DISTINCT array_to_string(list_transform(string_split(regexp_replace(path, '\\{([^}]+)\\}|<(?:[a-z]+:)?([^>]+)>|\\[(?:\\.\\.\\.)?([^\\]]+)\\]', ':id', 'g'), '/'),
          lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|[0-9a-f]{16,}') THEN ':id' ELSE s END), '/') AS template FROM q),
        m AS (SELECT request_id, template, row_number() OVER (PARTITION BY request_id ORDER BY len(regexp_extract_all(template, ':[a-z]+')), -length(template), template) AS n
          FROM q JOIN t ON regexp_full_match(path, regexp_replace(template, ':[a-z]+', '[^/]+', 'g')))
        SELECT request_id, path, template FROM q LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (request_id)""",
    "ddl_catalog": """WITH c AS (SELECT 'c' || c_custkey AS e FROM customer), r("column", "type", role, refers_to) AS (VALUES ('id', 'bigint', 'PK', NULL), ('nation', 'int', 'FK', 'nation'), ('name', 'varchar', 'UK', NULL), ('balance', 'decimal', NULL, NULL))
        SELECT "column", "type", role, refers_to, count(*) AS tables, max(e) AS last_entity FROM c, r GROUP BY ALL""",
    "diff_summary": f"WITH {_DIFF} SELECT doc_id, 'doc.txt' AS file, count(*) FILTER (kind = 'add') AS add, count(*) FILTER (kind = 'remove') AS remove, count(*) FILTER (kind = 'context') AS context, max(CASE WHEN kind <> 'remove' THEN new_line END) AS last_line FROM d GROUP BY doc_id",
    "review_added_lines": f"""WITH {_DIFF}, {_secrets_on_added()}, g AS (SELECT doc_id, CAST(least(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 8 WHEN 'medium' THEN 2 ELSE 1 END), 100) AS BIGINT) AS risk, count(*) AS comments, min(line_no) AS first_line FROM sec GROUP BY doc_id)
        SELECT *, CASE WHEN risk >= 25 THEN 'request-changes' WHEN risk >= 8 THEN 'comment' ELSE 'approve' END AS verdict FROM g""",
}
