"""Queries over lines, metrics and rollups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import lines as L
from tessera.sources.tables import read


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents", "doc_id", "text", *columns)


def line_counts(spark, sf_dir):
    return L.line_counts(L.lines(_docs(spark, sf_dir)))


def language_share(spark, sf_dir):
    docs = _docs(spark, sf_dir, "lang")
    counts = L.line_counts(L.lines(docs))
    per = docs.select("doc_id", "lang", F.octet_length("text").alias("bytes")).join(counts, "doc_id")
    out = per.groupBy("lang").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank", "bytes")])
    total = F.sum("code").over(Window.partitionBy())
    return out.withColumn("share", F.floor(F.col("code") / total * 1000 + 0.5) / 10)


def code_metrics(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "html")
    counts = L.line_counts(L.lines(pages, "page_id", "html"), "page_id")
    own = pages.select("page_id", L.complexity(F.col("html")).alias("complexity"), L.nesting(F.col("html")).alias("nesting"))
    ratio = F.col("comment") / F.greatest(F.col("code") + F.col("comment"), F.lit(1))
    score = L.maintainability(F.col("code"), F.col("complexity"), ratio, F.col("nesting"))
    return own.join(counts, "page_id").select("page_id", "complexity", "nesting", "code", F.round(score, 4).alias("maintainability"))


def path_rollup(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "url", "html")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    each = pages.select(F.octet_length("html").alias("bytes"), F.explode(L.ancestors(path)).alias("directory"))
    return each.groupBy("directory").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def repo_overview(spark, sf_dir):
    docs = _docs(spark, sf_dir, "source", "lang")
    counts = L.line_counts(L.lines(docs))
    facts = docs.select("doc_id", "source", F.octet_length("text").alias("bytes"), F.col("text").rlike("(?i)licen[sc]ed? under").alias("licence")).join(counts, "doc_id")
    main = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.max(F.struct("n", "lang"))["lang"].alias("primary_lang"))
    out = facts.groupBy("source").agg(
        F.count("*").alias("files"), F.sum("total").alias("lines"), F.sum("bytes").alias("bytes"), F.bool_or("licence").alias("has_licence"),
        F.round(F.sum("comment") / F.greatest(F.sum("code") + F.sum("comment"), F.lit(1)), 6).alias("comment_ratio"),
    )
    return out.join(main, "source")


def hotspots(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_quantity", "l_returnflag")
    per = items.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("fan_in"), F.sum("l_quantity").alias("loc"), F.max("l_quantity").alias("complexity"))
    top = L.hotspots(per, "l_returnflag", "l_suppkey", {"complexity": 0.5, "fan_in": 0.3, "loc": 0.2})
    return top.select("l_returnflag", "l_suppkey", "score", "rank")


def duplicate_blocks(spark, sf_dir):
    return L.duplicate_blocks(L.lines(_docs(spark, sf_dir)), window=3).groupBy("block").agg(
        F.count("*").alias("sites"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("occurrences").alias("occurrences")
    )


def marker_findings(spark, sf_dir):
    """Markers with what follows them, one row for each marked line."""
    ls = L.lines(_docs(spark, sf_dir))
    found = F.regexp_extract("line", "\\b(Licensed|License|licensed|Copyright|reserved|token)\\b[: -]*(.{0,40})", 1)
    severity = F.when(found.isin("token"), "high").when(found.isin("Copyright", "reserved"), "medium").otherwise("low")
    return ls.where(found != "").select("doc_id", "line_no", F.upper(found).alias("marker"), severity.alias("severity"))


def size_outliers(spark, sf_dir):
    """Documents by rules on size, the gravest that holds."""
    counts = L.line_counts(L.lines(_docs(spark, sf_dir)))
    rule = F.when(F.col("total") > 60, "oversize").when(F.col("total") > 25, "large").when(F.col("blank") * 2 > F.col("total"), "hollow")
    return counts.select("doc_id", "total", rule.alias("rule")).where("rule is not null")


QUERIES = {f.__name__: f for f in (line_counts, language_share, code_metrics, path_rollup, repo_overview, hotspots, duplicate_blocks, marker_findings, size_outliers)}

_CLASS = "CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(//|#|\\*|<!--|--)') THEN 'comment' ELSE 'code' END"


def _lines(table: str, key: str, text: str) -> str:
    body = f"CASE WHEN right(coalesce({text}, ''), 1) = chr(10) THEN left({text}, length({text}) - 1) ELSE coalesce({text}, '') END"
    return f"""ls0 AS (SELECT {key}, string_split({body}, chr(10)) AS parts FROM {table}),
    ls AS (SELECT {key}, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM ls0),
    lc AS (SELECT {key}, count(*) AS total, count(*) FILTER ({_CLASS} = 'code') AS code, count(*) FILTER ({_CLASS} = 'comment') AS comment,
           count(*) FILTER ({_CLASS} = 'blank') AS blank FROM ls GROUP BY {key})"""


_D = _lines("documents", "doc_id", "text")
ORACLES = {
    "line_counts": f"WITH {_D} SELECT * FROM lc",
    "language_share": f"""WITH {_D}, g AS (SELECT lang, count(*) AS files, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment,
        CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents JOIN lc USING (doc_id) GROUP BY lang)
        SELECT *, floor(code / sum(code) OVER () * 1000 + 0.5) / 10 AS share FROM g""",
    "path_rollup": """WITH p AS (SELECT strlen(html) AS bytes, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages),
        e AS (SELECT bytes, unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS directory FROM p)
        SELECT coalesce(directory, '') AS directory, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files FROM e GROUP BY 1""",
    "repo_overview": f"""WITH {_D}, n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
        m AS (SELECT source, arg_max(lang, (n, lang)) AS primary_lang FROM n GROUP BY source)
        SELECT source, count(*) AS files, CAST(sum(total) AS BIGINT) AS lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
          bool_or(regexp_matches(text, '(?i)licen[sc]ed? under')) AS has_licence,
          round(sum(comment) / greatest(sum(code) + sum(comment), 1), 6) AS comment_ratio, any_value(primary_lang) AS primary_lang
        FROM documents JOIN lc USING (doc_id) JOIN m USING (source) GROUP BY source""",
    "hotspots": """WITH p AS (SELECT l_returnflag, l_suppkey, count(*) AS fan_in, sum(l_quantity) AS loc, max(l_quantity) AS cx FROM lineitem GROUP BY ALL),
        s AS (SELECT *, round((0.5 * cx / greatest(max(cx) OVER w, 1) + 0.3 * fan_in / greatest(max(fan_in) OVER w, 1) + 0.2 * loc / greatest(max(loc) OVER w, 1)) * 100, 4) AS score
              FROM p WINDOW w AS (PARTITION BY l_returnflag)),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_suppkey) AS rank FROM s)
        SELECT l_returnflag, l_suppkey, score, rank FROM r WHERE rank <= 25""",
    "duplicate_blocks": f"""WITH {_D}, n0 AS (SELECT doc_id, line_no, trim(line) AS t FROM ls WHERE length(trim(line)) >= 12),
        n AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(t, '["''`][^"''`]*["''`]', 'S', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', 'N', 'g'), '\\s+', ' ', 'g') AS n FROM n0),
        w AS (SELECT doc_id, line_no, n, lead(n, 1) OVER x AS n1, lead(n, 2) OVER x AS n2 FROM n WINDOW x AS (PARTITION BY doc_id ORDER BY line_no)),
        b AS (SELECT doc_id, line_no, md5(n || chr(10) || n1 || chr(10) || n2) AS block FROM w WHERE n2 IS NOT NULL),
        a AS (SELECT *, lag(line_no) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS before FROM b),
        k AS (SELECT * FROM a WHERE before IS NULL OR line_no - before >= 3)
        SELECT block, count(*) AS sites, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, count(*) AS occurrences FROM k GROUP BY block HAVING count(*) >= 2""",
    "marker_findings": f"""WITH {_D}, f AS (SELECT doc_id, line_no, regexp_extract(line, '\\b(Licensed|License|licensed|Copyright|reserved|token)\\b[: -]*(.{{0,40}})', 1) AS m FROM ls)
        SELECT doc_id, line_no, upper(m) AS marker, CASE WHEN m = 'token' THEN 'high' WHEN m IN ('Copyright', 'reserved') THEN 'medium' ELSE 'low' END AS severity FROM f WHERE m <> ''""",
    "size_outliers": f"""WITH {_D}, r AS (SELECT doc_id, total, CASE WHEN total > 60 THEN 'oversize' WHEN total > 25 THEN 'large' WHEN blank * 2 > total THEN 'hollow' END AS rule FROM lc)
        SELECT * FROM r WHERE rule IS NOT NULL""",
}
