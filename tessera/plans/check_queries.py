"""Queries of snapshots within limits, schemas, nested redaction and supporting baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import memory as M
from tessera.sources.tables import read

_PATH = "CASE doc_id % 6 WHEN 0 THEN 'a/b/c/d/' WHEN 1 THEN 'a/b/' WHEN 2 THEN 'src/' WHEN 3 THEN '' WHEN 4 THEN 'a/b/c/d/e/' ELSE 'z/' END || 'f' || doc_id"
_MOST = {"files": 30, "file_bytes": 6000, "total_bytes": 30_000, "depth": 4}


def _files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = docs.select(F.col("source").alias("repo"), F.concat(F.lit("./"), F.expr(_PATH)).alias("path"), "text", "doc_id")
    return C.entries(rows).withColumn("binary", F.regexp_extract("path", "([0-9]+)$", 1).cast("long") % 13 == 0)


def snapshot_files(spark, sf_dir):
    """Documents as files of their source, as a scan with small limits keeps them."""
    kept = C.within_limits(_files(spark, sf_dir), limits=_MOST)
    return kept.select("repo", "path", "bytes", "binary", F.length("text").alias("chars"), "truncated")


def snapshot_totals(spark, sf_dir):
    files = _files(spark, sf_dir)
    return C.snapshot_stats(files, C.within_limits(files, limits=_MOST))


#: Constraints on what events send, by path.
SCHEMA = {
    "type": "object",
    "required": ["type", "at", "note"],
    "properties": {
        "type": {"type": "string", "enum": ["view", "click", "signup", "purchase"], "minLength": 4},
        "at": {"type": "object", "required": ["user"], "properties": {"user": {"type": "integer", "maximum": 120}, "value": {"type": "number", "minimum": 2}}},
        "props": {"type": "object", "properties": {"k": {"type": ["integer", "null"], "minimum": 10}}},
        "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 6}},
    },
}
_SENT = """concat('{"type": "', event_type, '", "at": {', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('"user": ', user_id, CASE WHEN event_id % 5 = 0 THEN '.5' ELSE '' END, ', ') END, '"value": ', value,
    '}, "props": ', props, ', "tags": [', CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"new", "Old"' WHEN 2 THEN '"letters", 3' ELSE '"a"' END, ']', CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "note": null' END, '}')"""


def schema_problems(spark, sf_dir):
    """Every problem of what events send against nested constraints, with its path."""
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_SENT).alias("sent"))
    return C.schema_problems(rows, "event_id", "sent", SCHEMA)


def redact_nested(spark, sf_dir):
    """Events with tokens and passwords inside structs, arrays and maps, covered."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    auth = F.struct(F.concat(F.lit("t"), "event_id").alias("token"), F.struct(F.col("user_id").alias("id"), F.lit("x").alias("apiKey")).alias("user"))
    nested = events.select("event_id", auth.alias("auth"), F.array(F.struct(F.col("event_type").alias("name"), F.lit("p").alias("password"))).alias("items"), F.from_json("props", "map<string,string>").alias("props"), F.create_map(F.lit("session_id"), F.lit("s"), F.lit("kind"), F.col("event_type")).alias("extra"))
    shown = C.redacted_rows(nested)
    return shown.select("event_id", F.to_json(F.struct("auth", "items", "props", "extra")).alias("json"))


def basket_support(spark, sf_dir):
    """Which orders support each pair of brands."""
    items = read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_partkey").alias("p_partkey"))
    brands = items.join(read(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_brand")
    return M.basket_pairs(brands, "l_orderkey", "p_brand")


QUERIES = {f.__name__: f for f in (snapshot_files, snapshot_totals, schema_problems, redact_nested, basket_support)}

_F = f"""f AS (SELECT source AS repo, {_PATH} AS path, strlen(coalesce(text, '')) AS bytes, doc_id % 13 = 0 AS bin, text FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY len(string_split(path, '/')), path) AS place FROM f WHERE len(string_split(path, '/')) <= 5),
    s AS (SELECT *, coalesce(sum(CASE WHEN bytes <= 6000 AND NOT bin THEN bytes ELSE 0 END) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM n WHERE place <= 30),
    k AS (SELECT *, bytes > 6000 OR spent >= 30000 AS truncated FROM s)"""
_E = "e AS (SELECT event_id AS i, event_type AS t, user_id AS u, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
ORACLES = {
    "snapshot_files": f"WITH {_F} SELECT repo, path, bytes, bin AND NOT truncated AS binary, CASE WHEN NOT truncated AND NOT bin THEN length(text) END::INTEGER AS chars, truncated FROM k",
    "snapshot_totals": f"""WITH {_F}, a AS (SELECT repo, count(*) AS total_files FROM f GROUP BY repo), b AS (SELECT repo, count(*) AS included, count(*) FILTER (truncated) AS skipped, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM k GROUP BY repo)
        SELECT repo, total_files, coalesce(included, 0) AS included, coalesce(skipped, 0) AS skipped, coalesce(total_bytes, 0) AS total_bytes, coalesce(skipped, 0) > 0 OR coalesce(included, 0) < total_files AS partial FROM a LEFT JOIN b USING (repo)""",
    "schema_problems": f"""WITH {_E} SELECT i AS event_id, 'body.note' AS field, 'is required' AS message FROM e WHERE i % 3 = 0
        UNION ALL SELECT i, 'body.type', 'must be one of: view, click, signup, purchase' FROM e WHERE t = 'error' UNION ALL SELECT i, 'body.at.user', 'is required' FROM e WHERE i % 7 = 0
        UNION ALL SELECT i, 'body.at.user', 'expected integer, received number' FROM e WHERE i % 7 <> 0 AND i % 5 = 0 UNION ALL SELECT i, 'body.at.user', 'must be <= 120' FROM e WHERE i % 7 <> 0 AND i % 5 <> 0 AND u > 120
        UNION ALL SELECT i, 'body.at.value', 'must be >= 2' FROM e WHERE v < 2 UNION ALL SELECT i, 'body.props.k', 'must be >= 10' FROM e WHERE k < 10
        UNION ALL SELECT i, 'body.tags[1]', 'must match ^[a-z]+$' FROM e WHERE i % 4 = 1 UNION ALL SELECT i, 'body.tags[0]', 'must be at most 6 characters' FROM e WHERE i % 4 = 2 UNION ALL SELECT i, 'body.tags[1]', 'expected string, received number' FROM e WHERE i % 4 = 2""",
    "redact_nested": """SELECT event_id, '{"auth":{"token":"[redacted]","user":{"id":' || user_id || ',"apiKey":"[redacted]"}},"items":[{"name":"' || event_type || '","password":"[redacted]"}],"props":{"k":"'
        || json_extract_string(props, '$.k') || '"},"extra":{"session_id":"[redacted]","kind":"' || event_type || '"}}' AS json FROM events""",
    "basket_support": """WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT x.p_brand AS a, y.p_brand AS b, l_orderkey FROM b x JOIN b y USING (l_orderkey) WHERE x.p_brand < y.p_brand""",
}
