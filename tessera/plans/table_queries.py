"""Queries of record tables, traces and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import tables as T
from tessera.sources.tables import read
from tessera.streaming import jobs


def upsert_latest(spark, sf_dir):
    """Orders with those of a later status written over."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    current = orders.withColumn("version", F.lit(1))
    changes = orders.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X")).withColumn("version", F.lit(2))
    return T.upsert(current, changes, "o_orderkey", "version")


def latest_per_key(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return T.latest(orders, "o_custkey", F.col("o_orderdate"), "o_orderkey", "o_orderstatus")


def newest_page(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").where("o_orderdate is not null")
    return T.page(orders, 100, 100, F.desc("o_orderdate"), F.col("o_orderkey"))


def version_history(spark, sf_dir):
    """Every customer's orders numbered from the newest."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version"))


def membership(spark, sf_dir):
    """Nations with a customer in debt."""
    nations = read(spark, sf_dir, "nation")
    return nations.join(read(spark, sf_dir, "customer", F.col("c_nationkey").alias("n_nationkey"), "c_acctbal").where("c_acctbal < 0"), "n_nationkey", "left_semi").select("n_nationkey", "n_name")


def cascade_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus").where("o_orderstatus = 'P'")
    left = T.cascade(read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity"), gone, "l_orderkey")
    return left.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


def retention(spark, sf_dir):
    """The newest 5000 events over all users, counted by user."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id")
    kept = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("newest"))


def partial_update(spark, sf_dir):
    rows = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    patch = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.max("o_totalprice") > 400000, "LARGE").alias("c_mktsegment"))
    return T.patched(rows, patch, "c_custkey")


def name_lookup(spark, sf_dir):
    return read(spark, sf_dir, "customer", "c_custkey", "c_name").where(F.lower("c_name") == "customer#000000007")


def threaded_listing(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "role", F.lag("role").over(w).alias("answers"))


def listing_enriched(spark, sf_dir):
    """Every customer with their latest order, where there is one."""
    last = T.latest(read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate"), "o_orderkey", "o_totalprice")
    return read(spark, sf_dir, "customer", "c_custkey", "c_name").join(last.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")


def run_summary(spark, sf_dir):
    """A run's events by status in columns, with its duration."""
    events = read(spark, sf_dir, "events")
    types = ["view", "signup", "error", "click", "purchase"]
    return events.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == t).alias(t) for t in types],
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).alias("ms"),
    )


def reached_after_error(spark, sf_dir):
    """Events whose user's event before succeeded, that is, was no error."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("event_type").over(w)
    return events.withColumn("reached", before.isNull() | (before != "error")).groupBy("user_id").agg(F.count_if("reached").alias("reached"), F.count("*").alias("n"))


def rate_windows(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "ts")
    per = events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
    return per.withColumn("limited", F.col("n") > 2)


def rate_windows_stream(spark, sf_dir):
    clock = jobs.Clock(jobs.events_stream(spark, sf_dir), "ts", "user_id")
    return jobs.drain(jobs.rate_windows(clock.stream, 2), "append", "rates", clock=clock)


def status_stream(spark, sf_dir):
    return jobs.drain(jobs.status_counts(jobs.events_stream(spark, sf_dir)), "update", "status", keys=("event_type",))


def first_event_stream(spark, sf_dir):
    """Windows that begin with each user's first event, as a stream gives them out."""
    clock = jobs.Clock(jobs.events_stream(spark, sf_dir), "ts", "user_id")
    return jobs.drain(jobs.first_event_windows(clock.stream, 2, 21600), "append", "first-events", clock=clock)


def first_event_windows(spark, sf_dir):
    return T.sessions_from_first(read(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts", 21600)


def tenant_pages(spark, sf_dir):
    """Counts by segment, each customer seen by their own segment only."""
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def row_problems(spark, sf_dir):
    """Events that break constraints on their fields, one row for each problem."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    rules = {"props.k missing": k.isNull(), "props.k above 90": k > 90, "value below 1": F.col("value") < 1, "event_type unknown": ~F.col("event_type").isin("view", "click", "signup", "purchase", "error")}
    events = read(spark, sf_dir, "events")
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return events.select("event_id", F.explode(found).alias("problem"))


QUERIES = {f.__name__: f for f in (upsert_latest, latest_per_key, newest_page, version_history, membership, cascade_delete, retention, partial_update, name_lookup, threaded_listing, listing_enriched, run_summary, reached_after_error, rate_windows, rate_windows_stream, status_stream, first_event_stream, first_event_windows, tenant_pages, row_problems)}

_RATE = "SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL"
_LAST = "m AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey)"
_FIRST = """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS start FROM events GROUP BY user_id
    UNION ALL SELECT w.user_id, n.ts FROM w, LATERAL (SELECT min(e.ts) AS ts FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 6 HOUR) n WHERE n.ts IS NOT NULL)"""
_FIRST_FROM = " FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.start AND e.ts < w.start + INTERVAL 6 HOUR GROUP BY ALL"
ORACLES = {
    "upsert_latest": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders",
    "latest_per_key": f"WITH {_LAST} SELECT o_custkey, o_orderkey, o_orderstatus FROM m",
    "newest_page": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100",
    "version_history": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS version FROM orders",
    "membership": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)",
    "cascade_delete": "SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "retention": "WITH k AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000) SELECT user_id, count(*) AS kept, max(event_id) AS newest FROM k GROUP BY user_id",
    "partial_update": "SELECT c_custkey, CASE WHEN m > 400000 THEN 'LARGE' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "name_lookup": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000007'",
    "threaded_listing": "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS answers FROM conversations",
    "listing_enriched": f"WITH {_LAST} SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN m ON c_custkey = o_custkey",
    "run_summary": "SELECT user_id, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS ms FROM events GROUP BY user_id",
    "reached_after_error": "WITH b AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (before IS NULL OR before <> 'error') AS reached, count(*) AS n FROM b GROUP BY user_id",
    "rate_windows": _RATE,
    "rate_windows_stream": _RATE,
    "status_stream": "SELECT event_type, count(*) AS n, round(max(value), 4) AS most FROM events GROUP BY event_type",
    "first_event_stream": f"{_FIRST} SELECT w.user_id, w.start, count(*) AS n, count(*) > 2 AS limited{_FIRST_FROM}",
    "first_event_windows": f"{_FIRST} SELECT w.user_id, w.start, count(*) AS n{_FIRST_FROM}",
    "tenant_pages": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "row_problems": """WITH k AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_id, unnest(list_filter([CASE WHEN k IS NULL THEN 'props.k missing' END, CASE WHEN k > 90 THEN 'props.k above 90' END, CASE WHEN value < 1 THEN 'value below 1' END,
          CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase', 'error') THEN 'event_type unknown' END], lambda x: x IS NOT NULL)) AS problem FROM k""",
}
