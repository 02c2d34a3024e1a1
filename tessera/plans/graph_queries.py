"""Queries over graphs that the tables hold: links of pages and customers in the order of their orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.sources.tables import read


def _follow(spark, sf_dir):
    """Edges from the customer of an urgent order to the customer of the next order."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    first = orders.where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") + 1).alias("next"), F.col("o_custkey").alias("src"))
    return first.join(orders.select(F.col("o_orderkey").alias("next"), F.col("o_custkey").alias("dst")), "next").select("src", "dst")


def _customers(spark, sf_dir):
    return read(spark, sf_dir, "customer", F.col("c_custkey").alias("node"), "c_nationkey")


def fan_in_out(spark, sf_dir):
    return G.degrees(_follow(spark, sf_dir))


def graph_entry_points(spark, sf_dir):
    return G.entry_points(_customers(spark, sf_dir).select("node"), _follow(spark, sf_dir))


def graph_orphans(spark, sf_dir):
    return G.orphans(_customers(spark, sf_dir).select("node"), _follow(spark, sf_dir))


def graph_cycles(spark, sf_dir):
    return G.cycles(_follow(spark, sf_dir))


def layer_violations(spark, sf_dir):
    """Edges against the order of regions, by pair of regions."""
    regions = read(spark, sf_dir, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    layer = _customers(spark, sf_dir).join(regions, "c_nationkey").select("node", F.col("n_regionkey").alias("layer"), F.when(F.col("n_regionkey") < 4, F.col("n_regionkey")).alias("rank"))
    got = G.layer_edges(_follow(spark, sf_dir), layer)
    return got.groupBy("src_layer", "dst_layer").agg(F.count("*").alias("edges"), F.count_if("violation").alias("violations"))


def dependency_depth(spark, sf_dir):
    return G.depth(_follow(spark, sf_dir), 4)


def khop(spark, sf_dir):
    edges = _follow(spark, sf_dir)
    seeds = _customers(spark, sf_dir).select(F.col("node").alias("seed"), "node")
    return G.neighbourhood(edges, seeds, 2)


def dag_levels(spark, sf_dir):
    """Levels of the edges that lead to a customer of a higher key."""
    return G.levels(_customers(spark, sf_dir).select("node"), _follow(spark, sf_dir).where("src < dst"))


def link_resolution(spark, sf_dir):
    """Links of pages to the paths of other pages: how many there are and how many resolve."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    index = pages.select(G.folded(path).alias("path")).where("path <> ''")
    href = F.explode(F.regexp_extract_all("html", F.lit('href="/([^"?#]*)'), F.lit(1))).alias("href")
    links = pages.select("page_id", href)
    got = G.resolved(links, index, F.array(G.folded(F.col("href")), F.concat(G.folded(F.col("href")), F.lit("/index.html"))))
    return got.groupBy("page_id").agg(F.count("*").alias("links"), F.count("target").alias("resolved"), F.min("target").alias("first_target"))


def top_subgraph(spark, sf_dir):
    """Edges among the eight customers of most connections."""
    edges = _follow(spark, sf_dir).where("src <> dst").distinct()
    top = G.degrees(edges).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "node").limit(8).select("node")
    return edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi")


def routes_by_prefix(spark, sf_dir):
    """The first 20 paths of every leading segment, and how many it has."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    routes = read(spark, sf_dir, "pages", "url").select(path.alias("path")).where("path <> ''").distinct().withColumn("prefix", F.split("path", "/")[0])
    w = Window.partitionBy("prefix").orderBy("path")
    return routes.withColumn("place", F.row_number().over(w)).where("place <= 20")


QUERIES = {f.__name__: f for f in (fan_in_out, graph_entry_points, graph_orphans, graph_cycles, layer_violations, dependency_depth, khop, dag_levels, link_resolution, top_subgraph, routes_by_prefix)}

_T = """tr AS (SELECT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority = '1-URGENT'),
    e AS (SELECT DISTINCT src, dst FROM tr WHERE src <> dst)"""
_DEG = "dg AS (SELECT coalesce(a.node, b.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY 1) a FULL OUTER JOIN (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY 1) b ON a.node = b.node)"
_PATH = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '^/+|/+$', '', 'g'), '/+', '/', 'g')"
ORACLES = {
    "fan_in_out": f"WITH {_T}, {_DEG} SELECT * FROM dg",
    "graph_entry_points": f"WITH {_T} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM e)",
    "graph_orphans": f"WITH {_T} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM e UNION SELECT src FROM e)",
    "graph_cycles": f"""WITH RECURSIVE {_T}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
        SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""",
    "layer_violations": f"""WITH {_T}, l AS (SELECT c_custkey AS node, n_regionkey AS layer, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS edges, count(*) FILTER (coalesce(a.rank > b.rank, false)) AS violations
        FROM tr JOIN l a ON src = a.node JOIN l b ON dst = b.node GROUP BY ALL""",
    "dependency_depth": f"""WITH RECURSIVE {_T}, d AS (SELECT DISTINCT src AS node, 0 AS depth FROM e UNION SELECT DISTINCT dst, 0 FROM e UNION SELECT e.dst, depth + 1 FROM d JOIN e ON d.node = e.src WHERE depth < 4)
        SELECT node, max(depth) AS depth FROM d GROUP BY node""",
    "khop": f"""WITH RECURSIVE {_T}, u AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr),
        k AS (SELECT c_custkey AS seed, c_custkey AS node, 0 AS distance FROM customer UNION SELECT seed, u.dst, distance + 1 FROM k JOIN u ON k.node = u.src WHERE distance < 2)
        SELECT seed, node, min(distance) AS distance FROM k GROUP BY ALL""",
    "dag_levels": f"""WITH RECURSIVE {_T}, g AS (SELECT src, dst FROM e WHERE src < dst),
        l AS (SELECT c_custkey AS node, 0 AS level FROM customer UNION SELECT g.dst, level + 1 FROM l JOIN g ON l.node = g.src) SELECT node, max(level) AS level FROM l GROUP BY node""",
    "link_resolution": f"""WITH ix AS (SELECT DISTINCT {_PATH} AS path FROM pages),
        h AS (SELECT page_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(html, 'href="/([^"?#]*)', 1)), '^/+|/+$', '', 'g'), '/+', '/', 'g') AS href FROM pages),
        t AS (SELECT page_id, coalesce(a.path, b.path) AS target FROM h LEFT JOIN (SELECT * FROM ix WHERE path <> '') a ON a.path = href LEFT JOIN (SELECT * FROM ix WHERE path <> '') b ON b.path = href || '/index.html')
        SELECT page_id, count(*) AS links, count(target) AS resolved, min(target) AS first_target FROM t GROUP BY page_id""",
    "top_subgraph": f"WITH {_T}, {_DEG}, t AS (SELECT node FROM dg ORDER BY fan_in + fan_out DESC, node LIMIT 8) SELECT src, dst FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)",
    "routes_by_prefix": """WITH r AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages), s AS (SELECT path, string_split(path, '/')[1] AS prefix FROM r WHERE path <> '')
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY path) AS place FROM s) WHERE place <= 20""",
}
