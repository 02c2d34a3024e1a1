"""Directed graphs as tables of edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import saved


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) by distinct neighbours, self-loops left out."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing leads to."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return entry_points(nodes, edges).join(edges.where("src <> dst").select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those at nodes that cannot lie on a cycle, peeled until nothing falls."""
    edges = saved(edges)
    left = edges.count()
    while left:
        has_in, has_out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = saved(edges.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi").select("src", "dst"))
        before, left = left, edges.count()
        if left == before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles, with the least node that is mutually reachable.

    Every node takes the least label that reaches it; nodes of one label from
    which the label's own node is reached again are one component. Components
    found go, what cannot lie on a cycle is trimmed, and the rest goes on. No
    table grows beyond the edges.
    """
    edges, parts = edges.where("src <> dst").select("src", "dst").distinct(), []
    kind = edges.schema["src"].dataType.simpleString()
    while True:
        edges = trimmed(edges)
        if edges.isEmpty():
            break
        label = edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")).withColumn("moved", F.lit(True))
        while True:
            step = edges.join(label.where("moved").select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("least"))
            better = F.coalesce(F.col("least") < F.col("label"), F.lit(False))
            label = saved(label.join(step, "node", "left").select("node", F.when(better, F.col("least")).otherwise(F.col("label")).alias("label"), better.alias("moved")))
            if label.where("moved").isEmpty():
                break
        of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        inner = saved(edges.join(of("src"), "src").join(of("dst"), "dst").where("label_src = label_dst").select("src", "dst"))
        found = front = saved(label.where("node = label").select("node", F.col("label").alias("component")))
        while not front.isEmpty():
            back = inner.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct()
            front = saved(back.join(found, "node", "left_anti"))
            found = found.union(front)
        found = saved(found)
        parts.append(found)
        edges = edges.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    if not parts:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    several = every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return every.join(several, "component", "left_semi").select("node", "component")


def layer_edges(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """Edges with the layers (node, layer, rank) of their ends; up counts as a violation."""
    a = layer.select(F.col("node").alias("src"), F.col("layer").alias("src_layer"), F.col("rank").alias("src_rank"))
    b = layer.select(F.col("node").alias("dst"), F.col("layer").alias("dst_layer"), F.col("rank").alias("dst_rank"))
    return edges.join(a, "src").join(b, "dst").withColumn("violation", F.coalesce(F.col("src_rank") > F.col("dst_rank"), F.lit(False)))


def depth(edges: DataFrame, most: int = 6) -> DataFrame:
    """(node, depth): the longest path that ends at a node, up to most steps."""
    e = saved(edges.where("src <> dst").select("src", "dst").distinct())
    level = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("depth", F.lit(0))
    for _ in range(most):
        step = e.join(level.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("further"))
        level = saved(level.join(step, "node", "left").select("node", F.greatest("depth", F.coalesce("further", F.lit(0))).alias("depth")))
    return level


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, distance) within hops steps either way; seeds is (seed, node)."""
    both = saved(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    near = seeds.select("seed", "node").withColumn("distance", F.lit(0))
    edge = near
    for h in range(1, hops + 1):
        edge = edge.join(both.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct()
        edge = saved(edge.join(near, ["seed", "node"], "left_anti").withColumn("distance", F.lit(h)))
        near = near.union(edge)
    return near


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) by peeling nodes without predecessors; nodes on or behind cycles have none."""
    left, e, done, at = saved(nodes), saved(edges.where("src <> dst").select("src", "dst").distinct()), None, 0
    while True:
        free = saved(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(at)))
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        left = saved(left.join(free, "node", "left_anti"))
        e = saved(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        at += 1
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.union(stuck)


def resolved(links: DataFrame, index: DataFrame, candidates: Column) -> DataFrame:
    """links with target: the first of the candidate paths that index (path) holds; null if none."""
    each = links.withColumn("link_no", F.monotonically_increasing_id())
    tries = each.select("link_no", F.posexplode(candidates).alias("order", "path"))
    found = tries.join(index.select("path").distinct(), "path").groupBy("link_no").agg(F.min_by("path", "order").alias("target"))
    return each.join(found, "link_no", "left").drop("link_no")


def folded(path: Column) -> Column:
    """A path with '.', '..' and empty segments folded."""
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
