"""Tables of records with owners, versions and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import saved


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest record of every key in either; changes win ties."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def latest(rows: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Columns of each key's row of greatest order; combined map-side, so no window."""
    best = rows.groupBy(key).agg(F.max(F.struct(order.alias("__o"), *columns)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}").alias(c) for c in columns])


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """children without those of deleted keys."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the non-null fields of patch put in."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = rows.join(p, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def sessions_from_first(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Windows of fixed length that begin with a key's first event after the last window: (key, start, n).

    A key's times are cut into spans of the window's length, so no key is ever in
    one task as a whole. Every time knows the first time a window later: in the
    next span, or else the first of a further one. From each key's first time
    these steps are followed with their length doubled each round. Rows with a null key or time are left out.
    """
    length = seconds * 1_000_000
    span = lambda c: F.floor(F.col(c) / length)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    times = rows.select(F.col(key).alias("k"), micros.alias("t")).dropna().groupBy("k", "t").agg(F.count("*").alias("n")).withColumn("s", span("t"))
    times = saved(times)
    # Times and what looks for them (a window after each time) side by side, span by span.
    asks = times.select("k", (F.col("s") + 1).alias("s"), (F.col("t") + length).alias("t"), F.lit(None).cast("long").alias("own"), F.col("t").alias("asked"))
    both = times.select("k", "s", "t", F.col("t").alias("own"), F.lit(None).cast("long").alias("asked")).union(asks)
    ahead = Window.partitionBy("k", "s").orderBy(F.desc("t"), F.desc(F.col("asked").isNull())).rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("next", F.min("own").over(ahead)).where("asked is not null").select("k", "s", "asked", "next")
    firsts = times.groupBy("k", "s").agg(F.min("t").alias("first"))
    # The first time of a span after the one asked for; few rows a key.
    w = Window.partitionBy("k").orderBy(F.desc("s"), F.col("first").isNotNull())
    spans = inner.select("k", "s").distinct().withColumn("first", F.lit(None).cast("long")).union(firsts)
    later = spans.withColumn("later", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("first is null").select("k", "s", "later")
    step = inner.join(later, ["k", "s"], "left").select("k", F.col("asked").alias("t"), F.coalesce("next", "later").alias("to")).where("to is not null")
    start = times.groupBy("k").agg(F.min("t").alias("t"))
    # Only times that some step leads to can be passed.
    step = saved(step.join(step.select("k", F.col("to").alias("t")).union(start).distinct(), ["k", "t"], "left_semi"))
    found = saved(start)
    while not step.isEmpty():
        found = saved(found.union(found.join(step, ["k", "t"]).select("k", F.col("to").alias("t"))).distinct())
        step = saved(step.join(step.select("k", F.col("t").alias("to"), F.col("to").alias("further")), ["k", "to"]).select("k", "t", F.col("further").alias("to")))
    near = found.withColumn("s", F.explode(F.array(span("t"), span("t") + 1))).withColumnRenamed("t", "start")
    inside = times.join(near, ["k", "s"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + length))
    return inside.groupBy("k", "start").agg(F.sum("n").alias("n")).select(F.col("k").alias(key), F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "n")


def of_tenant(rows: DataFrame, tenant, column: str = "workspace_id") -> DataFrame:
    """The rows of one tenant; without a tenant there are none to give, so that is an error."""
    if tenant is None or tenant == "":
        raise ValueError("a tenant must be named")
    return rows.where(F.col(column) == F.lit(tenant))


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows that share key the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grouped_for_picking(models: DataFrame) -> DataFrame:
    """models (provider, model, local, price) with their place: providers with a local model first, then cheapest first."""
    side = models.groupBy("provider").agg(F.bool_or("local").alias("has_local"))
    w = Window.partitionBy("provider").orderBy(F.desc("local"), "price", "model")
    return models.join(side, "provider").withColumn("place", F.row_number().over(w))


def running(rows: DataFrame, key: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with the sum of each of values over the rows before it in its key's order: exclusive prefix sums.

    Rows are range-partitioned by key and order. Each partition is summed as a whole,
    the sums before it are its offset, and only within a partition's slice of
    a key is there a window; so a key of any size is never in one task.
    """
    kept = rows.columns
    valued = rows.select("*", *[v.alias(f"__{n}") for n, v in values.items()])
    ranged = saved(valued.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    whole = ranged.groupBy(key, "__part").agg(*[F.sum(f"__{n}").alias(f"__all_{n}") for n in values])
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(key, "__part", *[F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in values])
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, [key, "__part"])
    return joined.select(*kept, *[(F.col(f"__off_{n}") + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0))).alias(n) for n in values])
