"""Commits, releases, versions and recorded evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import version_key

HEADER = "^([a-zA-Z]+)(?:\\(([^)]*)\\))?(!)?: (.+)$"
KINDS = ("feat", "fix", "docs", "perf", "refactor", "test", "build", "chore")


def parse_commits(commits: DataFrame) -> DataFrame:
    """Adds kind, scope, breaking, description, conventional and refs to commits (subject, body)."""
    kind = F.lower(F.regexp_extract("subject", HEADER, 1))
    known = kind.isin(*KINDS)
    breaking = (F.regexp_extract("subject", HEADER, 3) == "!") | F.coalesce(F.col("body"), F.lit("")).rlike("(?m)^BREAKING CHANGE")
    refs = F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "subject", "body"), F.lit("#([0-9]+)"), F.lit(1)))
    return commits.select(
        "*",
        F.when(known, kind).otherwise("other").alias("kind"),
        F.when(known, F.regexp_extract("subject", HEADER, 2)).otherwise("").alias("scope"),
        breaking.alias("breaking"),
        F.when(known, F.regexp_extract("subject", HEADER, 4)).otherwise(F.col("subject")).alias("description"),
        known.alias("conventional"),
        refs.alias("refs"),
    )


def release_kind(parsed: DataFrame, release: str) -> DataFrame:
    """major, minor or patch for every release."""
    kind = F.when(F.bool_or("breaking"), "major").when(F.bool_or(F.col("kind") == "feat"), "minor").otherwise("patch")
    return parsed.groupBy(release).agg(kind.alias("release"), F.count("*").alias("commits"))


def release_entries(parsed: DataFrame, release: str, most: int = 15) -> DataFrame:
    """The first features and fixes of every release, beside its counts and how many people had a part in it."""
    facts = parsed.groupBy(release).agg(
        F.count_if(F.col("kind") == "feat").alias("features"), F.count_if(F.col("kind") == "fix").alias("fixes"), F.count_if("breaking").alias("breaking"), F.countDistinct("author").alias("contributors")
    )
    w = Window.partitionBy(release, "kind").orderBy("sha")
    entries = parsed.where(F.col("kind").isin("feat", "fix")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return entries.select(release, "kind", "place", "description").join(facts, release)


def lint(parsed: DataFrame, key: str) -> DataFrame:
    """(key, issue) for every rule that a commit breaks."""
    rules = {
        "not-conventional": ~F.col("conventional"),
        "subject-too-long": F.length("subject") > 72,
        "trailing-period": F.col("subject").endswith("."),
        "capitalised-description": F.col("description").rlike("^[A-Z]"),
        "breaking-without-body": F.col("breaking") & (F.coalesce(F.col("body"), F.lit("")) == ""),
    }
    return parsed.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("issue"))


#: A struct that orders as versions do; a prerelease is before its release.
version = version_key


def vulnerable(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, name, version) inside an advisory's [low, high): an equi-join, then the range."""
    d = dependencies.withColumn("v", version_key(F.col("version"))).withColumn("package", F.lower("name"))
    a = advisories.select("ecosystem", F.lower("package").alias("package"), "advisory", "severity", version_key(F.col("low")).alias("lo"), version_key(F.col("high")).alias("hi"))
    return d.join(a, ["ecosystem", "package"]).where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi"))).drop("v", "lo", "hi", "package")


def first_declared(dependencies: DataFrame) -> DataFrame:
    """One row for each (ecosystem, name): the shallowest manifest's, then the first by path."""
    w = Window.partitionBy("ecosystem", "name").orderBy(F.size(F.split("manifest", "/")), "manifest")
    return dependencies.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def weighted_quality(scores: DataFrame, *keys: str) -> DataFrame:
    total = F.sum("weight")
    value = F.when(total > 0, F.sum(F.col("score") * F.col("weight")) / F.greatest(total, F.lit(1e-12))).otherwise(0.0)
    return scores.groupBy(*keys).agg((F.floor(value * 10000 + 0.5) / 10000).alias("quality"))


def summarise(cases: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per variant of (variant, quality, latency, cost, failed): quality and latency of successes, pass rate of all."""
    ok = ~F.col("failed")
    return cases.groupBy("variant").agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.when(ok, F.col("quality"))), 4).alias("quality"),
        F.round(F.count_if(ok & (F.col("quality") >= threshold)) / F.count("*"), 4).alias("pass_rate"),
        F.round(F.avg(F.when(ok, F.col("latency"))), 4).alias("latency"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN NOT failed THEN latency END)").alias("p95"),
        F.round(F.sum("cost"), 6).alias("cost"),
        F.count_if(~ok).alias("errors"),
    )


def winner(summary: DataFrame, margin: float = 0.02) -> DataFrame:
    """The best variant; among those within the margin the cheapest, then the fastest."""
    best = summary.agg(F.max("quality").alias("best"))
    near = summary.crossJoin(F.broadcast(best)).where(F.col("quality") >= F.col("best") - margin)
    return near.orderBy("cost", "latency", "variant").limit(1).drop("best")
