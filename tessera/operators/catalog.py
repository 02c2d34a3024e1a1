"""Catalogues: API operations, their flattening and lint, entities of schemas, scores of recorded outputs, commit logs, stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.rules import hashed_similarity

VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
PARAMETER = ":([A-Za-z0-9_]+)"


def operations(routes: DataFrame) -> DataFrame:
    """(id, method, path, tag, parameters, statuses, summary, has_body) of routes (method, route); other verbs fall out."""
    slug = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower("route"), "[^a-z0-9]+", "_"), "^_|_$", ""), F.lit("")), F.lit("root"))
    tag = F.coalesce(F.get(F.filter(F.split("route", "/"), lambda s: s != ""), F.lit(0)), F.lit("default"))
    return routes.where(F.lower("method").isin(*VERBS)).select(
        F.concat_ws("_", F.lower("method"), slug).alias("id"), F.lower("method").alias("method"), F.col("route").alias("path"), tag.alias("tag"),
        F.regexp_extract_all("route", F.lit(PARAMETER), F.lit(1)).alias("parameters"), F.array(*map(F.lit, ("200", "400", "500"))).alias("statuses"),
        F.concat_ws(" ", F.upper("method"), "route").alias("summary"), F.lit(False).alias("has_body"),
    )


def flattened(documents: DataFrame, key: str) -> DataFrame:
    """(key, method, path, id, summary, parameters, statuses, has_body) of API descriptions (key, text).

    text is a JSON object whose paths map a path to methods; {name} becomes :name.
    Text that is no such object gives no row.
    """
    shape = "paths map<string, map<string, struct<operationId:string, summary:string, parameters:array<struct<name:string, `in`:string>>, responses:map<string,string>, requestBody:string>>>"
    parsed = documents.select(key, F.from_json("text", shape).alias("d"))
    paths = parsed.select(key, F.explode("d.paths").alias("path", "methods"))
    each = paths.select(key, "path", F.explode("methods").alias("method", "o")).where(F.lower("method").isin(*VERBS))
    declared = F.transform(F.filter(F.coalesce("o.parameters", F.array()), lambda p: p["in"] == "path"), lambda p: p["name"])
    return each.select(
        key, F.lower("method").alias("method"), F.regexp_replace("path", "\\{([^}]+)\\}", ":$1").alias("path"), F.col("o.operationId").alias("id"), "o.summary",
        declared.alias("parameters"), F.array_sort(F.map_keys(F.coalesce("o.responses", F.create_map().cast("map<string,string>")))).alias("statuses"), F.col("o.requestBody").isNotNull().alias("has_body"),
    )


def lint_operations(ops: DataFrame, key: str) -> DataFrame:
    """(key, operation, severity, problem, detail): what is wrong with the operations of each catalogue.

    Second and later uses of an id count as repeated, in order of path and method.
    Every rule is a condition on the operation's row; one window finds the repeats.
    """
    w = Window.partitionBy(key, "id").orderBy("path", "method")
    rows = ops.withColumn("__n", F.when(F.coalesce("id", F.lit("")) != "", F.row_number().over(w)))
    starts = lambda digits: F.exists("statuses", lambda s: F.substring(s, 1, 1).isin(*digits))
    missing = F.array_except(F.regexp_extract_all("path", F.lit(PARAMETER), F.lit(1)), F.coalesce("parameters", F.array().cast("array<string>")))
    problem = lambda when, severity, name, detail="": F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("problem"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")))
    found = F.array(
        problem(F.coalesce("id", F.lit("")) == "", "error", "no-id"),
        problem(F.col("__n") > 1, "error", "repeated-id", F.col("id")),
        problem(F.size(missing) > 0, "error", "undeclared-parameter", F.array_join(missing, ",")),
        problem(F.size("statuses") == 0, "error", "no-response"),
        problem(~starts("2"), "warning", "no-success-response"),
        problem(~starts("45"), "warning", "no-error-response"),
        problem(F.coalesce("summary", F.lit("")) == "", "warning", "no-summary"),
        problem(F.col("method").isin("post", "put", "patch") & ~F.col("has_body"), "warning", "no-body"),
    )
    out = rows.select(key, F.concat_ws(" ", F.upper("method"), "path").alias("operation"), F.explode(F.filter(found, lambda p: p.isNotNull())).alias("p"))
    return out.select(key, "operation", "p.*")


def unreferenced(schemas: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """schemas (key, name) that no row of references (key, name) names."""
    return schemas.join(references.select(key, "name").distinct(), [key, "name"], "left_anti")


def merged_entities(columns: DataFrame, key: str) -> DataFrame:
    """columns (key, entity, column, ..., refers_to) of each entity's fullest definition, the smallest key among equals.

    refers_to is cleared where no definition of that entity exists.
    """
    sizes = columns.groupBy("entity", key).agg(F.count("*").alias("n"))
    best = sizes.groupBy("entity").agg(F.min_by(key, F.struct(-F.col("n"), key)).alias(key))
    known = best.select(F.col("entity").alias("refers_to"), F.lit(True).alias("__known"))
    return columns.join(best, ["entity", key]).join(known, "refers_to", "left").withColumn("refers_to", F.when(F.col("__known"), F.col("refers_to"))).drop("__known")


def _alike(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, "\\s+", " ")))


def scored_outputs(cases: DataFrame, key: str, pattern: str = "", least: int = 0, most: int = 1 << 30) -> DataFrame:
    """(key, scorer, score, weight) of cases (key, output, expected, must, never): seven scorers.

    A scorer that a case gives nothing to work on has weight 0. Similarity is the
    cosine of hashed vectors of output and expected value. A null output is empty.
    """
    rows = cases.withColumn("output", F.coalesce("output", F.lit("")))
    low = F.lower("output")
    hits = lambda c: F.size(F.filter(c, lambda n: F.contains(low, F.lower(n))))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    body = F.regexp_replace(F.trim("output"), "^```(?:json)?\\s*|\\s*```$", "")
    long = F.length(F.trim("output"))
    one = lambda name, score, on: F.struct(F.lit(name).alias("scorer"), score.cast("double").alias("score"), on.cast("double").alias("weight"))
    plain = F.array(
        one("exact-match", F.coalesce(_alike(F.col("output")) == _alike(F.col("expected")), F.lit(False)), F.col("expected").isNotNull()),
        one("contains", F.when(size(F.col("must")) > 0, hits(F.col("must")) / size(F.col("must"))).otherwise(0.0), size(F.col("must")) > 0),
        one("not-contains", F.when(size(F.col("never")) > 0, hits(F.col("never")) == 0).otherwise(True), size(F.col("never")) > 0),
        one("json-valid", F.expr("try_parse_json(__body)").isNotNull(), F.lit(1)),
        one("regex", F.col("output").rlike(f"(?i){pattern}") if pattern else F.lit(0), F.lit(1 if pattern else 0)),
        one("length", long.between(least, most), F.lit(1)),
    )
    got = rows.withColumn("__body", body).select(key, F.explode(plain).alias("s")).select(key, "s.*")
    return got.unionByName(similarity(rows, key))


def similarity(cases: DataFrame, key: str) -> DataFrame:
    """(key, scorer, score, weight) of cases (key, output, expected): the scorer of likeness alone. A null output is empty."""
    got = hashed_similarity(cases.withColumn("output", F.coalesce("output", F.lit(""))), key, "output", "expected")
    return got.select(key, F.lit("similarity").alias("scorer"), F.coalesce("similarity", F.lit(0.0)).alias("score"), F.col("similarity").isNotNull().cast("double").alias("weight"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, date, subject, body) of logs whose records end in 0x1E and whose fields are parted by 0x1F; short records fall out."""
    raw = spark.read.option("lineSep", "\x1e").text(path)
    part = F.split(F.regexp_replace("value", "^\\s+", ""), "\x1f")
    names = ("sha", "author", "date", "subject", "body")
    return raw.where(F.size(part) >= 4).select(*[F.coalesce(F.get(part, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def store_records(rows: DataFrame, path: str, parts: int = 16) -> None:
    """Append rows (workspace, collection, id, version, payload) to a table partitioned by workspace and collection.

    A collection is written by up to parts tasks, so a large one does not land in one.
    """
    spread = F.pmod(F.xxhash64("id"), F.lit(parts))
    rows.repartition("workspace", "collection", spread).write.mode("append").partitionBy("workspace", "collection").parquet(path)


def list_records(spark: SparkSession, path: str, workspace: str, collection: str) -> DataFrame:
    """A collection's newest record of every id; only its folder is read."""
    rows = spark.read.parquet(path).where((F.col("workspace") == workspace) & (F.col("collection") == collection))
    return rows.groupBy("id").agg(F.max("version").alias("version"), F.max_by("payload", F.struct("version", "payload")).alias("payload"))
