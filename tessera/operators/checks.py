"""Snapshots within limits, values held against schemas, and secrets covered in nested values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tables import running

#: Limits of a snapshot: files, bytes of one file, bytes of all texts, depth of folders.
LIMITS = {"files": 20_000, "file_bytes": 1 << 20, "total_bytes": 96 << 20, "depth": 24}


def entries(rows: DataFrame, repo: str = "repo") -> DataFrame:
    """A snapshot (repo, path, bytes, binary, text) of rows (repo, path, text): a leading ./ goes, bytes are those of UTF-8."""
    return rows.select(repo, F.regexp_replace("path", "^(?:\\./)+", "").alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.lit(False).alias("binary"), "text")


def within_limits(files: DataFrame, repo: str = "repo", limits: dict[str, int] | None = None) -> DataFrame:
    """files (repo, path, bytes, binary, text) as a scan with limits keeps them, with truncated.

    Files in folders too deep are left out, and so are those beyond the number of files,
    counted by depth, then path. In the order of paths a file is truncated, its text
    null, where it is too large itself or the texts before it reach the budget of
    bytes; binary files have no text and cost nothing. Paths are unique in a repository.
    """
    most = LIMITS | (limits or {})
    deep = F.size(F.split("path", "/")) - 1
    shallow = files.withColumn("__depth", deep).where(F.col("__depth") <= most["depth"])
    counted = running(shallow, repo, ["__depth", "path"], {"__place": F.lit(1)}).where(F.col("__place") < most["files"]).drop("__place", "__depth")
    fits = F.col("bytes") <= most["file_bytes"]
    costed = running(counted, repo, ["path"], {"__spent": F.when(fits & ~F.col("binary"), F.col("bytes")).otherwise(0)})
    truncated = ~fits | (F.col("__spent") >= most["total_bytes"])
    return costed.select(repo, "path", "bytes", (F.col("binary") & ~truncated).alias("binary"), F.when(~truncated & ~F.col("binary"), F.col("text")).alias("text"), truncated.alias("truncated"))


def snapshot_stats(files: DataFrame, kept: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, total_files, included, skipped, total_bytes, partial): what the limits did to files; partial where any bit."""
    before = files.groupBy(repo).agg(F.count("*").alias("total_files"))
    after = kept.groupBy(repo).agg(F.count("*").alias("included"), F.count_if("truncated").alias("skipped"), F.sum("bytes").alias("total_bytes"))
    both = before.join(after, repo, "left").na.fill(0, ["included", "skipped", "total_bytes"])
    return both.withColumn("partial", (F.col("skipped") > 0) | (F.col("included") < F.col("total_files")))


_NAMES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}


def _kind(value: Column) -> Column:
    """The kind of a variant in the words of schemas; integer where a number is whole."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    number = F.try_variant_get(value, "$", "double")
    out = F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.when(number == F.floor(number), "integer").otherwise("number"))
    for k, v in _NAMES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def problems(value: Column, schema: dict, path: str | Column = "body") -> Column:
    """Problems (field, message) of a variant against a schema, as an array.

    schema has type (a name or several), nullable, properties, required, items, enum,
    minimum, maximum, minLength, maxLength and pattern; it is walked once, when the
    expression is made. Of arrays every element is held against items. A
    value of the wrong type has that problem alone, a missing one that it is required.
    """
    where = path if isinstance(path, Column) else F.lit(path)
    say = lambda message: F.struct(where.alias("field"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    none = F.array().cast("array<struct<field:string,message:string>>")
    types = [schema["type"]] if isinstance(schema.get("type"), str) else list(schema.get("type", []))
    kind = _kind(value)
    missing = value.isNull() | F.is_variant_null(value)
    allowed = kind.isin(*types, *(["integer"] if "number" in types else [])) if types else F.lit(True)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "string", kind.isin("integer", "number")
    rules = []
    if "minLength" in schema:
        rules.append(F.when(is_text & (F.length(text) < schema["minLength"]), say(f"must be at least {schema['minLength']} characters")))
    if "maxLength" in schema:
        rules.append(F.when(is_text & (F.length(text) > schema["maxLength"]), say(f"must be at most {schema['maxLength']} characters")))
    if "pattern" in schema:
        rules.append(F.when(is_text & ~text.rlike(schema["pattern"]), say(f"must match {schema['pattern']}")))
    if "minimum" in schema:
        rules.append(F.when(is_number & (number < schema["minimum"]), say(f"must be >= {schema['minimum']}")))
    if "maximum" in schema:
        rules.append(F.when(is_number & (number > schema["maximum"]), say(f"must be <= {schema['maximum']}")))
    if "enum" in schema:
        same = [is_number & (number == x) if isinstance(x, (int, float)) and not isinstance(x, bool) else text.eqNullSafe(str(x).lower() if isinstance(x, bool) else x) for x in schema["enum"]]
        rules.append(F.when(~reduce(Column.__or__, same), say("must be one of: " + ", ".join(map(str, schema["enum"])))))
    found = [F.array_compact(F.array(*rules))] if rules else []
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(elements, lambda x, i: problems(x, schema["items"], F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(kind == "array", F.coalesce(F.flatten(inner), none)).otherwise(none))
    for name in schema.get("required", []):
        got = F.try_variant_get(value, f"$.{name}", "variant")
        gone = F.struct(F.concat(where, F.lit(f".{name}")).alias("field"), F.lit("is required").alias("message"))
        found.append(F.when((kind == "object") & got.isNull(), F.array(gone)).otherwise(none))
    for name, own in schema.get("properties", {}).items():
        got = F.try_variant_get(value, f"$.{name}", "variant")
        found.append(F.when((kind == "object") & got.isNotNull(), problems(got, own, F.concat(where, F.lit(f".{name}")))).otherwise(none))
    wrong = F.array(say(F.concat(F.lit("expected " + " or ".join(types) + ", received "), F.coalesce(F.when(kind == "integer", "number").otherwise(kind), F.lit("other")))))
    held = F.concat(*[f.cast("array<struct<field:string,message:string>>") for f in found]) if found else none
    absent = none if schema.get("nullable") or "null" in types or not types else F.array(say("is required"))
    return F.when(missing, absent).when(~allowed, wrong).otherwise(held).cast("array<struct<field:string,message:string>>")


def schema_problems(rows: DataFrame, key: str, text: str, schema: dict, path: str = "body") -> DataFrame:
    """(key, field, message): every problem of JSON texts against a schema; text that is no JSON has one problem."""
    parsed = rows.select(key, F.try_parse_json(F.col(text)).alias("v"), F.col(text).isNull().alias("none"))
    broken = F.array(F.struct(F.lit(path).alias("field"), F.lit("is no JSON").alias("message")))
    found = F.when(F.col("v").isNull() & ~F.col("none"), broken).otherwise(problems(F.col("v"), schema, path))
    return parsed.select(key, F.explode(found).alias("p")).select(key, "p.field", "p.message")


# Parts of names whose values are secrets.
SECRET_NAMES = "(?i)pass(?:word)?|secret|token|api[-_]?key|authorization|cookie|credential|private[-_]?key|session"
COVER, DEEP = "[redacted]", "[max-depth]"


def redacted(value: Column, kind: T.DataType, names: str = SECRET_NAMES, depth: int = 0) -> Column:
    """A value of a declared type with the values of secret-looking names covered, at any level.

    Structs, arrays and maps are walked along their type; below the sixth level what
    is nested is cut off. A covered field of a struct becomes text; in a map, whose values
    have one type, a covered value that is no text becomes null. Null stays null.
    """
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and depth > 6:
        return F.when(value.isNotNull(), F.lit(DEEP))
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(COVER) if re.search(names, f.name) else redacted(value.getField(f.name), f.dataType, names, depth + 1)).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(x, kind.elementType, names, depth + 1))
    if isinstance(kind, T.MapType):
        cover = F.lit(COVER) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(value, lambda k, x: F.when(k.rlike(names), cover).otherwise(redacted(x, kind.valueType, names, depth + 1)))
    return value


def redacted_rows(rows: DataFrame, names: str = SECRET_NAMES) -> DataFrame:
    """rows with every column walked, and columns of secret-looking names covered."""
    return rows.select(*[F.lit(COVER).alias(f.name) if re.search(names, f.name) else redacted(F.col(f"`{f.name}`"), f.dataType, names, 1).alias(f.name) for f in rows.schema.fields])
