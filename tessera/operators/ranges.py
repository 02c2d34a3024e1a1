"""Version ranges as tables of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "([0-9]+|[*xX])"
#: One comparator: sign, up to three numbers or wildcards, a prerelease.
_COMPARATOR = f"(\\^|~|>=|<=|>|<|=)?v?{_NUMBER}(?:\\.{_NUMBER})?(?:\\.{_NUMBER})?(?:-([0-9A-Za-z.-]+))?"


def _key(major: Column, minor: Column, patch: Column, final: Column, pre: Column, edge: int) -> Column:
    """A bound or version; edge puts a bound behind (1) or before (0) the versions equal to it."""
    long = lambda c: c.cast("long")
    return F.struct(long(major).alias("major"), long(minor).alias("minor"), long(patch).alias("patch"), final.alias("final"), prerelease_key(pre).alias("pre"), F.lit(edge).alias("edge"))


_PART = "array<struct<worded: boolean, number: decimal(38,0), text: string>>"


def prerelease_key(pre: Column) -> Column:
    """The parts of a prerelease as they order: numbers by value and before words, fewer parts before more."""
    number = lambda p: p.rlike("^[0-9]{1,38}$")
    parts = F.transform(F.split(pre, "\\."), lambda p: F.struct((~number(p)).alias("worded"), F.when(number(p), p.try_cast("decimal(38,0)")).otherwise(0).alias("number"), F.when(number(p), "").otherwise(p).alias("text")))
    return F.when(pre == "", F.array().cast(_PART)).otherwise(parts.cast(_PART))


def version_key(version: Column) -> Column:
    """A version as a struct that orders as versions do; null where it is none."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(version, "^v?([0-9]+)(?:\\.([0-9]+))?(?:\\.([0-9]+))?", k), F.lit("")).cast("long"), F.lit(0))
    pre = F.regexp_extract(version, "^v?[0-9.]+-([0-9A-Za-z.-]+)", 1)
    return F.when(version.rlike("^v?[0-9]"), _key(part(1), part(2), part(3), pre == "", pre, 0))


def intervals(range_: Column) -> Column:
    """An array of structs (lo, hi): a version is in the range where lo <= key < hi for one of them.

    Alternatives are parted by ||; comparators beside each other hold together;
    a - b is both ends; missing numbers and * are wild; ^ keeps the first number
    that is not zero, ~ the minor one. Empty text is any version.
    """
    hyphen = F.regexp_replace(range_, "([0-9A-Za-z.*-]+) +- +([0-9A-Za-z.*-]+)", ">=$1 <=$2")
    tight = F.regexp_replace(hyphen, "(\\^|~|>=|<=|>|<|=) +", "$1")
    least = _key(F.lit(0), F.lit(0), F.lit(0), F.lit(False), F.lit(""), 0)
    most = _key(F.lit(2**62), F.lit(0), F.lit(0), F.lit(True), F.lit(""), 1)

    def bounds(c: Column) -> Column:
        get = lambda k: F.regexp_extract(c, f"^{_COMPARATOR}$", k)
        sign = get(1)
        wild = lambda k: get(k).isin("", "*", "x", "X")
        number = lambda k: F.when(wild(k), F.lit(0)).otherwise(get(k)).cast("long")
        a, b, p, pre = number(2), number(3), number(4), get(5)
        zero, one, none = F.lit(0), F.lit(1), F.lit("")
        here = lambda edge: _key(a, b, p, pre == "", pre, edge)
        # A border before all prereleases of the next version.
        border = lambda x, y, z: _key(x, y, z, F.lit(False), none, 0)
        next_major, next_minor, next_patch = border(a + one, zero, zero), border(a, b + one, zero), border(a, b, p + one)
        caret = F.when((a > 0) | wild(3), next_major).when((b > 0) | wild(4), next_minor).otherwise(next_patch)
        whole = F.when(wild(3), next_major).when(wild(4), next_minor)
        lo = F.when(wild(2) | sign.isin("<", "<="), least).when(sign == ">", F.coalesce(whole, here(1))).otherwise(here(0))
        hi = (
            F.when(wild(2) | sign.isin(">", ">="), most)
            .when(sign == "<", F.when(wild(3) | wild(4), border(a, b, p)).otherwise(here(0)))
            .when(sign == "^", caret)
            .when(sign == "~", F.when(wild(3), next_major).otherwise(next_minor))
            .otherwise(F.coalesce(whole, here(1)))
        )
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def alternative(text: Column) -> Column:
        parts = F.transform(F.filter(F.split(F.trim(text), " +"), lambda c: c != ""), bounds)
        lo, hi = F.array_max(F.transform(parts, lambda x: x.lo)), F.array_min(F.transform(parts, lambda x: x.hi))
        return F.struct(F.coalesce(lo, least).alias("lo"), F.coalesce(hi, most).alias("hi"))

    return F.filter(F.transform(F.split(tight, "\\|\\|"), alternative), lambda x: x.lo < x.hi)


def satisfies(version: Column, range_: Column) -> Column:
    key = version_key(version)
    return F.coalesce(F.exists(intervals(range_), lambda i: (i.lo <= key) & (key < i.hi)), F.lit(False))


def advisory_matches(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (ecosystem, name, range) that advisories (ecosystem, package, advisory, severity, range) touch.

    match_kind is exact where one version is pinned, range where the two ranges
    merely overlap. Advisories become one row an interval; the join is by
    ecosystem and name, intervals are compared within it.
    """
    d = dependencies.withColumn("__own", F.explode(intervals(F.col("range")))).withColumn("__name", F.lower("name"))
    a = advisories.select("ecosystem", F.lower("package").alias("__name"), "advisory", "severity", F.explode(intervals(F.col("range"))).alias("__bad"))
    met = d.join(a, ["ecosystem", "__name"]).where((F.col("__own.lo") < F.col("__bad.hi")) & (F.col("__bad.lo") < F.col("__own.hi")))
    kind = F.when(F.trim("range").rlike("^=?v?[0-9]+\\.[0-9]+\\.[0-9]+[^ |]*$"), "exact").otherwise("range")
    return met.withColumn("match_kind", kind).select(*dependencies.columns, "advisory", "severity", "match_kind").distinct()
