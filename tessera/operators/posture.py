"""Security and debt reports over one table of findings of every kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.findings import DEBT, DEBT_CUTS, POSTURE_CUTS, SECURITY, by_weight, debt_score, grade, posture_score

#: Columns of the table of findings; kind is secret, code, env or dependency.
FINDINGS = {"repo": "string", "kind": "string", "rule": "string", "category": "string", "severity": "string", "place": "string", "confidence": "string", "match_kind": "string", "fix": "string"}
#: Severity of a secret by how sure it is one.
BY_CONFIDENCE = {"high": "critical", "medium": "high", "low": "low"}
#: How much a version inside a range counts beside an exact one.
RANGE_SHARE = 0.6


def finding_table(*tables: DataFrame) -> DataFrame:
    """One table of findings from several; a secret's severity follows its confidence, missing columns are null."""
    out = None
    for t in tables:
        row = t.select(*[(F.col(c) if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in FINDINGS.items()])
        out = row if out is None else out.unionByName(row)
    sure = F.lit(None).cast("string")
    for confidence, severity in BY_CONFIDENCE.items():
        sure = F.when(F.col("confidence") == confidence, severity).otherwise(sure)
    return out.withColumn("severity", F.when(F.col("kind") == "secret", F.coalesce(sure, "severity")).otherwise(F.col("severity")))


def posture_report(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, critical, high, medium, low, penalty, score, grade) of every repository in repos (repo).

    Each finding takes its severity's points, a dependency in a range three fifths of
    them; committed environment files count once, as one critical finding.
    """
    share = F.when((F.col("kind") == "dependency") & (F.col("match_kind") != "exact"), RANGE_SHARE).otherwise(1.0)
    once = Window.partitionBy("repo", "kind").orderBy("place")
    rows = findings.withColumn("__n", F.when(F.col("kind") == "env", F.row_number().over(once)).otherwise(1)).where("__n = 1")
    rows = rows.withColumn("severity", F.when(F.col("kind") == "env", "critical").otherwise(F.col("severity")))
    per = rows.groupBy("repo").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SECURITY], F.sum(by_weight(F.col("severity"), SECURITY) * share).alias("penalty"))
    out = repos.select("repo").join(per, "repo", "left").na.fill(0)
    score = posture_score(F.col("penalty"))
    return out.select("repo", *SECURITY, F.round("penalty", 4).alias("penalty"), score.alias("score"), grade(score, POSTURE_CUTS).alias("grade"))


@dataclass(frozen=True)
class Control:
    """A control, and the findings that break it: by kind, category or rule; none of them where it cannot be assessed."""

    id: str
    framework: str
    kinds: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    least_sure: tuple[str, ...] = ()


# Controls by the numbers of their frameworks.
CONTROLS = (
    Control("A01", "OWASP Top 10", rules=("any-origin", "path-from-request")),
    Control("A02", "OWASP Top 10", categories=("crypto", "transport")),
    Control("A03", "OWASP Top 10", categories=("injection", "cross-site")),
    Control("A04", "OWASP Top 10"),
    Control("A05", "OWASP Top 10", kinds=("env",), categories=("configuration",)),
    Control("A06", "OWASP Top 10", kinds=("dependency",)),
    Control("A07", "OWASP Top 10", rules=("open-cookie", "unsigned-jwt")),
    Control("A08", "OWASP Top 10", categories=("deserialisation",)),
    Control("A09", "OWASP Top 10"),
    Control("A10", "OWASP Top 10"),
    Control("LLM01", "OWASP LLM Top 10", rules=("prompt-from-input",)),
    Control("LLM02", "OWASP LLM Top 10", rules=("model-output-run",)),
    Control("LLM06", "OWASP LLM Top 10", rules=("key-in-browser",)),
    Control("LLM08", "OWASP LLM Top 10", rules=("endless-tools",)),
    Control("CC6.1", "SOC 2", kinds=("secret",), least_sure=("high", "medium")),
    Control("CC7.1", "SOC 2", kinds=("dependency",), severities=("critical", "high")),
)


def _breaks(c: Control) -> Column:
    hit = F.col("kind").isin(*c.kinds) if c.kinds else F.lit(False)
    code = F.col("kind") == "code"
    hit |= (code & F.col("category").isin(*c.categories)) if c.categories else F.lit(False)
    hit |= (code & F.col("rule").isin(*c.rules)) if c.rules else F.lit(False)
    if c.severities:
        hit &= F.col("severity").isin(*c.severities)
    if c.least_sure:
        hit &= F.col("confidence").isin(*c.least_sure)
    return hit


def compliance_report(findings: DataFrame, repos: DataFrame, controls: tuple[Control, ...] = CONTROLS) -> DataFrame:
    """(repo, control, framework, findings, state) of every control for every repository: pass, fail or not-assessed."""
    broken = F.array_compact(F.array(*[F.when(_breaks(c), F.lit(c.id)) for c in controls]))
    counts = findings.select("repo", F.explode(broken).alias("control")).groupBy("repo", "control").agg(F.count("*").alias("findings"))
    listed = F.array(*[F.struct(F.lit(c.id).alias("control"), F.lit(c.framework).alias("framework"), F.lit(bool(c.kinds or c.categories or c.rules)).alias("assessed")) for c in controls])
    every = repos.select("repo", F.explode(listed).alias("c")).select("repo", "c.*").join(counts, ["repo", "control"], "left")
    n = F.coalesce("findings", F.lit(0))
    return every.select("repo", "control", "framework", n.alias("findings"), F.when(~F.col("assessed"), "not-assessed").when(n > 0, "fail").otherwise("pass").alias("state"))


def remediation_plan(findings: DataFrame) -> DataFrame:
    """(repo, priority, step, n, affected, effort): what to do first, up to six steps a repository.

    Sure secrets and environment files come first, then critical code, dependencies with
    a fix, high code, and dependencies without one. affected lists what each step touches once.
    """
    code, dependency = F.col("kind") == "code", F.col("kind") == "dependency"
    steps = (
        (1, "rotate-secrets", (F.col("kind") == "secret") & (F.col("confidence") == "high")), (1, "untrack-env-files", F.col("kind") == "env"),
        (2, "fix-critical-code", code & (F.col("severity") == "critical")), (3, "upgrade-dependencies", dependency & F.col("fix").isNotNull()),
        (4, "review-high-code", code & (F.col("severity") == "high")), (5, "mitigate-dependencies", dependency & F.col("fix").isNull()),
    )
    step = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(p).alias("priority"), F.lit(name).alias("step"))) for p, name, when in steps]))
    each = findings.select("repo", "place", F.explode(step).alias("s")).select("repo", "s.*", "place")
    out = each.groupBy("repo", "priority", "step").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("place")).alias("affected"))
    small = F.col("step").isin("rotate-secrets", "untrack-env-files") | ((F.col("step") == "upgrade-dependencies") & (F.size("affected") <= 5))
    return out.withColumn("effort", F.when(small, "small").when(F.col("step") == "mitigate-dependencies", "large").otherwise("medium"))


#: Hours that a finding of each severity takes, and those of a day.
EFFORT, DAY = {"critical": 8.0, "high": 4.0, "medium": 2.0, "low": 0.5}, 6


def debt_report(findings: DataFrame, code: DataFrame) -> DataFrame:
    """(repo, counts by severity, by_category, effort_days, score, grade) of findings (repo, category, severity) and code (repo, code)."""
    per = findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in DEBT], F.sum(by_weight(F.col("severity"), DEBT)).alias("penalty"), F.sum(by_weight(F.col("severity"), EFFORT)).alias("hours")
    )
    kinds = findings.groupBy("repo", "category").agg(F.count("*").alias("n")).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    both = code.join(per, "repo", "left").na.fill(0).join(kinds, "repo", "left")
    score = debt_score(F.col("penalty"), F.col("code"))
    return both.select("repo", "code", *DEBT, "by_category", (F.floor(F.col("hours") / DAY * 10 + 0.5) / 10).alias("effort_days"), score.alias("score"), grade(score, DEBT_CUTS).alias("grade"))
