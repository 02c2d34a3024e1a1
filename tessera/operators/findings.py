"""Rule findings over lines, and scores over findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import entropy

#: Points a finding of each severity takes.
DEBT = {"critical": 20, "high": 8, "medium": 3, "low": 1}
SECURITY = {"critical": 40, "high": 15, "medium": 5, "low": 1}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # the first group is the value
    severity: str
    least_entropy: float = 0.0


SECRETS = (
    Rule("hex-token", "(?i)token *[=:] *\"?([0-9a-f]{40})", "critical"),
    Rule("cloud-key-id", "\\b((?:AKIA|ASIA)[0-9A-Z]{16})\\b", "critical"),
    Rule("assigned-secret", "(?i)(?:password|passwd|secret|api_key) *[=:] *\"?([^\" ]{8,})", "high", 2.5),
    Rule("database-url", "\\b([a-z]+://[^ /:@]+:[^ /:@]+@[^ /]+)", "high"),
    Rule("mail-address", "\\b([A-Za-z0-9._]+@[A-Za-z0-9.-]+\\.[a-z]{2,})\\b", "low"),
)
PLACEHOLDER = "(?i)change_?me|xxxx|example_key|your[_-]"
# Phrases that give orders to a model.
INJECTION = (
    "(?i)ignore (?:all )?(?:previous|prior|above) instructions",
    "(?i)disregard (?:the )?(?:system|previous) (?:prompt|instructions)",
    "(?i)\\b(?:reveal|print|output|repeat) (?:your|the) (?:system )?(?:prompt|instructions)\\b",
)


def by_weight(severity: Column, weights: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, w in weights.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def secret_hits(line: Column, rules: tuple[Rule, ...] = SECRETS) -> Column:
    """(rule, severity, preview) of every match of a line.

    Values that look like placeholders or fall below a rule's entropy are left
    out, each on its own; a preview is the first four characters and dots.
    """

    def hits(r: Rule) -> Column:
        def fits(value: Column) -> Column:
            ok = (value != "") & ~value.rlike(PLACEHOLDER)
            return ok & (entropy(value) >= r.least_entropy) if r.least_entropy else ok

        values = F.filter(F.regexp_extract_all(line, F.lit(r.pattern), F.lit(1)), fits)
        return F.transform(values, lambda v: F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.concat(F.substring(v, 1, 4), F.lit("....")).alias("preview")))

    return F.concat(*[hits(r) for r in rules])


#: Pieces of which one at least is in every line that a rule can match.
SECRET_HINT = "(?i)token|AKIA|ASIA|password|passwd|secret|api_key|://|@"


def secrets(ls: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] = SECRETS) -> DataFrame:
    """(key, line_no, rule, severity, preview): a row for every match of a line; one pass, lines without a hint are left first."""
    some = ls.where(F.col("line").rlike(SECRET_HINT)) if rules is SECRETS else ls
    return some.select(key, "line_no", F.explode(secret_hits(F.col("line"), rules)).alias("f")).select(key, "line_no", "f.*")


def window_patterns(ls: DataFrame, rules: dict[str, str], key: str = "doc_id", lines: int = 4) -> DataFrame:
    """First line of each text at which a rule matches a window of lines; the window's start is reported."""
    w = Window.partitionBy(key).orderBy("line_no")
    seen = ls.withColumn("text", F.concat_ws("\n", "line", *[F.lead("line", i).over(w) for i in range(1, lines)]))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items()]))
    return seen.select(key, "line_no", F.explode(hits).alias("rule")).groupBy(key, "rule").agg(F.min("line_no").alias("line_no"))


def injection(text: Column, patterns: tuple[str, ...] = INJECTION) -> Column:
    """The parts of a text that give orders to a model."""
    return F.filter(F.array(*[F.regexp_extract(text, p, 0) for p in patterns]), lambda m: m != "")


def redact(record: Column, secret_keys: str = "(?i)token|secret|password|key|^k$") -> Column:
    """A map with the values of secret-looking keys covered."""
    return F.transform_values(record, lambda k, v: F.when(k.rlike(secret_keys), F.lit("[redacted]")).otherwise(v))


def debt_score(penalty: Column, code: Column) -> Column:
    density = penalty / (F.greatest(F.lit(500), code) / 1000)
    return F.floor(2200 / (density + 22) * 10 + 0.5) / 10


def posture_score(penalty: Column) -> Column:
    return F.floor(4500 / (penalty + 45) * 10 + 0.5) / 10


def grade(score: Column, cuts: tuple[int, int, int, int]) -> Column:
    a, b, c, d = cuts
    return F.when(score >= a, "A").when(score >= b, "B").when(score >= c, "C").when(score >= d, "D").otherwise("F")


DEBT_CUTS, POSTURE_CUTS = (90, 75, 60, 40), (90, 75, 55, 35)
