"""Queries over findings, postures and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import findings as R
from tessera.operators.lines import lines
from tessera.plans.line_queries import _D
from tessera.sources.tables import read

WINDOW_RULES = {"licence-then-prose": "(?i)licen[sc]ed[^\n]*\n[A-Z]", "shouting": "[A-Z]{6,}!![^\n]* [A-Z]{4,}!!"}


def _found(spark, sf_dir):
    return R.secrets(lines(read(spark, sf_dir, "documents", "doc_id", "text")))


def secret_scan(spark, sf_dir):
    return _found(spark, sf_dir)


def pattern_scan(spark, sf_dir):
    return R.window_patterns(lines(read(spark, sf_dir, "documents", "doc_id", "text")), WINDOW_RULES)


def injection_flags(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    found = R.injection(F.col("text"))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.size(found) > 0).alias("suspicious"))


def redact_props(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "props")
    record = R.redact(F.from_json("props", "map<string,string>"))
    return events.select("event_id", F.array_join(F.transform(F.map_entries(record), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("props"))


def posture(spark, sf_dir):
    per = _found(spark, sf_dir).join(read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    out = per.groupBy("source").agg(F.sum(R.by_weight(F.col("severity"), R.SECURITY)).alias("penalty"), *[F.count_if(F.col("severity") == s).alias(s) for s in R.SECURITY])
    score = R.posture_score(F.col("penalty"))
    return out.withColumn("score", score).withColumn("grade", R.grade(score, R.POSTURE_CUTS))


def debt_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    code = lines(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("code"))
    per = _found(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(R.by_weight(F.col("severity"), R.DEBT)).alias("penalty"))
    both = code.join(per, "source", "left").select("source", "code", F.coalesce("penalty", F.lit(0)).alias("penalty"))
    score = R.debt_score(F.col("penalty"), F.col("code"))
    return both.withColumn("score", score).withColumn("grade", R.grade(score, R.DEBT_CUTS))


def compliance(spark, sf_dir):
    """Controls, each with its rule's count over all documents; a control without a rule is not assessed."""
    controls = spark.createDataFrame(
        [("C1", "tokens", "hex-token"), ("C2", "cloud keys", "cloud-key-id"), ("C3", "mail", "mail-address"), ("C4", "secrets", "assigned-secret"), ("C5", "backups", None)],
        "control string, title string, rule string",
    )
    counts = _found(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    state = F.when(F.col("rule").isNull(), "not-assessed").when(n > 0, "fail").otherwise("pass")
    return F.broadcast(controls).join(counts, "rule", "left").select("control", "title", n.alias("n"), state.alias("state"))


def remediation(spark, sf_dir):
    """What to do first: rules by severity, with how many documents and the first of them."""
    found = _found(spark, sf_dir)
    out = found.groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    w = Window.orderBy(F.desc(R.by_weight(F.col("severity"), R.SECURITY)), "rule")
    return out.withColumn("step", F.row_number().over(w)).where("step <= 6")


def posture_trend(spark, sf_dir):
    """A score for each month of orders and its change in percent from the month before, between -100 and 100."""
    orders = read(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority")
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    per = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.floor(urgent / F.count("*") * 1000 + 0.5) / 10).alias("score"))
    before = F.lag("score").over(Window.orderBy("month"))
    change = F.when(before > 0, F.greatest(F.least((F.col("score") - before) / before * 100, F.lit(100.0)), F.lit(-100.0)))
    return per.withColumn("delta", F.round(change, 4))


def coverage_full_outer(spark, sf_dir):
    """Documents against labels, whichever side has them."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1")
    both = docs.join(labels, "doc_id", "full_outer").select("doc_id", F.col("source").isNotNull().alias("in_docs"), F.col("quality").isNotNull().alias("labelled"))
    return both.groupBy("in_docs", "labelled").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def documentation_coverage(spark, sf_dir):
    """For each source which of four checks hold, and the share that do."""
    docs = read(spark, sf_dir, "documents", "text", "source", "lang")
    t = F.col("text")
    per = docs.groupBy("source").agg(
        F.bool_or(t.rlike("(?i)licen[sc]ed")).alias("licence"), F.bool_or(t.rlike("(?i)rights reserved")).alias("rights"),
        F.bool_or(t.rlike("@")).alias("contact"), (F.countDistinct("lang") > 1).alias("languages"),
    )
    names = ("licence", "rights", "contact", "languages")
    have = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))
    miss = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    return per.select("source", (F.size(have) * 25).alias("score"), F.array_join(have, ",").alias("present"), F.array_join(miss, ",").alias("missing"))


def documentation_gaps(spark, sf_dir):
    got = documentation_coverage(spark, sf_dir)
    return got.where("missing <> ''").select("source", F.explode(F.split("missing", ",")).alias("gap"))


QUERIES = {f.__name__: f for f in (secret_scan, pattern_scan, injection_flags, redact_props, posture, debt_summary, compliance, remediation, posture_trend, coverage_full_outer, documentation_coverage, documentation_gaps)}


def _secret_sql() -> str:
    parts = []
    for r in R.SECRETS:
        p = r.pattern.replace("'", "''")
        low = ""
        if r.least_entropy:
            chars = "list_distinct(string_split(v, ''))"
            low = f" AND list_sum(list_transform({chars}, lambda c: -(length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) >= {r.least_entropy}"
        parts.append(
            f"SELECT doc_id, line_no, '{r.name}' AS rule, '{r.severity}' AS severity, substr(v, 1, 4) || '....' AS preview "
            f"FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{p}', 1)) AS v FROM ls) WHERE v <> '' AND NOT regexp_matches(v, '{R.PLACEHOLDER}'){low}"
        )
    return " UNION ALL ".join(parts)


_S = f"{_D}, sec AS ({_secret_sql()})"
_W = lambda w: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " END"
_G = lambda cuts: "CASE WHEN score >= {} THEN 'A' WHEN score >= {} THEN 'B' WHEN score >= {} THEN 'C' WHEN score >= {} THEN 'D' ELSE 'F' END".format(*cuts)
_COVER = """cov AS (SELECT source, bool_or(regexp_matches(text, '(?i)licen[sc]ed')) AS licence, bool_or(regexp_matches(text, '(?i)rights reserved')) AS rights,
    bool_or(contains(text, '@')) AS contact, count(DISTINCT lang) > 1 AS languages FROM documents GROUP BY source),
    cv AS (SELECT source, list_filter([CASE WHEN licence THEN 'licence' END, CASE WHEN rights THEN 'rights' END, CASE WHEN contact THEN 'contact' END, CASE WHEN languages THEN 'languages' END], lambda x: x IS NOT NULL) AS have,
      list_filter([CASE WHEN NOT licence THEN 'licence' END, CASE WHEN NOT rights THEN 'rights' END, CASE WHEN NOT contact THEN 'contact' END, CASE WHEN NOT languages THEN 'languages' END], lambda x: x IS NOT NULL) AS miss FROM cov)"""
ORACLES = {
    "secret_scan": f"WITH {_S} SELECT * FROM sec",
    "pattern_scan": f"""WITH {_D}, w AS (SELECT doc_id, line_no, concat_ws(chr(10), line, lead(line, 1) OVER x, lead(line, 2) OVER x, lead(line, 3) OVER x) AS t FROM ls WINDOW x AS (PARTITION BY doc_id ORDER BY line_no)),
        h AS (SELECT doc_id, line_no, 'licence-then-prose' AS rule FROM w WHERE regexp_matches(t, '(?i)licen[sc]ed[^\n]*\n[A-Z]')
              UNION ALL SELECT doc_id, line_no, 'shouting' FROM w WHERE regexp_matches(t, '[A-Z]{{6,}}!![^\n]* [A-Z]{{4,}}!!'))
        SELECT doc_id, rule, min(line_no) AS line_no FROM h GROUP BY ALL""",
    "injection_flags": "SELECT role, count(*) AS turns, count(*) FILTER (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in R.INJECTION) + ") AS suspicious FROM conversations GROUP BY role",
    "redact_props": """SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || '=' || CASE WHEN regexp_matches(k, '(?i)token|secret|password|key|^k$') THEN '[redacted]'
        ELSE json_extract_string(props, '$.' || k) END), ',') AS props FROM events""",
    "posture": f"""WITH {_S}, g AS (SELECT source, CAST(sum({_W(R.SECURITY)}) AS BIGINT) AS penalty, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM sec JOIN documents USING (doc_id) GROUP BY source),
        s AS (SELECT *, floor(4500 / (penalty + 45) * 10 + 0.5) / 10 AS score FROM g) SELECT *, {_G(R.POSTURE_CUTS)} AS grade FROM s""",
    "debt_summary": f"""WITH {_S}, c AS (SELECT source, count(*) AS code FROM ls JOIN documents USING (doc_id) GROUP BY source),
        p AS (SELECT source, CAST(sum({_W(R.DEBT)}) AS BIGINT) AS penalty FROM sec JOIN documents USING (doc_id) GROUP BY source),
        b AS (SELECT source, code, coalesce(penalty, 0) AS penalty FROM c LEFT JOIN p USING (source)),
        s AS (SELECT *, floor(2200 / (penalty / (greatest(500, code) / 1000) + 22) * 10 + 0.5) / 10 AS score FROM b) SELECT *, {_G(R.DEBT_CUTS)} AS grade FROM s""",
    "compliance": f"""WITH {_S}, k(control, title, rule) AS (VALUES ('C1', 'tokens', 'hex-token'), ('C2', 'cloud keys', 'cloud-key-id'), ('C3', 'mail', 'mail-address'), ('C4', 'secrets', 'assigned-secret'), ('C5', 'backups', NULL)),
        n AS (SELECT rule, count(*) AS n FROM sec GROUP BY rule)
        SELECT control, title, coalesce(n, 0) AS n, CASE WHEN k.rule IS NULL THEN 'not-assessed' WHEN coalesce(n, 0) > 0 THEN 'fail' ELSE 'pass' END AS state FROM k LEFT JOIN n ON k.rule = n.rule""",
    "remediation": f"""WITH {_S}, g AS (SELECT rule, severity, count(*) AS findings, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM sec GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_W(R.SECURITY)} DESC, rule) AS step FROM g) WHERE step <= 6""",
    "posture_trend": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, floor(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) * 1000 + 0.5) / 10 AS score FROM orders GROUP BY 1),
        b AS (SELECT *, lag(score) OVER (ORDER BY month) AS before FROM m)
        SELECT month, score, CASE WHEN before > 0 THEN round(greatest(least((score - before) / before * 100, 100.0), -100.0), 4) END AS delta FROM b""",
    "coverage_full_outer": """SELECT source IS NOT NULL AS in_docs, quality IS NOT NULL AS labelled, count(*) AS n, min(doc_id) AS first_doc
        FROM documents FULL OUTER JOIN (SELECT doc_id, quality FROM labels WHERE quality = 1) USING (doc_id) GROUP BY ALL""",
    "documentation_coverage": f"WITH {_COVER} SELECT source, CAST(len(have) * 25 AS INTEGER) AS score, array_to_string(have, ',') AS present, array_to_string(miss, ',') AS missing FROM cv",
    "documentation_gaps": f"WITH {_COVER} SELECT source, unnest(miss) AS gap FROM cv",
}
