"""Findings of lines with several matches."""

import re
from collections import Counter

from tessera.operators import findings
from tessera.operators.lines import lines
from tessera.plans.findings_queries import secret_scan
from tessera.sources.tables import read

A, B = "ab12" * 10, "cd34" * 10


def found(spark, *ls):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(ls, 1)], "doc_id long, line_no int, line string")
    return sorted((r["line_no"], r["rule"], r["preview"]) for r in findings.secrets(df).collect())


def test_every_match_of_a_line(spark):
    got = found(spark, f"token={A} and token={B}", "a.b@x.org, c.d@y.org and a.b@x.org", "nothing")
    mails = [(2, "mail-address", "a.b@....")] * 2 + [(2, "mail-address", "c.d@....")]
    assert got == [(1, "hex-token", "ab12...."), (1, "hex-token", "cd34....")] + mails


def test_placeholder_or_plain_value_hides_none_behind_it(spark):
    got = found(spark, "password=changeme12 then password=Tr0ub4dor&3", "secret: aaaaaaaaaa secret: q7Wz!k2Lp9")
    assert got == [(1, "assigned-secret", "Tr0u...."), (2, "assigned-secret", "q7Wz....")]


def test_mails_and_tokens_of_the_table(spark, sf):
    """Counts by rule against Python's findall."""
    want = Counter()
    for r in lines(read(spark, sf, "documents", "doc_id", "text")).collect():
        for rule in findings.SECRETS:
            if not rule.least_entropy:
                want[rule.name] += sum(not re.search(findings.PLACEHOLDER, v) for v in re.findall(rule.pattern, r["line"], re.ASCII))
    got = Counter(r["rule"] for r in secret_scan(spark, sf).collect())
    assert {k: got[k] for k in want} == dict(want)
