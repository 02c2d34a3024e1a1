"""Reports over findings of every kind, and overviews of repositories."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import overview as O
from tessera.operators import posture as P

KIND = "repo string, kind string, rule string, category string, severity string, place string, confidence string, match_kind string, fix string"
ROWS = [
    ("a", "secret", "token", None, None, "x:1", "high", None, None),
    ("a", "secret", "entropy", None, None, "x:2", "low", None, None),
    ("a", "env", "env-file", None, None, ".env", None, None, None),
    ("a", "env", "env-file", None, None, ".env.local", None, None, None),
    ("a", "code", "sql", "injection", "critical", "y:3", None, None, None),
    ("a", "dependency", "ADV-1", None, "high", "lib", None, "range", "2.0.0"),
    ("a", "dependency", "ADV-2", None, "medium", "old", None, "exact", None),
    ("b", "code", "open-cookie", "access", "high", "z:1", None, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    return P.finding_table(spark.createDataFrame(ROWS, KIND)).cache()


@pytest.fixture(scope="module")
def repos(spark):
    return spark.createDataFrame([("a",), ("b",), ("clean",)], "repo string")


def test_posture(found, repos):
    got = {r.repo: r for r in P.posture_report(found, repos).collect()}
    # Secret 40 and 1, environment files once 40, code 40, a range 0.6 * 15, an exact one 5.
    a = got["a"]
    assert a.penalty == 135 and (a.critical, a.high, a.medium, a.low) == (3, 1, 1, 1) and a.score == 25.0 and a.grade == "F"
    assert got["clean"].score == 100 and got["clean"].grade == "A" and got["b"].penalty == 15


def test_what_cannot_be_assessed_stays_so(found, repos):
    got = {(r.repo, r.control): (r.findings, r.state) for r in P.compliance_report(found, repos).collect()}
    assert len(got) == 3 * 16
    assert got["a", "A03"] == (1, "fail") and got["a", "A05"] == (2, "fail") and got["a", "CC6.1"] == (1, "fail") and got["a", "CC7.1"] == (1, "fail") and got["a", "A06"] == (2, "fail")
    assert got["b", "A07"] == (1, "fail") and got["b", "A03"] == (0, "pass") and got["clean", "A04"] == got["a", "A10"] == (0, "not-assessed")


def test_plan(found):
    got = sorted((r.repo, r.priority, r.step, r.n, r.affected, r.effort) for r in P.remediation_plan(found).collect())
    assert got == [
        ("a", 1, "rotate-secrets", 1, ["x:1"], "small"), ("a", 1, "untrack-env-files", 2, [".env", ".env.local"], "small"), ("a", 2, "fix-critical-code", 1, ["y:3"], "medium"),
        ("a", 3, "upgrade-dependencies", 1, ["lib"], "small"), ("a", 5, "mitigate-dependencies", 1, ["old"], "large"), ("b", 4, "review-high-code", 1, ["z:1"], "medium"),
    ]


def test_debt(spark, found):
    code = spark.createDataFrame([("a", 2000), ("clean", 10)], "repo string, code long")
    got = {r.repo: r for r in P.debt_report(found.where("severity is not null").select("repo", F.coalesce("category", F.lit("other")).alias("category"), "severity"), code).collect()}
    assert got["a"].by_category == {"injection": 1, "other": 4} and got["a"].effort_days == 3.8
    assert got["clean"].score == 100 and got["clean"].by_category is None


def test_descriptions(spark):
    files = [("m", "README.md", "# t\nreadme"), ("r", "readme.rst", "\n# t\n![i](x)\n[![b]](u)\n  > quoted *line*  \nnext"), ("n", "docs/README.md", "no"), ("e", "README", None), ("h", "readme.txt", "# only\n")]
    manifests = [("m", "a/b/package.json", "deep"), ("m", "package.json", "root"), ("m", "z.json", ""), ("o", "p/x.json", "only here")]
    got = O.described(spark.createDataFrame(files, "repo string, path string, text string"), spark.createDataFrame(manifests, "repo string, path string, description string"))
    assert {r.repo: r.description for r in got.collect()} == {"m": "root", "r": "quoted *line*", "n": "", "e": "", "h": "", "o": "only here"}


def test_stack_and_portfolio(spark):
    tech = [("a", "Next", "framework", 0.9), ("a", "Express", "framework", 0.8), ("a", "pg", "database", 0.7), ("a", "jest", "test", 1.0), ("b", "vue", "ui", 0.5)]
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    got = {r.repo: r.stack for r in O.stack_summary(spark.createDataFrame(tech, "repo string, name string, category string, confidence double"), repos).collect()}
    assert got == {"a": "Next · pg", "b": "vue", "c": O.NO_STACK}
    rows = spark.createDataFrame([("w", "p", 1, 100, 10.0, 5, 1), ("w", "p", 2, 50, 80.0, 1, 0), ("w", "q", 1, 30, 60.5, 0, 2)], "workspace string, project string, at int, code long, health double, critical int, cycles int")
    (r,) = O.portfolio(rows).collect()
    assert (r.projects, r.code, r.mean_health, r.critical, r.cycles) == (2, 80, 70.3, 1, 2)
    languages = spark.createDataFrame([("p", 1, "go", 100), ("p", 2, "ts", 40), ("p", 2, "go", 10), ("q", 1, "ts", 30)], "project string, at int, language string, code long")
    assert [(x.language, x.code, x.rank) for x in O.portfolio_languages(rows, languages).orderBy("rank").collect()] == [("ts", 70, 1), ("go", 10, 2)]


def test_reached(spark):
    traces = spark.createDataFrame([("r", "a", "succeeded"), ("r", "b", "failed"), ("r", "c", "succeeded"), ("r", "d", "skipped"), ("r", "e", "succeeded")], "run string, node string, status string")
    edges = spark.createDataFrame([("r", "a", "c"), ("r", "b", "c"), ("r", "b", "d"), ("r", "gone", "e")], "run string, src string, dst string")
    assert {r.node: r.reached for r in O.reached(traces, edges).collect()} == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_intents(spark):
    want = {"How do I run it?": "howto", "List all": "list", "x vs. y": "compare", "summarise this": "summarise", "What is it": "define", "explain": "explain", "Write it": "generate", "hello": "unknown", "whichever": "unknown", "why list": "list"}
    rows = spark.createDataFrame([(k,) for k in want], "q string").select("q", O.intent(F.col("q")).alias("i")).collect()
    assert {r.q: r.i for r in rows} == want
