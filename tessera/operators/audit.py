"""Rules over source lines, changes, file trees and workflows; every rule set works on all rows at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G


@dataclass(frozen=True)
class CodeRule:
    """A pattern that begins on a line; languages limits it, unless on the same line lifts it."""

    name: str
    category: str
    severity: str
    pattern: str
    languages: tuple[str, ...] = ()
    unless: str = ""


_JS, _PY = ("typescript", "javascript"), ("python",)
#: A call by which text is made safe for a page.
CLEANERS = "(?i)\\b\\w*(?:sanit|purif|escape)\\w*\\s*[.(]"
CODE_RULES = (
    CodeRule("sql-built-from-text", "injection", "critical", "(?i)\\b(?:select|insert|update|delete)\\b[^\\n]{0,120}(?:\\$\\{|[\"'] *\\+ *[a-z]|\\{[a-z_]+\\})"),
    CodeRule("shell-from-text", "injection", "critical", "(?:execSync|exec|os\\.system|subprocess\\.[a-zA-Z]+)\\([^\\n)]*(?:\\$\\{|\\+ *[a-z]|shell *= *True)"),
    CodeRule("dynamic-eval", "injection", "high", "\\b(?:eval|new Function)\\( *[a-zA-Z_]", _JS),
    CodeRule("python-exec", "injection", "high", "\\b(?:exec|eval)\\( *[a-zA-Z_]", _PY),
    CodeRule("unpickled-input", "deserialisation", "high", "\\bpickle\\.loads?\\(", _PY),
    CodeRule("yaml-any-object", "deserialisation", "high", "\\byaml\\.load\\(", _PY, "Safe"),
    CodeRule("weak-hash", "crypto", "medium", "(?i)\\b(?:md5|sha1)\\b[^\\n]*(?:password|secret|token)"),
    CodeRule("guessable-token", "crypto", "high", "(?i)(?:token|secret|nonce|session)[^\\n]*(?:Math\\.random|random\\.rand)"),
    CodeRule("tls-not-verified", "transport", "critical", "(?i)\\b(?:reject_?unauthorized|verify(?:_ssl|_certs)?|ssl_?verify|check_hostname)[\"']?\\s*[:=]\\s*(?:false|0|no)\\b"),
    CodeRule("plain-http", "transport", "low", "\\bhttp:/{2}(?!localhost|127\\.|0\\.0\\.0\\.0|example\\.)\\w"),
    CodeRule("any-origin", "access", "medium", "(?i)allow-origin[\"']?[,:] *[\"']\\*"),
    CodeRule("debug-on", "configuration", "medium", "(?i)\\b(?:app_?)?debug\\s*=\\s*(?:true|1|on)\\b", _PY),
    CodeRule("open-cookie", "access", "medium", "(?i)(?:httpOnly|secure): *false", _JS),
    CodeRule("unsigned-jwt", "access", "critical", "(?i)algorithms?[\"']?[:=] *\\[?[\"']none"),
    CodeRule("raw-html-prop", "cross-site", "high", "\\bdangerouslySetInnerHTML\\b", _JS, CLEANERS),
    CodeRule("raw-html-write", "cross-site", "high", "\\.(?:inner|outer)HTML\\s*\\+?=(?!=)", _JS, CLEANERS),
    CodeRule("path-from-request", "files", "high", "(?:readFile|sendFile|open)\\([^\\n)]*(?:req\\.|request\\.|params)"),
    CodeRule("prompt-from-input", "model", "medium", "(?i)prompt *[:=][^\\n]*\\{[^\\n]*(?:input|user|request)"),
    CodeRule("model-output-run", "model", "critical", "(?:eval|exec|query)\\( *(?:completion|answer|reply)"),
    CodeRule("endless-tools", "model", "medium", "while *\\(?(?:true|True)\\)?[^\\n]*\\n[^\\n]*(?:tool|agent)\\("),
    CodeRule("key-in-browser", "secrets", "critical", "\\b(?:[A-Z]+_)?(?:PUBLIC|VITE|EXPO|GATSBY)_\\w*(?:KEY|SECRET|TOKEN|PASSWORD)\\b"),
)


def is_test_file(path: Column) -> Column:
    """Whether a path is a test: a folder of tests, or test or spec in its name."""
    return path.rlike("(?i)(^|/)(__tests__|tests?|spec|e2e)/|(^|/)test_[^/]*$|[._-](test|spec)\\.[a-z]+$")


def _begins(r: CodeRule) -> str:
    return f"^[^\\n]*?(?:{r.pattern})"


def rule_hits(text: Column, line: Column, language: Column, rules: tuple[CodeRule, ...] = CODE_RULES) -> Column:
    """(rule, category, severity) of the rules that match a line, given with the lines after it as text."""

    def hit(r: CodeRule) -> Column:
        ok = text.rlike(_begins(r))
        if r.languages:
            ok &= language.isin(*r.languages)
        if r.unless:
            ok &= ~line.rlike(r.unless)
        return F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")))

    return F.array_compact(F.array(*map(hit, rules)))


def code_patterns(ls: DataFrame, rules: tuple[CodeRule, ...] = CODE_RULES, lines: int = 4) -> DataFrame:
    """(path, rule, category, severity, line_no): each rule's first line in every file.

    ls is (path, language, line_no, line). A match may run on for lines lines and
    is reported where it begins. Test files are passed over. Lines that no rule
    can match are left after one joint pattern.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    code = ls.where(~is_test_file(F.col("path")))
    seen = code.withColumn("text", F.concat_ws("\n", "line", *[F.lead("line", i).over(w) for i in range(1, lines)]))
    seen = seen.where(F.col("text").rlike("|".join(_begins(r) for r in rules)))
    each = seen.select("path", "line_no", F.explode(rule_hits(F.col("text"), F.col("line"), F.col("language"), rules)).alias("r"))
    return each.groupBy("path", "r.rule", "r.category", "r.severity").agg(F.min("line_no").alias("line_no"))


def env_files(files: DataFrame, ignored: Column) -> DataFrame:
    """(path, ignored) of environment files in a tree; examples and templates are none."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.rlike("^\\.env(\\.|$)") & ~name.rlike("(?i)example|sample|template")).select("path", ignored.alias("ignored"))


def architecture_findings(nodes: DataFrame, edges: DataFrame, layer: DataFrame) -> DataFrame:
    """(node, rule, severity): nodes on cycles, edges against the layers by their source, nodes without an edge."""
    on_cycle = G.cycles(edges).select("node", F.lit("cycle").alias("rule"), F.lit("high").alias("severity"))
    upward = G.layer_edges(edges, layer).where("violation").select(F.col("src").alias("node"), F.lit("layer-violation"), F.lit("medium")).distinct()
    alone = G.orphans(nodes, edges).select("node", F.lit("orphan"), F.lit("low"))
    return on_cycle.union(upward).union(alone)


LEFTOVER = {"debug-output": "\\b(?:console\\.log|debugger|print)\\b", "marker": "\\b(?:TODO|FIXME|XXX|HACK)\\b"}


def change_findings(added: DataFrame, changes: DataFrame, most_lines: int = 400, least_description: int = 20) -> DataFrame:
    """(change, rule, n) of changes (change, description) and their added lines (change, path, text).

    Leftovers are counted by line; a change is large by its added lines, lacks
    tests where code was added but no test file, and is sparsely described where
    several lines have few words about them.
    """
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in LEFTOVER.items()]))
    left = added.select("change", F.explode(kinds).alias("rule")).groupBy("change", "rule").agg(F.count("*").alias("n"))
    size = added.groupBy("change").agg(F.count("*").alias("lines"), F.count_if(is_test_file(F.col("path"))).alias("tests"))
    per = size.join(changes.select("change", F.length(F.trim(F.coalesce("description", F.lit("")))).alias("said")), "change", "left")
    rules = {"large-change": F.col("lines") > most_lines, "missing-tests": F.col("tests") == 0, "sparse-description": (F.coalesce("said", F.lit(0)) < least_description) & (F.col("lines") > 1)}
    whole = per.select("change", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"), F.col("lines").alias("n"))
    return left.union(whole)


def workflow_problems(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(workflow, problem, node) of workflows: nodes (workflow, node, type) and edges (workflow, src, dst).

    unknown-type, dangling-edge (an end that is no node, named by the other end),
    isolated (several nodes and no edge), cycle, and no-start (no node that
    nothing leads to; node is null).
    """
    keys = ["workflow", "node"]
    unknown = nodes.where(~F.col("type").isin(*types)).select("workflow", F.lit("unknown-type").alias("problem"), "node")
    known = nodes.select(*keys).distinct()
    ends = edges.select("workflow", F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("src").alias("other")), F.struct(F.col("src").alias("node"), F.col("dst").alias("other")))).alias("e"))
    dangling = ends.select("workflow", "e.*").join(known, keys, "left_anti").select("workflow", F.lit("dangling-edge"), F.col("other").alias("node")).distinct()
    touched = ends.select("workflow", F.col("e.node").alias("node")).distinct()
    several = known.groupBy("workflow").agg(F.count("*").alias("n")).where("n > 1").select("workflow")
    isolated = known.join(several, "workflow", "left_semi").join(touched, keys, "left_anti").select("workflow", F.lit("isolated"), "node")
    name = lambda c: F.struct(F.col("workflow"), F.col(c).alias("node"))
    loops = G.cycles(edges.where("src <> dst").select(name("src").alias("src"), name("dst").alias("dst"))).select("node.workflow", F.lit("cycle"), "node.node")
    led_to = edges.where("src <> dst").select("workflow", F.col("dst").alias("node")).distinct()
    starts = known.join(led_to, keys, "left_anti").select("workflow").distinct()
    none = known.select("workflow").distinct().join(starts, "workflow", "left_anti").select("workflow", F.lit("no-start"), F.lit(None).cast(nodes.schema["node"].dataType))
    return unknown.union(dangling).union(isolated).union(loops).union(none)
