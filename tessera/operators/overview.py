"""What a repository is about, and portfolios of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.audit import is_test_file

#: Facts about a tree, each by a path that shows it.
SHOWN_BY = {
    "has_readme": "(?i)^readme(\\.\\w+)?$", "has_license": "(?i)^licen[cs]e(\\.\\w+)?$", "has_contributing": "(?i)^contributing(\\.\\w+)?$",
    "has_ci": "^(\\.github/workflows/|\\.circleci/|\\.gitlab-ci\\.yml$)", "has_dockerfile": "(?i)(^|/)dockerfile$",
}
NO_STACK = "No framework detected"


def tree_facts(files: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, files, bytes, test_files, test_ratio, has_...) of files (repo, path, bytes) in one aggregate."""
    test = is_test_file(F.col("path"))
    facts = [F.bool_or(F.col("path").rlike(p)).alias(n) for n, p in SHOWN_BY.items()]
    out = files.groupBy(repo).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(test).alias("test_files"), *facts)
    other = F.col("files") - F.col("test_files")
    return out.withColumn("test_ratio", F.when(other == 0, 0.0).otherwise(F.floor(F.col("test_files") / other * 1000 + 0.5) / 1000))


def described(files: DataFrame, manifests: DataFrame, repo: str = "repo", most: int = 300) -> DataFrame:
    """(repo, description): the first declared one of manifests (repo, path, description), the shallowest manifest's, else
    the first line of prose in a README at the root, without headings, images and badges; '' where neither is."""
    declared = manifests.where(F.coalesce("description", F.lit("")) != "")
    told = declared.groupBy(repo).agg(F.min_by("description", F.struct(F.size(F.split("path", "/")), "path")).alias("told"))
    readme = files.where(F.col("path").rlike("(?i)^readme(\\.(md|rst|txt))?$") & F.col("text").isNotNull())
    lines = F.transform(F.split("text", "\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    prose = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("!") & ~s.startswith("[!["))
    first = readme.select(repo, "path", F.substring(F.regexp_replace(F.get(prose, F.lit(0)), "^[>*-]\\s*", ""), 1, most).alias("line"))
    read = first.groupBy(repo).agg(F.min_by("line", "path").alias("line"))
    every = files.select(repo).union(manifests.select(repo)).distinct()
    return every.join(told, repo, "left").join(read, repo, "left").select(repo, F.coalesce("told", "line", F.lit("")).alias("description"))


def stack_summary(technologies: DataFrame, repos: DataFrame, repo: str = "repo", shown: tuple[str, ...] = ("framework", "ui", "database")) -> DataFrame:
    """(repo, stack): the surest technology (repo, name, category, confidence) of each shown category, joined by a dot."""
    best = technologies.where(F.col("category").isin(*shown)).groupBy(repo, "category").agg(F.max_by("name", F.struct("confidence", F.col("name"))).alias("name"))
    place = F.array_position(F.array(*map(F.lit, shown)), F.col("category"))
    rows = best.groupBy(repo).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "name"))), lambda s: s["name"]), " · ").alias("stack"))
    return repos.select(repo).join(rows, repo, "left").select(repo, F.coalesce("stack", F.lit(NO_STACK)).alias("stack"))


def latest_analyses(analyses: DataFrame, by: str = "project", order: Column | None = None) -> DataFrame:
    """The newest row of every project."""
    at = order if order is not None else F.col("at")
    rest = [c for c in analyses.columns if c != by]
    return analyses.groupBy(by).agg(F.max_by(F.struct(*rest), at).alias("r")).select(by, "r.*")


def portfolio(analyses: DataFrame) -> DataFrame:
    """(workspace, projects, code, mean_health, critical, cycles) over the latest analyses (workspace, project, at, code, health, critical, cycles)."""
    last = latest_analyses(analyses)
    return last.groupBy("workspace").agg(
        F.count("*").alias("projects"), F.sum("code").alias("code"), (F.floor(F.avg("health") * 10 + 0.5) / 10).alias("mean_health"), F.sum("critical").alias("critical"), F.sum("cycles").alias("cycles")
    )


def portfolio_languages(analyses: DataFrame, languages: DataFrame, top: int = 8) -> DataFrame:
    """(workspace, language, code, rank) of the languages (project, at, language, code) with most code in the latest analyses."""
    last = latest_analyses(analyses).select("workspace", "project", "at")
    per = languages.join(last, ["project", "at"]).groupBy("workspace", "language").agg(F.sum("code").alias("code"))
    w = Window.partitionBy("workspace").orderBy(F.desc("code"), "language")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def reached(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, node, status, reached): a node is reached where nothing leads to it, or an edge from a node that succeeded does.

    traces are (run, node, status), edges (run, src, dst).
    """
    came = edges.join(traces.select("run", F.col("node").alias("src"), (F.col("status") == "succeeded").alias("ok")), ["run", "src"], "left")
    inward = came.groupBy("run", F.col("dst").alias("node")).agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("any"))
    return traces.join(inward, ["run", "node"], "left").select("run", "node", "status", F.coalesce("any", F.lit(True)).alias("reached"))


# Words that show an intent, in the order in which intents are tried.
INTENTS = {
    "howto": ("how do i", "how to", "steps", "setup", "set up", "install", "configure", "deploy"),
    "list": ("list", "show", "what are", "which", "enumerate", "find all"),
    "compare": ("compare", "versus", "vs", "difference between", "better"),
    "summarise": ("summar*", "overview", "tldr", "tl dr", "brief"),
    "define": ("what is", "what does", "define", "meaning of"),
    "explain": ("explain", "why", "how does", "walk me through", "understand"),
    "generate": ("write", "generate", "create", "draft", "produce"),
}


def intent(question: Column) -> Column:
    """The first intent one of whose phrases a question has as whole words; a star stands for any ending."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^a-z0-9_]+", " "), F.lit(" "))
    out = F.lit("unknown")
    for name, phrases in reversed(INTENTS.items()):
        said = F.exists(F.array(*[F.lit(f" {p[:-1]}" if p.endswith("*") else f" {p} ") for p in phrases]), lambda p: words.contains(p))
        out = F.when(said, name).otherwise(out)
    return out
