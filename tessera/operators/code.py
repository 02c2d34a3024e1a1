"""Source files: languages, comments, functions, imports, manifests, routes and table definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lines import complexity

# Extension, language, category.
LANGUAGES = (
    ("py", "python", "programming"), ("ts", "typescript", "programming"), ("js", "javascript", "programming"), ("go", "go", "programming"),
    ("rs", "rust", "programming"), ("rb", "ruby", "programming"), ("java", "java", "programming"), ("c", "c", "programming"),
    ("sql", "sql", "programming"), ("html", "html", "markup"), ("md", "markdown", "prose"), ("json", "json", "data"), ("yaml", "yaml", "data"), ("toml", "toml", "data"),
    ("tsx", "typescript", "programming"), ("mts", "typescript", "programming"), ("cts", "typescript", "programming"), ("jsx", "javascript", "programming"), ("mjs", "javascript", "programming"), ("cjs", "javascript", "programming"),
    ("pyi", "python", "programming"), ("h", "c", "programming"), ("cpp", "cpp", "programming"), ("cc", "cpp", "programming"), ("hpp", "cpp", "programming"), ("cs", "csharp", "programming"), ("kt", "kotlin", "programming"),
    ("kts", "kotlin", "programming"), ("swift", "swift", "programming"), ("php", "php", "programming"), ("dart", "dart", "programming"), ("scala", "scala", "programming"), ("lua", "lua", "programming"), ("ex", "elixir", "programming"),
    ("sh", "shell", "programming"), ("bash", "shell", "programming"), ("vue", "vue", "markup"), ("svelte", "svelte", "markup"), ("xml", "xml", "markup"), ("htm", "html", "markup"), ("css", "css", "style"), ("scss", "scss", "style"),
    ("less", "less", "style"), ("graphql", "graphql", "data"), ("proto", "protobuf", "data"), ("tf", "terraform", "data"), ("yml", "yaml", "data"), ("mdx", "markdown", "prose"), ("rst", "restructuredtext", "prose"), ("txt", "text", "prose"),
)
FILENAMES = (("dockerfile", "dockerfile", "data"), ("makefile", "make", "programming"))
MANIFESTS = (("package.json", "npm"), ("requirements.txt", "pip"), ("pyproject.toml", "pip"), ("go.mod", "go"), ("cargo.toml", "cargo"), ("pom.xml", "maven"), ("gemfile", "rubygems"), ("composer.json", "composer"))


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def with_language(files: DataFrame) -> DataFrame:
    """Adds language and category to files (path): by name, then by the last extension; dotfiles have none."""
    spark = files.sparkSession
    names = spark.createDataFrame(FILENAMES, "__n string, __nl string, __nc string")
    exts = spark.createDataFrame(LANGUAGES, "__e string, __el string, __ec string")
    base = basename(F.col("path"))
    ext = F.regexp_extract(base, "^.+\\.([a-z0-9]+)$", 1)
    out = files.withColumn("__b", F.split(base, "\\.")[0]).withColumn("__x", ext)
    out = out.join(F.broadcast(names), F.col("__b") == F.col("__n"), "left").join(F.broadcast(exts), F.col("__x") == F.col("__e"), "left")
    return out.select(*files.columns, F.coalesce("__nl", "__el").alias("language"), F.coalesce("__nc", "__ec").alias("category"))


def manifest_kind(path: Column) -> Column:
    """The ecosystem whose manifest a path is; null where it is none."""
    out = F.when(path.rlike("(?i)\\.(csproj|fsproj)$"), "nuget")
    for name, ecosystem in MANIFESTS:
        out = F.when(basename(path) == name, ecosystem).otherwise(out)
    return out


def included(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits one of the patterns; without patterns every path does."""
    out = F.lit(not patterns)
    for regex, _ in ignore_rules(patterns):
        out |= path.rlike(regex)
    return out


def find_files(files: DataFrame, name: str) -> DataFrame:
    """Files of a base name in any case."""
    return files.where(basename(F.col("path")) == name.lower())


def text_files(files: DataFrame) -> DataFrame:
    """Files whose text was read."""
    return files.where(F.col("text").isNotNull())


def file_route(path: Column) -> Column:
    """The URL of a route file below app/ or pages/; null for other files.

    Groups in parentheses fall out, [name] and [...name] become parameters, the
    file's own name falls out where it is route, page or index.
    """
    below = F.regexp_extract(path, "^(?:.*/)?(?:src/)?(?:app|pages)/(.*)\\.(?:ts|tsx|js|jsx)$", 1)
    kept = F.filter(F.split(below, "/"), lambda s: ~s.rlike("^\\(.*\\)$") & (s != ""))
    last = F.element_at(kept, -1)
    kept = F.when(last.isin("route", "page", "index"), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    parts = F.transform(kept, lambda s: F.regexp_replace(F.regexp_replace(s, "^\\[\\[?\\.\\.\\.([A-Za-z0-9_]+)\\]\\]?$", ":$1*"), "^\\[([A-Za-z0-9_]+)\\]$", ":$1"))
    return F.when(below != "", F.concat(F.lit("/"), F.array_join(parts, "/")))


#: Signatures of a stack: name, what kind of evidence, the value that is evidence.
STACK = (
    ("react", "package", "react"), ("vue", "package", "vue"), ("django", "package", "django"), ("flask", "package", "flask"), ("express", "package", "express"),
    ("next", "package", "next"), ("next", "file", "next.config.js"), ("docker", "file", "dockerfile"), ("kubernetes", "path", "k8s/"), ("terraform", "path", "terraform/"),
    ("github-actions", "path", ".github/workflows/"), ("typescript", "package", "typescript"), ("typescript", "file", "tsconfig.json"), ("postgres", "package", "pg"),
)
CONFIDENCE = {"package": 0.95, "file": 0.75, "path": 0.70}


def detect_stack(dependencies: DataFrame, files: DataFrame, signatures: tuple = STACK) -> DataFrame:
    """(project, technology, confidence, evidence) of projects' dependencies (project, name) and files (project, path).

    Confidence is that of the best kind of evidence and 0.02 more for every
    further piece, 1 at most. Evidence meets the few signatures by equality; a
    path is taken by every folder it lies in.
    """
    known = dependencies.sparkSession.createDataFrame(signatures, "technology string, kind string, value string")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"), F.lit("/")))
    seen = (
        dependencies.select("project", F.lit("package").alias("kind"), F.lower("name").alias("value"))
        .union(files.select("project", F.lit("file"), basename(F.col("path"))))
        .union(files.where(F.col("path").contains("/")).select("project", F.lit("path").alias("kind"), F.explode(folders).alias("value")))
    )
    met = seen.join(F.broadcast(known), ["kind", "value"]).select("project", "technology", "kind", "value").distinct()
    base = F.lit(0.0)
    for kind, share in CONFIDENCE.items():
        base = F.when(F.col("kind") == kind, share).otherwise(base)
    out = met.groupBy("project", "technology").agg(F.max(base).alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("evidence"))
    return out.select("project", "technology", F.round(F.least(F.col("best") + 0.02 * (F.col("n") - 1), F.lit(1.0)), 4).alias("confidence"), F.array_join("evidence", " ").alias("evidence"))


def without_comments(code: Column, style: str = "c") -> Column:
    """Code with comments blanked but their line ends kept; quoted text is passed over whole."""
    quoted = "\"(?:[^\"\\\\\n]|\\\\.)*+\"|'(?:[^'\\\\\n]|\\\\.)*+'"
    comment = {"c": "/\\*(?:[^*]|\\*(?!/))*+\\*/|//[^\n]*+", "hash": "#[^\n]*+", "sql": "--[^\n]*+", "html": "<!--(?:[^-]|-(?!->))*+-->"}[style]
    rest = "[^\"'/#<-]++|[\\s\\S]"
    parts = F.regexp_extract_all(code, F.lit(f"({comment}|{quoted}|{rest})"), F.lit(1))
    first = {"c": "^(/\\*|//)", "hash": "^#", "sql": "^--", "html": "^<!--"}[style]
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(first), F.regexp_replace(p, "[^\n]", "")).otherwise(p)), "")


def parameter_count(header: Column) -> Column:
    """Parameters between the first parenthesis of a header and the one that closes it; a trailing comma adds none.

    Commas inside brackets of any depth do not part parameters; the arrow => closes nothing.
    """
    chars = F.split(F.regexp_replace(F.substring(header, F.greatest(F.locate("(", header), F.lit(1)), F.length(header)), "=>", "  "), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("count"), F.lit(False).alias("some"), F.lit(False).alias("closed"))

    def step(s: Column, c: Column) -> Column:
        depth = s.depth + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)
        ends = (c == ",") & (s.depth == 1)
        closed = (depth == 0) & (s.depth == 1)
        count = s.count + F.when((ends | closed) & s.some, 1).otherwise(0)
        some = F.when(ends, F.lit(False)).otherwise(s.some | ((s.depth > 0) & ~c.rlike("^\\s?$")))
        fresh = F.struct(depth.alias("depth"), count.alias("count"), some.alias("some"), closed.alias("closed"))
        return F.when(s.closed, s).otherwise(fresh)

    return F.when(header.contains("("), F.aggregate(chars, start, step, lambda s: s.count)).otherwise(0)


def brace_functions(ls: DataFrame, key: str = "path", header: str = "\\bfunction\\s+([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(|\\bfunc\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\(") -> DataFrame:
    """(key, name, line_no, end_line, lines, parameters, complexity) of functions in braces.

    A function ends at the first line, its header or later, whose running depth
    is no more than before the header; found with a window, line by line.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    delta = F.regexp_count("line", F.lit("\\{")) - F.regexp_count("line", F.lit("\\}"))
    depth = ls.withColumn("depth", F.sum(delta).over(w)).withColumn("before", F.col("depth") - delta)
    name = F.coalesce(F.nullif(F.regexp_extract("line", header, 1), F.lit("")), F.nullif(F.regexp_extract("line", header, 2), F.lit("")))
    heads = depth.select(key, F.col("line_no").alias("line_no"), "before", name.alias("name"), parameter_count(F.col("line")).alias("parameters")).where("name is not null")
    after = depth.select(key, F.col("line_no").alias("at"), "depth", "line")
    joined = heads.join(after, key).where("at >= line_no")
    ends = joined.groupBy(key, "line_no", "name", "parameters").agg(F.coalesce(F.min(F.when(F.col("depth") <= F.col("before"), F.col("at"))), F.max("at")).alias("end_line"))
    body = ends.join(after, key).where("at >= line_no and at <= end_line").groupBy(key, "line_no", "name", "parameters", "end_line")
    return body.agg(complexity(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s.line), "\n")).alias("complexity")).withColumn("lines", F.col("end_line") - F.col("line_no") + 1)


def imports(ls: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, specifier, kind): what lines bring in, once a line."""
    rules = (
        ("static", "^\\s*(?:import|export)\\b[^'\"]*from\\s+['\"]([^'\"]+)['\"]"), ("side-effect", "^\\s*import\\s+['\"]([^'\"]+)['\"]"),
        ("require", "require\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"), ("dynamic", "import\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)"),
        ("python-from", "^\\s*from\\s+([A-Za-z0-9_.]+)\\s+import\\b"), ("python", "^\\s*import\\s+([A-Za-z0-9_.]+)\\s*(?:as\\b.*)?$"),
    )

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda s: F.struct(s.alias("specifier"), F.lit(kind).alias("kind")))

    hits = [found(k, p) for k, p in rules]
    return ls.select(key, "line_no", F.explode(F.flatten(F.array(*hits))).alias("i")).select(key, "line_no", "i.*").dropDuplicates([key, "line_no", "specifier"])


def package_name(specifier: Column) -> Column:
    """The package of a bare specifier; two segments where it has a scope."""
    plain = F.regexp_replace(specifier, "^node:", "")
    return F.when(plain.rlike("^[./]"), None).otherwise(F.regexp_extract(plain, "^(@[^/]+/[^/]+|[^/]+)", 1))


def ignore_rules(patterns: list[str]) -> list[tuple[str, bool]]:
    """(regex over paths, negated) for lines in the manner of ignore files, in order."""
    out = []
    for line in patterns:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated, p = p.startswith("!"), p.lstrip("!")
        anchored, folder = "/" in p.rstrip("/"), p.endswith("/")
        body = ""
        for part in re.split(r"(\*\*/|\*\*|\*|\?)", p.strip("/")):
            body += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
        out.append(("^" + ("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + "$", negated))
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is left out; the last rule that fits decides."""
    out = F.lit(False)
    for regex, negated in ignore_rules(patterns):
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def snapshot(spark: SparkSession, root: str, patterns: list[str] | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, bytes, binary, text) of the files under root; ignored paths are not read, large ones give no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    short = F.regexp_replace(at, "^" + re.escape("/" + root.split(":")[-1].strip("/") + "/"), "")
    kept = raw.where(~ignored(short, patterns or [])).select(short.alias("path"), F.col("length").alias("bytes"), "content")
    return kept.select("path", "bytes", looks_binary(F.col("content")).alias("binary"), F.when((F.col("bytes") <= most_bytes) & ~looks_binary(F.col("content")), decoded(F.col("content"))).alias("text"))


def looks_binary(content: Column) -> Column:
    """A zero among the first 8000 bytes, or more than three in ten control bytes."""
    head = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")
    odd = F.regexp_count(head, F.lit("[\\x01-\\x08\\x0E-\\x1F]"))
    return head.contains("\x00") | (odd > F.length(head) * 0.3)


def decoded(content: Column) -> Column:
    """UTF-8 with broken bytes replaced and a mark of byte order left out."""
    return F.regexp_replace(F.call_function("make_valid_utf8", content.cast("string")), "^\\x{FEFF}", "")


def line_dependencies(ls: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, range) of lines like name[extras]==1.2 ; marker."""
    found = "^\\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\\[[^\\]]*\\])?\\s*((?:[=<>!~]=?|===)[^;#]*)?"
    name = F.regexp_extract("line", found, 1)
    return ls.where(~F.col("line").rlike("^\\s*(#|-|$)") & (name != "")).select(key, "line_no", F.lower(name).alias("name"), F.trim(F.regexp_extract("line", found, 2)).alias("range"))


def section_dependencies(ls: DataFrame, sections: str, key: str = "path") -> DataFrame:
    """(key, section, name, range) of key = value lines under section headers that match."""
    w = Window.partitionBy(key).orderBy("line_no")
    head = F.nullif(F.regexp_extract("line", "^\\s*\\[([^\\]]+)\\]\\s*$", 1), F.lit(""))
    inside = ls.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.col("section").rlike(sections))
    pair = "^\\s*\"?([A-Za-z0-9_.-]+)\"?\\s*=\\s*\"?([^\"#]*)"
    return inside.select(key, "section", F.regexp_extract("line", pair, 1).alias("name"), F.trim(F.regexp_extract("line", pair, 2)).alias("range")).where("name <> ''")


def json_dependencies(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, scope, name, range) of manifests that hold maps of ranges."""
    scopes = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
    schema = ", ".join(f"`{s}` map<string,string>" for s in scopes)
    parsed = files.select(key, F.from_json("text", schema).alias("m"))
    each = [parsed.select(key, F.lit(kind).alias("scope"), F.explode(f"m.{s}").alias("name", "range")) for s, kind in scopes.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def route_template(path: Column) -> Column:
    """Parameters of any spelling, numbers and hashes as :id."""
    named = F.regexp_replace(path, "\\{([^}]+)\\}|<(?:[a-z]+:)?([^>]+)>|\\[(?:\\.\\.\\.)?([^\\]]+)\\]", ":id")
    return F.regexp_replace(named, "/(?:[0-9]+|[0-9a-f]{16,})(?=/|$)", "/:id")


def _keyed_templates(templates: DataFrame) -> DataFrame:
    """(template, shape, key): what a path that fits a template has for sure.

    The shape says how a path's key is cut: of each segment a parameter gives *, one with
    dots a mask of its characters, any other itself. A dot of a template stands for any character, so
    there is a row for each choice of a slash in its place. Templates whose parameters are parts of segments,
    with other signs of expressions or with more than four dots go by the text before the first sign.
    """
    sign, slot = "[\\\\^$|?*+()\\[\\]{}]", "^:[a-z]+$"
    segments = F.split("template", "/")
    odd = F.col("template").rlike(sign) | F.exists(segments, lambda s: s.rlike(":[a-z]") & ~s.rlike(slot)) | (F.regexp_count("template", F.lit("\\.")) > 4)
    parts = F.split("template", "\\.")
    either = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(parts[0]), lambda done, p: F.concat(F.transform(done, lambda d: F.concat(d, F.lit("."), p)), F.transform(done, lambda d: F.concat(d, F.lit("/"), p))))
    shape = lambda s: F.when(s.rlike(slot), "*").when(s.contains("."), F.regexp_replace(s, "[^.]", "x")).otherwise("")
    key = lambda s: F.when(s.rlike(slot), "*").otherwise(s)
    joined = lambda f: F.array_join(F.transform(F.split("way", "/"), f), "/")
    even = templates.where(~odd).select("template", F.explode(either).alias("way")).select("template", joined(shape).alias("shape"), joined(key).alias("key"))
    before = F.split("template", f":[a-z]|[.]|{sign}", 2)[0]
    # A sign of repetition is about the character before it.
    sure = F.length(before) - F.substring(F.col("template"), F.length(before) + 1, F.lit(1)).isin("?", "*", "+", "{").cast("int")
    size = F.when(F.col("template").contains("|"), 0).otherwise(F.greatest(sure, F.lit(0)))
    return even.unionByName(templates.where(odd).select("template", F.concat(F.lit("first "), size).alias("shape"), F.substring(F.col("template"), F.lit(1), size).alias("key")))


def _keyed_paths(requests: DataFrame, shapes: DataFrame) -> DataFrame:
    """(request_id, path, shape, key): the key of every path in every shape (shape) that it can have."""
    size = F.regexp_extract("shape", "^first ([0-9]+)$", 1)
    lead = shapes.where(size != "").select("shape", size.cast("int").alias("size"))
    led = requests.join(F.broadcast(lead), F.length("path") >= F.col("size")).select("request_id", "path", "shape", F.substring(F.col("path"), F.lit(1), F.col("size")).alias("key"))
    even = shapes.where(size == "").select("shape", F.split("shape", "/").alias("masks")).withColumn("n", F.size("masks"))
    cut = requests.select("request_id", "path", F.split("path", "/").alias("segments")).withColumn("n", F.size("segments")).join(F.broadcast(even), "n")
    fits = F.forall(F.zip_with("segments", "masks", lambda s, m: m.isin("", "*") | (F.length(s) == F.length(m))), lambda ok: ok)
    masked = lambda s, m: F.array_join(F.zip_with(F.split(s, ""), F.split(m, ""), lambda c, x: F.when(x == ".", x).otherwise(c)), "")
    key = F.zip_with("segments", "masks", lambda s, m: F.when(m == "", s).when(m == "*", m).otherwise(masked(s, m)))
    return led.unionByName(cut.where(fits).select("request_id", "path", "shape", F.array_join(key, "/").alias("key")))


def match_routes(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """requests (request_id, path) with the template that fits: fewest parameters, then the longest.

    Parameters are :name; the rest of a template is read as an expression, as its SQL does. Templates
    meet requests on keys cut in the few shapes that templates have, so this is an equi-join
    with a check, no product, however many templates differ in literal text alone.
    """
    t = _keyed_templates(templates.where("template is not null").distinct())
    asked = _keyed_paths(requests, t.select("shape").distinct())
    regex = F.concat(F.lit("(?d)^(?:"), F.regexp_replace("template", ":[a-z]+", "[^/]+"), F.lit(")\\z"))
    fit = asked.join(t, ["shape", "key"]).where(F.rlike("path", regex))
    rank = F.struct(F.regexp_count("template", F.lit(":[a-z]+")), -F.length("template"), "template")
    best = fit.groupBy("request_id").agg(F.min_by("template", rank).alias("template"))
    return requests.join(best, "request_id", "left")


def table_definitions(statements: DataFrame, key: str) -> DataFrame:
    """(key, entity, column, type, role) of CREATE TABLE statements; PK, FK or UK where a clause says so."""
    entity = F.lower(F.regexp_extract("ddl", "(?i)create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?[\"`]?([A-Za-z0-9_.]+)", 1))
    clauses = F.split(F.regexp_extract("ddl", "(?s)\\((.*)\\)", 1), ",(?![^()]*\\))")
    each = statements.select(key, entity.alias("entity"), F.explode(F.transform(clauses, lambda c: F.trim(c))).alias("clause"))
    column = "^[\"`]?([A-Za-z_][A-Za-z0-9_]*)[\"`]?\\s+([A-Za-z]+)"
    role = F.when(F.col("clause").rlike("(?i)primary key"), "PK").when(F.col("clause").rlike("(?i)references"), "FK").when(F.col("clause").rlike("(?i)\\bunique\\b"), "UK")
    return each.where(~F.col("clause").rlike("(?i)^(primary|foreign|unique|constraint|check)\\b")).select(
        key, "entity", F.lower(F.regexp_extract("clause", column, 1)).alias("column"), F.lower(F.regexp_extract("clause", column, 2)).alias("type"), role.alias("role"),
        F.nullif(F.lower(F.regexp_extract("clause", "(?i)references\\s+[\"`]?([A-Za-z0-9_]+)", 1)), F.lit("")).alias("refers_to"),
    )


def diff_lines(raw: DataFrame, key: str) -> DataFrame:
    """(key, file, kind, new_line, text) of unified diffs given as (key, line_no, line).

    The file is the last header seen; a new line's number is its hunk's start and
    the count of kept and added lines since.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    name = F.nullif(F.regexp_extract("line", "^\\+\\+\\+ (?:b/)?(.+)$", 1), F.lit(""))
    hunk = F.regexp_extract("line", "^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)", 1)
    marked = raw.withColumn("file", F.last(name, ignorenulls=True).over(w)).withColumn("start", F.when(hunk != "", hunk.cast("int")))
    marked = marked.withColumn("hunk", F.count("start").over(w)).withColumn("base", F.last("start", ignorenulls=True).over(w))
    body = marked.where("hunk > 0 and start is null").where(~F.col("line").rlike("^(diff |index |--- |\\+\\+\\+ )"))
    kind = F.when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "remove").otherwise("context")
    h = Window.partitionBy(key, "hunk").orderBy("line_no")
    numbered = body.withColumn("kind", kind).withColumn("new_line", F.col("base") - 1 + F.count_if(F.col("kind") != "remove").over(h))
    return numbered.select(key, "file", "kind", F.when(F.col("kind") != "remove", F.col("new_line")).alias("new_line"), F.substring("line", 2, 1_000_000).alias("text"))
