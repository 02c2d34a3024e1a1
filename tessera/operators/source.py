"""Source files by language: lines, branches, function spans, imports, layers, manifests and registered routes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.code import basename, parameter_count, with_language
from tessera.operators.graph import folded
from tessera.operators.lines import nesting

_TEXT = "\"(?:[^\"\\\\\n]|\\\\[^\n])*+\"|'(?:[^'\\\\\n]|\\\\[^\n])*+'"
_BACK = "`(?:[^`\\\\]|\\\\[\\s\\S])*+`"
_SLASH = "/\\*(?:[^*]|\\*(?!/))*+(?:\\*/)?|//[^\n]*+"
_DOC = "\"\"\"(?:[^\"]|\"(?!\"\"))*+(?:\"\"\")?|'''(?:[^']|'(?!''))*+(?:''')?"
#: Family of a language: what a comment is, what a literal is, what begins a comment.
SYNTAX = {
    "c": (_SLASH, f"{_TEXT}|{_BACK}", "^(?:/\\*|//)"),
    "python": (f"{_DOC}|#[^\n]*+", _TEXT, "^(?:#|\"\"\"|''')"),
    "hash": ("#[^\n]*+", _TEXT, "^#"),
    "sql": ("--[^\n]*+|/\\*(?:[^*]|\\*(?!/))*+(?:\\*/)?", _TEXT, "^(?:--|/\\*)"),
    "html": ("<!--(?:[^-]|-(?!->))*+(?:-->)?", _TEXT, "^<!--"),
}
FAMILIES = {
    "c": ("typescript", "javascript", "go", "rust", "java", "c", "cpp", "csharp", "kotlin", "swift", "php", "dart", "scala", "css", "scss", "less", "protobuf"), "python": ("python",),
    "hash": ("ruby", "yaml", "toml", "make", "dockerfile", "shell", "terraform", "graphql", "elixir"), "sql": ("sql",), "html": ("html", "markdown", "xml", "vue", "svelte"),
}
# The words of each language that add a branch, and the operators that do.
BRANCH_WORDS = {
    "c": ("if", "for", "while", "case", "catch", "goto"),
    "python": ("if", "elif", "for", "while", "except", "assert", "with"),
    "go": ("if", "for", "case", "select"),
    "ruby": ("if", "elsif", "unless", "for", "while", "until", "when", "rescue"),
    "default": ("if", "elif", "for", "while", "case", "catch", "and", "or"),
}
BRANCH_SIGNS = "&&|\\|\\||\\?\\?|\\?"


def stripped(code: Column, language: Column, literals: bool = True) -> Column:
    """Code without its comments, line ends kept; without literals their insides go as well.

    One pass of alternatives, tried comment first, so a quote in a comment or a
    comment sign in a literal means nothing. Languages without a family stay as they are.
    """
    out = code
    for family, (comment, literal, first) in SYNTAX.items():
        parts = F.regexp_extract_all(code, F.lit(f"({comment}|{literal}|[^\"'`/#<-]++|[\\s\\S])"), F.lit(1))

        out = F.when(language.isin(*FAMILIES[family]), F.array_join(F.transform(parts, _cleaner(first, literals)), "")).otherwise(out)
    return out


def _cleaner(first: str, literals: bool):
    """What becomes of a piece of code: comments go, and literals' insides where they are not wanted."""

    def clean(p: Column) -> Column:
        gone = F.when(p.rlike(first), F.regexp_replace(p, "[^\n]", ""))
        if not literals:
            gone = gone.when((F.length(p) > 1) & p.rlike("^[\"'`]"), F.concat(F.lit('"'), F.regexp_replace(p, "[^\n]", ""), F.lit('"')))
        return gone.otherwise(p)

    return clean


def line_totals(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, language, total, code, comment, blank) of files (key, language, text).

    A line that the strip leaves empty is a comment, one that was empty is blank.
    Everything happens in the row of the file: nothing is exploded or shuffled.
    Null text has one empty line.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\\n\\z", "")
    both = files.select(key, "language", F.split(body, "\n").alias("__raw"), F.split(stripped(body, F.col("language")), "\n").alias("__left"))
    full = lambda c: F.size(F.filter(c, lambda s: F.trim(F.translate(s, "\t\r", "  ")) != ""))
    counted = both.select(key, "language", F.size("__raw").alias("total"), full(F.col("__raw")).alias("__some"), full(F.col("__left")).alias("code"))
    return counted.select(key, "language", "total", "code", (F.col("__some") - F.col("code")).alias("comment"), (F.col("total") - F.col("__some")).alias("blank"))


def branches(code: Column, language: Column) -> Column:
    """Words and signs that add a branch to stripped code, by the language's own set."""
    words = lambda k: F.regexp_count(code, F.lit("\\b(?:" + "|".join(BRANCH_WORDS[k]) + ")\\b"))
    signs = F.regexp_count(code, F.lit(BRANCH_SIGNS))
    return (
        F.when(language == "python", words("python")).when(language == "ruby", words("ruby")).when(language == "go", words("go") + signs)
        .when(language.isin("c", "java"), words("c") + signs).otherwise(words("default") + signs)
    )


def _indent(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, "^([ \t]*)", 1), "\t", "    "))


def depth(code: Column, language: Column) -> Column:
    """Deepest braces of stripped code; in Python the deepest indentation in steps of four."""
    steps = F.transform(F.filter(F.split(code, "\n"), lambda s: F.trim(s) != ""), lambda s: F.floor(_indent(s) / 4).cast("int"))
    return F.when(language == "python", F.coalesce(F.array_max(steps), F.lit(0))).otherwise(nesting(code))


_FLAT = "[^(){}]"
#: Parameters in parentheses, three levels deep; in those of a named header braces may stand as well.
_ARGS = f"\\((?:{_FLAT}|\\((?:{_FLAT}|\\({_FLAT}*+\\))*+\\))*+\\)"
_WIDE = "\\((?:[^()]|\\((?:[^()]|\\([^()]*+\\))*+\\))*+\\)"
#: A header up to its body, over any number of lines.
_HEAD = f"\\b(?:(?:function\\b|def\\b|fn\\b|func\\b)[^\\n(]*+{_WIDE}|[\\w$]++[ \\t]*+{_ARGS})(?:[^\\n(){{}};=]*+\\n\\s*+(?=\\{{))?"
#: Words before a parenthesis that name no function.
_CONTROL = "(?!(?:if|for|while|switch|catch|return|with|do|else|elif|new|throw|function|super|typeof|await|sizeof|case)\\b)"
_BODY = "\\s*(?::[^{};=]+)?\\{"
HEADERS = {
    "python": ("^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(",),
    "ruby": ("^\\s*def\\s+([\\w.]+[?!=]?)",),
    "go": ("^\\s*func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)\\s*[\\[(]",),
    "rust": ("\\bfn\\s+(\\w+)\\s*[<(]",),
    "typescript": (
        "\\bfunction\\s*\\*?\\s*([\\w$]+)\\s*[<(]",
        "\\b(?:const|let|var)\\s+([\\w$]+)\\s*(?::[^=]+)?=\\s*(?:async\\s*)?(?:function\\b|\\([^)]*\\)[^=]*=>)",
        f"^\\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\\s+)*[*#]?{_CONTROL}([\\w$]+)\\s*(?:<[^>]*>)?{_WIDE}{_BODY}",
    ),
    "java": (f"^\\s*(?:{_CONTROL}[\\w<>\\[\\],.&*:~]+\\s+)+[*&]*{_CONTROL}(\\w+)\\s*{_ARGS}\\s*(?:\\b(?:const|noexcept|override|throws\\s+[\\w.,\\s]+))*\\{{",),
}
_LIKE = {"javascript": "typescript", "c": "java", "cpp": "java", "csharp": "java"}
#: Stands for a line end inside a header.
_INNER = "\x1f"


def whole_headers(code: Column) -> Column:
    """Stripped code in which a header that takes several lines is one, its line ends kept as marks.

    A header is a name with its balanced parentheses, and a line end after it
    where the body's brace follows. Calls that hold braces stay as they are.
    """
    parts = F.regexp_extract_all(code, F.lit(f"({_HEAD}|[\\w$]++|[^\\w$]++)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[\\w$]") & p.contains("\n"), F.translate(p, "\n", _INNER)).otherwise(p)), "")


def function_units(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, language, name, line_no, end_line, lines, parameters, complexity) of the functions of files (key, language, text).

    Functions, methods and arrows by their headers, which may take several lines and
    have their brace on the next. Spans are of whole lines. In braces a function ends
    where the running depth is back to that before its header; by indentation, just
    before the next full line no deeper than the header; else at the file's last line.
    Each line announces the levels it closes, and the first announcement of a header's
    level after it is its end, so one sort by file and level finds all; branches come from
    running sums. Files of other languages give no row.
    """
    known = [*HEADERS, *_LIKE]
    text = stripped(F.regexp_replace(F.coalesce("text", F.lit("")), "\\n\\z", ""), F.col("language"), literals=False)
    ls = files.where(F.col("language").isin(*known)).select(key, "language", F.posexplode(F.split(whole_headers(text), "\n")).alias("at", "line"))
    by_indent, order = F.col("language").isin("python", "ruby"), Window.partitionBy(key).orderBy("at")
    ls = ls.withColumn("extra", F.length("line") - F.length(F.replace("line", F.lit(_INNER), F.lit(""))))
    ls = ls.withColumn("last", (F.col("at") + 1 + F.sum("extra").over(order)).cast("int")).withColumn("line_no", (F.col("last") - F.col("extra")).cast("int"))
    full = F.trim(F.translate("line", _INNER, " ")) != ""
    braces = F.regexp_count("line", F.lit("\\{")) - F.regexp_count("line", F.lit("\\}"))
    ls = ls.withColumn("sum", F.sum(branches(F.col("line"), F.col("language"))).over(order))
    ls = ls.withColumn("level", F.when(by_indent, F.when(full, _indent(F.col("line")))).otherwise(F.sum(braces).over(order)))
    ls = ls.withColumn("before", F.coalesce(F.last("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ls = ls.withColumn("sum_before", F.coalesce(F.lag("sum").over(order), F.lit(0)))
    whole = Window.partitionBy(key)
    ls = ls.withColumn("file_end", F.struct(F.max("last").over(whole).alias("line"), F.max("sum").over(whole).alias("sum")))

    name, flat = F.lit(None).cast("string"), F.translate("line", _INNER, " ")
    for language, patterns in HEADERS.items():
        got = F.coalesce(*[F.nullif(F.regexp_extract(flat, p, 1), F.lit("")) for p in patterns])
        same = [language, *[k for k, v in _LIKE.items() if v == language]]
        name = F.when(F.col("language").isin(*same), got).otherwise(name)
    head = F.when(full & name.isNotNull(), F.struct(F.when(by_indent, F.col("level")).otherwise(F.col("before")).alias("level"), F.lit(True).alias("head")))
    closes = F.when(by_indent & full, F.sequence("level", F.greatest("level", "before"))).when(
        ~by_indent & (F.col("level") < F.col("before")), F.sequence("level", F.col("before") - 1)
    )
    none = F.array().cast("array<struct<level:bigint,head:boolean>>")
    marks = F.concat(
        F.coalesce(F.transform(closes, lambda v: F.struct(v.alias("level"), F.lit(False).alias("head"))), none), F.when(head.isNotNull(), F.array(head)).otherwise(none)
    )
    events = ls.withColumn("name", name).withColumn("mark", F.explode(marks)).select("*", F.col("mark.level").alias("of"), F.col("mark.head").alias("head"))
    # An indented line closes after the line before it and at its own branches' start.
    close = F.when(~F.col("head"), F.struct(F.when(by_indent, F.col("line_no") - 1).otherwise(F.col("last")).alias("line"), F.when(by_indent, F.col("sum_before")).otherwise(F.col("sum")).alias("sum")))
    later = Window.partitionBy(key, "of").orderBy("line_no").rangeBetween(1, Window.unboundedFollowing)
    ended = events.withColumn("close", close).withColumn("end", F.min("close").over(later)).where("head")
    own = F.when(~by_indent & (F.col("level") <= F.col("before")), F.struct(F.col("last").alias("line"), F.col("sum").alias("sum")))
    ended = ended.withColumn("end", F.coalesce(own, "end", "file_end"))
    bare = F.regexp_replace(flat.substr(F.lit(1), F.length(flat)), "^\\s*func\\s*\\([^)]*\\)", "func")
    return ended.select(
        key, "language", "name", "line_no", F.col("end.line").alias("end_line"), (F.col("end.line") - F.col("line_no") + 1).alias("lines"),
        parameter_count(bare).alias("parameters"), (1 + F.col("end.sum") - F.col("sum_before")).alias("complexity"),
    )


#: Statements that may take several lines: lists of names from a module, blocks of modules.
_STATEMENT = (
    "\\b(?:import|export)\\b[^;'\"`()=]*?\\bfrom\\s*[\"'][^\"'\\n]+[\"']|\\bfrom[ \\t]+[\\w.]+[ \\t]+import[ \\t]*\\([^)]*+\\)|\\bimport[ \\t]*\\(\\s*+(?:[\\w.]*[ \\t]*\"[^\"\\n]*\"\\s*+)++\\)|\\buse\\s[^;]*+;"
)
_QUOTE = "[\"']([^\"'\\n]+)[\"']"
#: Of each language: kind, where it is looked for in a line, and what in the found part names a module.
IMPORTS = {
    "javascript": (
        ("static", f"^\\s*import\\b[^'\"]*\\bfrom\\s*{_QUOTE}", _QUOTE), ("reexport", f"^\\s*export\\b[^'\"]*\\bfrom\\s*{_QUOTE}", _QUOTE), ("side-effect", f"^\\s*import\\s*{_QUOTE}", _QUOTE),
        ("require", f"\\brequire\\(\\s*{_QUOTE}\\s*\\)", _QUOTE), ("dynamic", f"\\bimport\\(\\s*{_QUOTE}\\s*\\)", _QUOTE),
    ),
    "python": (("static", "^\\s*from\\s+[\\w.]+\\s+import\\b", "from\\s+([\\w.]+)"), ("static", "^\\s*import\\s+[^(]+$", "(?:import|,)\\s+([\\w.]+)")),
    "go": (("static", "^\\s*import\\b.*", "\"([^\"]+)\""),),
    "rust": (("static", "^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?use\\s+[\\w:]+", "use\\s+([\\w:]*\\w)"), ("module", "^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?mod\\s+\\w+\\s*;", "mod\\s+(\\w+)")),
    "java": (("static", "^\\s*import\\s+[\\w.*\\s]+;?", "import\\s+(?:static\\s+)?((?:\\w+\\.)*(?:\\w+|\\*))"),),
    "ruby": (("require", f"^\\s*require(?:_relative)?\\s*\\(?\\s*{_QUOTE}", _QUOTE),),
    "c": (("include", "^\\s*#\\s*include\\s*[<\"][^>\"]+[>\"]", "[<\"]([^>\"]+)[>\"]"),),
    "css": (("static", "@(?:import|use|forward)\\s+(?:url\\()?[\"']?[^\"')\\s;]+", "(?:@\\w+\\s+)(?:url\\()?[\"']?([^\"')\\s;]+)"),),
}
_IMPORTS_LIKE = {"typescript": "javascript", "vue": "javascript", "svelte": "javascript", "kotlin": "java", "scala": "java", "cpp": "c", "scss": "css", "less": "css"}


def module_imports(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, language, line_no, specifier, kind) of what files (key, language, text) bring in, once a line.

    Comments are gone before statements are looked for, and a statement over several lines
    counts where it begins; a list of modules gives one row for each.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\\n\\z", "")
    known = [*IMPORTS, *_IMPORTS_LIKE]
    parts = F.regexp_extract_all(stripped(body, F.col("language")), F.lit(f"({_STATEMENT}|[\\w$]++|[^\\w$]++)"), F.lit(1))
    whole = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^(?:import|export|from|use)\\b") & p.contains("\n"), F.translate(p, "\n", _INNER)).otherwise(p)), "")
    ls = files.where(F.col("language").isin(*known)).select(key, "language", F.posexplode(F.split(whole, "\n")).alias("at", "line"))
    extra = F.length("line") - F.length(F.replace("line", F.lit(_INNER), F.lit("")))
    hint = F.col("line").rlike("\\b(?:import|export|from|require|require_relative|use|mod|include|forward)\\b")
    before = F.sum(extra).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ls = ls.withColumn("line_no", (F.col("at") + 1 + F.coalesce(before, F.lit(0))).cast("int")).where(hint)
    flat = F.translate("line", _INNER, " ")
    none, found = F.array().cast("array<struct<kind:string,specifier:string>>"), None
    for language, rules in IMPORTS.items():
        named = lambda kind, where, what: F.transform(
            F.flatten(F.transform(F.regexp_extract_all(flat, F.lit(where), F.lit(0)), lambda h: F.regexp_extract_all(h, F.lit(what), F.lit(1)))), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("specifier"))
        )
        same = [language, *[k for k, v in _IMPORTS_LIKE.items() if v == language]]
        mine = F.when(F.col("language").isin(*same), F.concat(*[named(*r) for r in rules]))
        found = mine if found is None else F.coalesce(found, mine)
    rows = ls.select(key, "language", "line_no", F.explode(F.coalesce(found, none)).alias("i")).select(key, "language", "line_no", "i.specifier", "i.kind")
    return rows.groupBy(key, "language", "line_no", "specifier").agg(F.min("kind").alias("kind"))


# Extensions tried for a specifier without one, in order, and names that stand for their folder.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "vue", "svelte", "py", "go", "rs", "css", "scss", "json")
INDEX_NAMES = ("index", "__init__", "mod", "main")


def module_keys(files: DataFrame) -> DataFrame:
    """(wanted, path): under which spellings each file of files (path) is found, the best file for each.

    A file offers its own path; the path without its extension; its folder where
    it is an index; and, for typed sources, the path with the compiled extension.
    So links meet the index by one equality, with no list of candidates a link.
    """
    ext, name = F.element_at(F.split("path", "\\."), -1), F.regexp_extract("path", "([^/]*?)\\.[^./]*$", 1)
    stem = F.regexp_replace("path", "\\.[^./]*$", "")
    place, index = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ext), F.array_position(F.array(*map(F.lit, INDEX_NAMES)), name)
    bare = lambda p: ~F.element_at(F.split(p, "/"), -1).contains(".")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    n = len(EXTENSIONS)
    offers = [F.when(F.lit(True), F.struct(F.col("path").alias("wanted"), F.lit(0).cast("bigint").alias("order")))]
    offers += [F.when((place > 0) & bare(stem), F.struct(stem.alias("wanted"), (place + 10).alias("order")))]
    offers += [F.when((place > 0) & (index > 0) & bare(folder), F.struct(folder.alias("wanted"), (index * n + place + 10).alias("order")))]
    offers += [F.when(place.between(1, 4), F.struct(F.concat(stem, F.lit(f".{e}")).alias("wanted"), place.alias("order"))) for e in ("js", "mjs", "cjs")]
    each = files.select("path", F.explode(F.filter(F.array(*offers), lambda o: o.isNotNull())).alias("o"))
    return each.groupBy("o.wanted").agg(F.min_by("path", F.struct("o.order", "path")).alias("path"))


def aliases(config: DataFrame) -> DataFrame:
    """(prefix, replacement) of configs (text) with compilerOptions.baseUrl and paths; comments and trailing commas are allowed."""
    clean = F.regexp_replace(stripped(F.col("text"), F.lit("typescript")), ",(\\s*[}\\]])", "$1")
    parsed = config.select(F.from_json(clean, "compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>").alias("c")).select("c.compilerOptions.*")
    each = parsed.select("baseUrl", F.explode("paths").alias("prefix", "to")).where("size(to) > 0")
    cut = lambda c: F.regexp_replace(c, "/?\\*$", "")
    return each.select(cut(F.col("prefix")).alias("prefix"), folded(F.concat_ws("/", F.coalesce("baseUrl", F.lit(".")), cut(F.col("to")[0]))).alias("replacement")).where("prefix <> ''")


def resolve_imports(links: DataFrame, files: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """links (path, specifier, ...) with target: the file of files (path) meant, null where none is.

    Aliases in renamed come first, the longest that fits; dots mean Python's
    relative form, ./ and ../ a path from the link's folder, / one from the root,
    and a bare name a file where one has it.
    """
    spec, alias = F.col("specifier"), F.lit(False)
    for prefix, to in sorted((renamed or {}).items(), key=lambda kv: len(kv[0])):
        fits = (F.col("specifier") == prefix) | F.col("specifier").startswith(prefix + "/")
        spec = F.when(fits, F.concat(F.lit(to), F.substring("specifier", len(prefix) + 1, 1 << 20))).otherwise(spec)
        alias = fits | alias
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    dots, tail = F.regexp_extract(spec, "^(\\.+)[\\w.]*$", 1), F.regexp_extract(spec, "^\\.+([\\w.]*)$", 1)
    up = F.when(dots != "", F.repeat(F.lit("../"), F.greatest(F.length(dots) - 1, F.lit(0)).cast("int")))
    base = (
        F.when((dots != "") & ~spec.startswith("./"), folded(F.concat(folder, F.lit("/"), up, F.translate(tail, ".", "/"))))
        .when(spec.startswith("."), folded(F.concat(folder, F.lit("/"), spec)))
        .when(alias | spec.startswith("/"), folded(spec))
        .otherwise(F.translate(spec, ".", "/"))
    )
    found = module_keys(files).withColumnRenamed("path", "target")
    return links.withColumn("wanted", base).join(found, "wanted", "left").drop("wanted")


#: Layer, rank and the names of folders or files that place a path in it; the first that fits counts.
LAYERS = (
    ("test", None, "(^|/)(tests?|__tests__|e2e|spec)/|[._](test|spec)\\.[a-z]+$"), ("configuration", None, "(^|/)(config|settings)(/|\\.)|\\.(json|toml|ya?ml)$"),
    ("operations", None, "(^|/)(infra|deploy|k8s|terraform|scripts|\\.github)/|(^|/)dockerfile$"), ("presentation", 0, "(^|/)(components|pages|views|ui|styles)/"),
    ("interface", 1, "(^|/)(api|routes|controllers|handlers|graphql|cli)/"), ("application", 2, "(^|/)(services|usecases|application|workflows?|jobs)/"),
    ("domain", 3, "(^|/)(domain|models?|entities|core)/"), ("persistence", 4, "(^|/)(db|database|repositories|migrations|storage)/"),
)


def layer_of(path: Column) -> Column:
    """The layer a path lies in; 'shared' where no name says."""
    out = F.lit("shared")
    for layer, _, pattern in reversed(LAYERS):
        out = F.when(F.lower(path).rlike(pattern), layer).otherwise(out)
    return out


def layer_summary(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer, modules, loc, depends_on map of layer to links) of modules (path, loc) and edges (src, dst), both paths."""
    own = modules.select(layer_of(F.col("path")).alias("layer"), "loc").groupBy("layer").agg(F.count("*").alias("modules"), F.sum("loc").alias("loc"))
    between = edges.select(layer_of(F.col("src")).alias("layer"), layer_of(F.col("dst")).alias("to")).where("layer <> to").groupBy("layer", "to").agg(F.count("*").alias("n"))
    out = between.groupBy("layer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("to", "n")))).alias("depends_on"))
    return own.join(out, "layer", "left")


def xml_dependencies(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, ecosystem, name, range, scope) of pom, csproj/fsproj and gradle files (key, text); '*' where no version stands."""
    star = lambda c: F.when(F.trim(c) == "", "*").otherwise(F.trim(c))
    base, text = basename(F.col(key)), F.coalesce("text", F.lit(""))
    pom = files.where(base == "pom.xml").select(key, F.explode(F.regexp_extract_all(text, F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
    tag = lambda t: F.trim(F.regexp_extract("b", f"<{t}>([^<]+)</{t}>", 1))
    maven = pom.where((tag("groupId") != "") & (tag("artifactId") != "")).select(
        key, F.lit("maven").alias("ecosystem"), F.concat(tag("groupId"), F.lit(":"), tag("artifactId")).alias("name"), star(tag("version")).alias("range"),
        F.when(tag("scope") == "test", "development").otherwise("runtime").alias("scope"),
    )
    refs = files.where(base.rlike("\\.(csproj|fsproj)$")).select(key, F.explode(F.regexp_extract_all(text, F.lit("<PackageReference\\s+([^>]*)>"), F.lit(1))).alias("b"))
    field = lambda a: F.regexp_extract("b", f'\\b{a}="([^"]*)"', 1)
    nuget = refs.where(field("Include") != "").select(key, F.lit("nuget").alias("ecosystem"), field("Include").alias("name"), star(field("Version")).alias("range"), F.lit("runtime").alias("scope"))
    line = "\\b((?:implementation|api|compileOnly|runtimeOnly|testImplementation)\\s*\\(?\\s*['\"][^'\":]+:[^'\":]+(?::[^'\"]*)?['\"])"
    calls = files.where(base.rlike("^build\\.gradle(\\.kts)?$")).select(key, F.explode(F.regexp_extract_all(text, F.lit(line), F.lit(1))).alias("b"))
    part = F.split(F.regexp_extract("b", "['\"]([^'\"]+)['\"]", 1), ":")
    gradle = calls.select(
        key, F.lit("maven").alias("ecosystem"), F.concat_ws(":", part[0], part[1]).alias("name"), star(F.coalesce(F.get(part, F.lit(2)), F.lit(""))).alias("range"),
        F.when(F.col("b").startswith("test"), "development").otherwise("runtime").alias("scope"),
    )
    return maven.unionByName(nuget).unionByName(gradle)


# Request methods, and names that route objects usually have.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
ROUTE_OBJECTS = ("app", "router", "server", "api", "fastify", "hono")


@dataclass(frozen=True)
class Framework:
    """How a framework registers routes: what stands before the path, and which files it is looked for in."""

    name: str
    form: str  # call: object.get(..); decorator: @object.get(..); annotation: @GetMapping(..); statement: get ".."
    functions: tuple[str, ...]
    packages: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    files: str = ""


_LOWER = tuple(m.lower() for m in METHODS)
FRAMEWORKS = (
    Framework("express", "call", (*_LOWER, "all"), ("express", "fastify", "hono", "koa"), objects=ROUTE_OBJECTS),
    Framework("fastapi", "decorator", _LOWER, ("fastapi",)),
    Framework("flask", "decorator", ("route",), ("flask",)),
    Framework("go-http", "call", METHODS, languages=("go",)),
    Framework("spring", "annotation", tuple(f"{m.title()}Mapping" for m in METHODS[:5]), languages=("java", "kotlin")),
    Framework("rails", "statement", _LOWER[:5], languages=("ruby",), files="routes.rb"),
)

#: One reader for all: at sign, object, function, how its arguments open, the first literal, and what follows it.
_CALL = (
    "(@?)(?<![\\w.])(?:(\\w+)[ \t]*\\.[ \t]*)?(\\w+)([ \t]*\\(\\s*|[ \t]+)"
    "(?:\\w+[ \t]*=[ \t]*)?[\"'`]([^\"'`\n]+)[\"'`](?=([^)]*))"
)


def _calls(code: DataFrame) -> DataFrame:
    """Calls, decorators and statements of code (path, code, met) whose first argument is a literal."""
    names = ("at", "object", "function", "open", "literal", "rest")
    parts = [F.regexp_extract_all("code", F.lit(_CALL), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return code.select("path", "met", *parts).select("path", "met", F.explode(F.arrays_zip(*names)).alias("c")).select("path", "met", "c.*")


def _is_met(f: Framework, declared: tuple[str, ...]) -> Column:
    """Whether a file is one of a framework: by its language, or a package declared or imported."""
    met = F.col("language").isin(*f.languages) if f.languages else F.lit(bool(set(f.packages) & set(declared)))
    for p in f.packages:
        quoted = reduce(Column.__or__, [F.col("code").contains(f"{q}{p}{q}") for q in ("'", '"')])
        met |= (quoted & F.col("code").rlike("\\b(?:import|require)\\b")) | F.col("code").rlike(f"\\b(?:from|import)[ \t]+{p}\\b")
    return met & F.col("path").endswith(f.files)


def _fits(f: Framework) -> Column:
    """Whether a call has a framework's form."""
    bracket = F.col("open").contains("(")
    form = {
        "call": (F.col("at") == "") & (F.col("object") != "") & bracket,
        "decorator": (F.col("at") == "@") & (F.col("object") != "") & bracket,
        "annotation": (F.col("at") == "@") & (F.col("object") == "") & bracket,
        "statement": (F.col("at") == "") & (F.col("object") == "") & ~bracket,
    }[f.form]
    return form & F.col("function").isin(*f.functions) & (F.col("object").isin(*f.objects) if f.objects else F.lit(True))


def registered_routes(files: DataFrame, declared: tuple[str, ...] = ()) -> DataFrame:
    """(path, framework, method, route) that files (path, text) register.

    A framework is looked for where its language is met, or where one of its packages
    is declared or imported by the file itself. A route with a list of methods gives
    one row for each, GET without one; 'all' is ANY. Files are read once for all frameworks.
    """
    known = with_language(files.select("path", "text"))
    code = known.select("path", "language", stripped(F.coalesce("text", F.lit("")), F.col("language")).alias("code"))
    code = code.withColumn("met", F.array(*[_is_met(f, declared) for f in FRAMEWORKS])).where(F.array_contains("met", True))
    owner = F.array_compact(F.array(*[F.when(F.col("met")[i] & _fits(f), F.lit(f.name)) for i, f in enumerate(FRAMEWORKS)]))
    found = _calls(code).select("path", F.explode(owner).alias("framework"), "function", "literal", "rest")
    listed = F.upper(F.regexp_extract("rest", "\\bmethods[ \t]*=[ \t]*[\\[({]([^\\])}]*)", 1))
    methods = F.filter(F.split(listed, "[^A-Z]+"), lambda m: m.isin(*METHODS))
    own = F.regexp_replace(F.upper("function"), "MAPPING$", "")
    each = F.when(own == "ROUTE", F.when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("GET")))).otherwise(F.array(F.when(own == "ALL", "ANY").otherwise(own)))
    return found.select("path", "framework", F.explode(each).alias("method"), F.concat(F.lit("/"), folded(F.col("literal"))).alias("route"))
