"""Inverted index, batched BM25 retrieval with filters and fuzzy titles, and passages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import exploded_tokens, fuzzy_score, tokens
from tessera.sources.scratch import saved

K1, B, TITLE, FUZZY = 1.5, 0.75, 2.5, 0.15


@dataclass(frozen=True)
class Index:
    """A written inverted index: postings (id, term, tf, in_title), lengths (id, length) of all rows, their number and mean length."""

    postings: DataFrame
    lengths: DataFrame
    docs: int
    mean: float


def _measured(postings: DataFrame, lengths: DataFrame) -> Index:
    docs, total = lengths.agg(F.count("*"), F.sum("length")).first()
    return Index(postings, lengths, docs, (total or 0) / max(docs, 1))


def build(corpus: DataFrame) -> Index:
    """The index of a corpus of (id, title, body), written once; titles and bodies are taken apart in one pass."""
    both = corpus.select("id", F.explode(F.array(F.struct(F.lit(True).alias("titled"), F.col("title").alias("text")), F.struct(F.lit(False).alias("titled"), F.col("body").alias("text")))).alias("p"))
    terms = exploded_tokens(both.select("id", "p.titled", "p.text"), "text", "id", "titled")
    postings = saved(terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("titled").alias("in_title")), "postings")
    sums = postings.groupBy("id").agg(F.sum("tf").alias("length"))
    return _measured(postings, saved(corpus.select("id").join(sums, "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length")), "lengths"))


def updated(index: Index, added: DataFrame, removed: DataFrame) -> Index:
    """The index after rows (id, title, body) came or changed and the ids in removed went.

    Only the added rows are taken apart; what was written before stays, without
    the rows that went. A search of it equals one of an index built anew.
    """
    new = build(added)
    gone = removed.select("id").union(added.select("id")).distinct()
    postings = index.postings.join(gone, "id", "left_anti").unionByName(new.postings)
    lengths = index.lengths.join(gone, "id", "left_anti").unionByName(new.lengths)
    return _measured(postings, lengths)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times); a repeated term weighs as often as it is there."""
    return exploded_tokens(queries, "query", "query_id").groupBy("query_id", "term").agg(F.count("*").alias("times"))


def weighed(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BM25 sums (query_id, id, raw) of asked terms (query_id, term, times), and the postings (id, term) that they hit.

    Only the postings of the queries' terms are weighed: terms are few beside
    the index, and a term in very many documents is split by the skew join.
    """
    hit = saved(index.postings.join(asked.select("term").distinct(), "term", "left_semi").join(index.lengths, "id"), "hits")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = (
        F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(1.0, index.mean)))
    ) * F.when(F.col("in_title"), TITLE).otherwise(1.0)
    pairs = hit.join(idf, "term").join(asked, "term")
    return pairs.groupBy("query_id", "id").agg(F.sum(weight * F.col("times")).alias("raw")), hit


def _with_terms(best: DataFrame, asked: DataFrame, hit: DataFrame) -> DataFrame:
    """The matched terms are gathered for the top hits alone."""
    terms = asked.join(best.select("query_id", "id"), "query_id").join(hit.select("id", "term"), ["id", "term"])
    matched = terms.groupBy("query_id", "id").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    return best.join(matched, ["query_id", "id"], "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def bm25(index: Index, queries: DataFrame, top: int = 10) -> DataFrame:
    """The top hits of every query: (query_id, id, score, matched, rank)."""
    asked = saved(query_terms(queries), "asked")
    scored, hit = weighed(index, asked)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    scored = scored.select("query_id", "id", F.round("raw", 6).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return _with_terms(best, asked, hit).select("query_id", "id", "score", "matched", "rank")


def title_letters(titles: DataFrame) -> DataFrame:
    """(letter, id, title): each letter of a title, blanks aside, with the title; the index that nominates fuzzy matches."""
    letters = F.array_distinct(F.split(F.lower("title"), ""))
    return titles.select(F.explode(letters).alias("letter"), "id", "title").where("trim(letter) <> ''")


def fuzzy_titles(letters: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, fuzzy): titles of which a query without blanks is a subsequence.

    A query meets only the titles that have its rarest letter, and is scored on
    those that have all its letters and are long enough; no other pair is made.
    """
    asked = queries.where(F.length(F.trim("query")) >= 2).select("query_id", F.regexp_replace("query", "\\s+", "").alias("compact"))
    own = asked.select("query_id", "compact", F.explode(F.array_distinct(F.split(F.lower("compact"), ""))).alias("letter")).where("letter <> ''")
    often = letters.groupBy("letter").agg(F.count("*").alias("n"))
    rarest = own.join(often, "letter", "left").groupBy("query_id", "compact").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "letter")).alias("m"))
    met = rarest.select("query_id", "compact", "m.letter").join(letters, "letter")
    missing = F.array_except(F.split(F.lower("compact"), ""), F.split(F.lower("title"), ""))
    some = met.where((F.length("compact") <= F.length("title")) & (F.size(F.filter(missing, lambda c: c != "")) == 0))
    return some.select("query_id", "id", fuzzy_score(F.col("compact"), F.col("title")).alias("fuzzy")).where("fuzzy is not null")


def search(index: Index, rows: DataFrame, queries: DataFrame, top: int = 20, fuzzy: bool = True) -> DataFrame:
    """The top hits of every query among what it may see: (query_id, id, kind, score, matched, rank).

    rows are the corpus (id, kind, title, boost, updated, workspace, project); queries are
    (query_id, query, kinds, workspace, project), where null allows all. Filters come after
    scoring, so weights are those of the whole corpus. A row's score is its BM25 sum,
    with 0.15 of the fuzzy score of its title, times its boost; only positive ones
    count, with three decimals, ties by the latest update, then id.
    """
    asked = saved(query_terms(queries), "asked")
    scored, hit = weighed(index, asked)
    if fuzzy:
        nominated = fuzzy_titles(title_letters(rows.select("id", "title")), queries)
        both = scored.join(nominated, ["query_id", "id"], "full_outer")
        scored = both.select("query_id", "id", (F.coalesce("raw", F.lit(0.0)) + FUZZY * F.coalesce("fuzzy", F.lit(0.0))).alias("raw"))
    seen = scored.join(rows.select("id", "kind", "boost", "updated", "workspace", "project"), "id")
    wanted = queries.select("query_id", "kinds", F.col("workspace").alias("in_workspace"), F.col("project").alias("in_project"))
    fits = (F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind"))) & (F.col("in_workspace").isNull() | (F.col("workspace") == F.col("in_workspace")))
    fits &= F.col("in_project").isNull() | (F.col("project") == F.col("in_project"))
    score = F.col("raw") * F.coalesce("boost", F.lit(1.0))
    kept = seen.join(wanted, "query_id").where(fits).withColumn("score", score).where("score > 0")
    kept = kept.withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("updated", F.lit(0))), "id")
    best = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "id", "kind", "score", "rank")
    return _with_terms(best, asked, hit).select("query_id", "id", "kind", "score", "matched", "rank")


#: Columns of a corpus row, and what stands where a collection has none.
CORPUS = {"id": "string", "kind": "string", "title": "string", "body": "string", "boost": "double", "updated": "long", "workspace": "string", "project": "string"}


def corpus_of(collections: list[tuple[str, DataFrame, float, int]], body: int = 20_000) -> DataFrame:
    """One corpus from unlike collections: (kind, rows, boost, most), the newest most rows of each workspace and kind.

    Rows have an id, title and workspace, and may have a body, updated and project; of a body
    the leading characters count. Ids are made unequal by their kind.
    """
    out = None
    for kind, rows, boost, most in collections:
        w = Window.partitionBy("workspace").orderBy(F.desc_nulls_last("updated") if "updated" in rows.columns else F.lit(0), "id")
        newest = rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= most)
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None)  # noqa: B023, E731
        made = {"id": F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")), "kind": F.lit(kind), "body": F.substring(F.coalesce(has("body").cast("string"), F.lit("")), 1, body), "boost": F.lit(boost)}
        part = newest.select(*[made.get(c, has(c)).cast(t).alias(c) for c, t in CORPUS.items()])
        out = part if out is None else out.unionByName(part)
    return out


def passages(contexts: DataFrame, least: int = 24) -> DataFrame:
    """(group, place, source, passage): contexts (group, turn, source, text) as passages of least characters and more.

    Texts fall into blocks at empty lines. A list or table stays whole; other
    blocks fall into sentences, where an end mark and blanks come before a capital,
    a bracket or a backtick. place numbers passages by turn and position.
    """
    ends = F.regexp_replace("block", "([.!?])\\s+(?=[A-Z(`])", "$1\x1e")
    blocks = contexts.select("group", "turn", "source", F.posexplode(F.split("text", "\n{2,}")).alias("at", "raw")).withColumn("block", F.trim(F.regexp_replace("raw", "^\\s+|\\s+$", "")))
    listed = F.col("block").rlike("^[-*•]\\s") | F.col("block").rlike("\\|[^\n]*\\|")
    parts = blocks.where(F.length("block") >= least).select("group", "turn", "source", "at", F.posexplode(F.when(listed, F.array("block")).otherwise(F.split(ends, "\x1e"))).alias("within", "part"))
    kept = parts.withColumn("passage", F.regexp_replace("part", "^\\s+|\\s+$", "")).where(F.length("passage") >= least)
    w = Window.partitionBy("group").orderBy("turn", "at", "within")
    return kept.withColumn("place", F.row_number().over(w) - 1).select("group", "place", "source", "passage")


def rank_passages(parts: DataFrame, questions: DataFrame, top: int = 14, spare: int = 6) -> DataFrame:
    """(group, place, passage, score, rank) of the passages that fit each group's question best.

    parts are those of passages(), questions (group, question). Weights are BM25
    within the group's own context: a term's rarity, lengths and their mean are
    those of its passages. Groups whose passages share no term give their first spare ones, with score 0.
    """
    parts = saved(parts.join(questions.select("group"), "group", "left_semi"), "passages")
    both = parts.select("group", "place", F.explode(F.array(F.struct(F.lit(True).alias("titled"), F.col("source").alias("text")), F.struct(F.lit(False).alias("titled"), F.col("passage").alias("text")))).alias("p"))
    terms = exploded_tokens(both.select("group", "place", "p.*"), "text", "group", "place", "titled")
    index = saved(terms.groupBy("group", "place", "term").agg(F.count("*").alias("tf"), F.max("titled").alias("in_title")), "passage-terms")
    asked = exploded_tokens(questions, "question", "group").groupBy("group", "term").agg(F.count("*").alias("times"))
    lengths = parts.select("group", "place").join(index.groupBy("group", "place").agg(F.sum("tf").alias("length")), ["group", "place"], "left").na.fill(0, ["length"])
    whole = lengths.groupBy("group").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    df = index.groupBy("group", "term").agg(F.count("*").alias("df"))
    met = index.join(asked, ["group", "term"]).join(df, ["group", "term"]).join(lengths, ["group", "place"]).join(whole, "group")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.lit(1.0), F.col("mean")))) * F.when(F.col("in_title"), TITLE).otherwise(1.0)
    scored = met.groupBy("group", "place").agg((F.floor(F.sum(weight) * 1000 + 0.5) / 1000).alias("score"))
    w = Window.partitionBy("group").orderBy(F.desc("score"), "place")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    none = parts.join(scored.select("group").distinct(), "group", "left_anti").where(F.col("place") < spare)
    rest = none.select("group", "place", F.lit(0.0).alias("score"), (F.col("place") + 1).alias("rank"))
    return best.unionByName(rest).join(parts, ["group", "place"]).select("group", "place", "passage", "score", "rank")


def uncovered(chosen: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """(group, missing): the first terms of each question, in its order, that no chosen passage (group, passage) has."""
    have = exploded_tokens(chosen, "passage", "group").select("group", "term").distinct()
    first = questions.select("group", F.posexplode(F.array_distinct(tokens(F.col("question")))).alias("at", "term"))
    w = Window.partitionBy("group").orderBy("at")
    left = first.join(have, ["group", "term"], "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    lists = left.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda s: s["term"]).alias("missing"))
    return questions.select("group").join(lists, "group", "left").select("group", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def excerpt(body: Column, terms: Column, width: int = 180) -> Column:
    """The part of a text around its first matching term."""
    flat = F.trim(F.regexp_replace(body, "\\s+", " "))
    low = F.lower(flat)
    found = F.filter(F.transform(terms, lambda t: F.call_function("locate", t, low)), lambda p: p > 0)
    best = F.array_min(found)
    start = F.greatest(best - 1 - width // 3, F.lit(0))
    end = F.least(F.length(flat), start + width)
    around = F.concat(
        F.when(start > 0, "…").otherwise(""), F.trim(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "…").otherwise("")
    )
    plain = F.concat(F.substring(flat, 1, width), F.lit("…"))
    return F.when(F.length(flat) <= width, flat).when(best.isNull(), plain).otherwise(around)
