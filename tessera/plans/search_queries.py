"""Text, search and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search
from tessera.sources.tables import read

_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def tokens_sql(column: str) -> str:
    """DuckDB expression for functions.text.tokens."""
    parts = (
        "list_filter(string_split_regex(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[ _$]+'), lambda p: p <> '')"
    )
    word = (
        f"list_concat([lower(w)], CASE WHEN len({parts}) > 1 THEN "
        f"list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: p <> lower(w)) ELSE [] END)"
    )
    every = f"flatten(list_transform(regexp_extract_all({column}, '[A-Za-z0-9_$]+'), lambda w: {word}))"
    return f"list_filter({every}, lambda t: length(t) > 1 AND NOT list_contains({_STOPS}, t))"


def corpus(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"))


def asked(spark, sf_dir) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def token_df(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    each = X.exploded_tokens(docs, "text", "doc_id").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def index_sql(corpus: str, queries: str) -> str:
    """DuckDB views from an index of a corpus (id, title, body) to BM25 hits (query_id, id, raw, score, matched) and their ranks."""
    return f"""
c AS ({corpus}),
tk AS (SELECT id, {tokens_sql("title")} AS t, {tokens_sql("body")} AS b FROM c),
ev AS (SELECT id, t, list_concat(coalesce(t, []), coalesce(b, [])) AS every FROM tk),
st AS (SELECT count(*) AS docs, avg(len(every)) AS mean FROM ev),
ix AS (SELECT id, term, count(*) AS tf, bool_or(list_contains(t, term)) AS in_title, max(len(every)) AS length
       FROM (SELECT id, t, every, unnest(every) AS term FROM ev) GROUP BY id, term),
q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql("query")}) AS term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM ix WHERE term IN (SELECT term FROM qt) GROUP BY term),
hits AS (
  SELECT query_id, id, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5
           / (tf + 1.5 * (0.25 + 0.75 * length / greatest(1.0, mean))) * CASE WHEN in_title THEN 2.5 ELSE 1.0 END) AS raw,
         list_sort(list(DISTINCT term)) AS matched
  FROM ix JOIN qt USING (term) JOIN dfs USING (term), st GROUP BY query_id, id),
ranked AS (SELECT query_id, id, round(raw, 6) AS score, matched, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, id) AS rank FROM hits)
"""


_INDEX = index_sql("SELECT doc_id AS id, substr(text, 1, 80) AS title, text AS body FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark")


def bm25_topk(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    hits = search.bm25(search.build(docs), asked(spark, sf_dir))
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", F.array_join("matched", " ").alias("matched"), "rank")


def search_excerpts(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    hits = search.bm25(search.build(docs), asked(spark, sf_dir), top=3)
    shown = hits.join(docs, "id").select("query_id", F.col("id").alias("doc_id"), search.excerpt(F.col("body"), F.col("matched")).alias("excerpt"))
    return shown


def hits_by_kind(spark, sf_dir):
    """Best score and number of hits of each query by the documents' source."""
    docs = corpus(spark, sf_dir)
    hits = search.bm25(search.build(docs), asked(spark, sf_dir))
    kinds = read(spark, sf_dir, "documents", F.col("doc_id").alias("id"), F.col("source").alias("kind"))
    return hits.join(kinds, "id").groupBy("query_id", "kind").agg(F.max("score").alias("best"), F.count("*").alias("n"))


def edit_distance_pairs(spark, sf_dir):
    """How far the first word of each part's name is from the last word of its type."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    a, b = F.lower(F.substring_index("p_name", " ", 1)), F.lower(F.substring_index("p_type", " ", -1))
    return parts.select("p_partkey", X.edit_distance(a, b, 6).alias("distance"))


def fuzzy_titles(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name")
    return parts.select("p_partkey", F.round(X.fuzzy_score(F.lit("rdt"), F.col("p_name")), 6).alias("score")).where("score is not null")


def text_facts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    t = F.col("text")
    return docs.select(
        "doc_id",
        X.first_sentence(t).alias("first_sentence"),
        X.slug(t).alias("slug"),
        X.format_bytes(F.octet_length(t).cast("long")).alias("size"),
        F.size(X.ngrams(t)).alias("ngrams"),
        X.token_estimate(t).alias("tokens"),
    )


def entropy_by_doc(spark, sf_dir):
    """Bits a character of whole texts: characters are counted, so a text is passed over once."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    each = docs.select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    n = F.sum("n")
    per = each.groupBy("doc_id").agg(F.round(F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n, 6).alias("bits"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("bits", F.lit(0.0)).alias("bits"))


def fnv_hash(spark, sf_dir):
    return read(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", X.fnv1a32(F.col("c_name")).alias("h"))


QUERIES = {f.__name__: f for f in (token_df, bm25_topk, search_excerpts, hits_by_kind, edit_distance_pairs, fuzzy_titles, text_facts, entropy_by_doc, fnv_hash)}

ORACLES = {
    "token_df": f"""SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf
        FROM (SELECT doc_id, unnest({tokens_sql("text")}) AS term FROM documents) GROUP BY term""",
    "bm25_topk": f"WITH {_INDEX} SELECT query_id, id AS doc_id, score, array_to_string(matched, ' ') AS matched, rank FROM ranked WHERE rank <= 10",
    "search_excerpts": f"""WITH {_INDEX},
        f AS (SELECT query_id, id, matched, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM ranked JOIN c USING (id) WHERE rank <= 3),
        p AS (SELECT *, list_min(list_filter(list_transform(matched, lambda t: instr(lower(flat), t)), lambda p: p > 0)) AS best FROM f),
        s AS (SELECT *, greatest(best - 1 - 60, 0) AS a, least(length(flat), greatest(best - 1 - 60, 0) + 180) AS z FROM p)
        SELECT query_id, id AS doc_id, CASE WHEN length(flat) <= 180 THEN flat WHEN best IS NULL THEN substr(flat, 1, 180) || '…'
          ELSE (CASE WHEN a > 0 THEN '…' ELSE '' END) || trim(substr(flat, a + 1, z - a)) || (CASE WHEN z < length(flat) THEN '…' ELSE '' END) END AS excerpt
        FROM s""",
    "hits_by_kind": f"""WITH {_INDEX} SELECT query_id, source AS kind, max(score) AS best, count(*) AS n
        FROM ranked JOIN documents ON id = doc_id WHERE rank <= 10 GROUP BY ALL""",
    "edit_distance_pairs": """SELECT p_partkey, CAST(least(levenshtein(lower(string_split(p_name, ' ')[1]), lower(string_split(p_type, ' ')[-1])), 7) AS INTEGER) AS distance FROM part""",
    "fuzzy_titles": """WITH n AS (SELECT p_partkey, lower(p_name) AS t FROM part), a AS (SELECT *, instr(t, 'r') AS x FROM n),
        b AS (SELECT *, x + instr(substr(t, x + 1), 'd') AS y FROM a WHERE x > 0), c AS (SELECT *, y + instr(substr(t, y + 1), 't') AS z FROM b WHERE y > x),
        s AS (SELECT *, CASE WHEN x = 1 OR substr(t, x - 1, 1) IN (' ', '/', '-', '_') THEN 3 ELSE 0 END + CASE WHEN substr(t, y - 1, 1) IN (' ', '/', '-', '_') THEN 3 ELSE 0 END
          + CASE WHEN substr(t, z - 1, 1) IN (' ', '/', '-', '_') THEN 3 ELSE 0 END + CASE WHEN y = x + 1 THEN 4 ELSE 0 END + CASE WHEN z = y + 1 THEN 4 ELSE 0 END + 3 AS g FROM c WHERE z > y)
        SELECT p_partkey, round(g - least(length(t) - 3, 20) * CAST(0.1 AS DOUBLE), 6) AS score FROM s""",
    "fnv_hash": """SELECT c_custkey, list_reduce(list_prepend(2166136261, list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
        lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM customer""",
    "text_facts": """WITH d AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[#*_>`]', '', 'g'), '\\s+', ' ', 'g')) AS flat,
          translate(lower(text), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS plain, strlen(text) AS n FROM documents),
        e AS (SELECT *, regexp_extract(flat, '^(.+?[.!?])(?:\\s|$)', 1) AS f1 FROM d),
        g AS (SELECT *, CASE WHEN f1 = '' THEN flat ELSE f1 END AS s, regexp_replace(regexp_replace(plain, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM e)
        SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE rtrim(substr(s, 1, 219)) || '…' END AS first_sentence,
          CASE WHEN sl = '' THEN 'untitled' ELSE sl END AS slug,
          CASE WHEN n < 1024 THEN n || ' B' WHEN n >= 1048576 THEN printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10)
               WHEN n / 1024.0 >= 100 THEN printf('%.0f KB', floor(n / 1024.0 + 0.5)) ELSE printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) END AS size,
          CAST(greatest(length(trim(text)) + 2 - 3 + 1, 1) AS INTEGER) AS ngrams,
          CAST(greatest(ceil(length(text) / 3.6 + 0.15 * len(regexp_extract_all(text, '[^A-Za-z0-9_\\s]')) + 0.05 * len(regexp_extract_all(text, '\\S+'))), 1) AS BIGINT) AS tokens
        FROM g""",
    "entropy_by_doc": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''),
        n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS total FROM n)
        SELECT doc_id, round(-sum(k / total * log2(k / total)), 6) AS bits FROM t GROUP BY doc_id
        UNION ALL SELECT doc_id, 0.0 FROM documents WHERE text = ''""",
}
