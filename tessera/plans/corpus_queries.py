"""Queries over a corpus made of unlike tables: filtered search, an index kept up to date, passages of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import search
from tessera.plans.search_queries import index_sql, tokens_sql
from tessera.sources.tables import read

#: Most rows of a kind in one workspace, and how much a kind's scores count.
MOST = {"repository": 500, "file": 400, "document": 500, "benchmark": 200, "conversation": 200}
BOOST = {"repository": 1.4, "file": 1.0, "document": 1.2, "benchmark": 1.0, "conversation": 1.0}


def workspace_corpus(spark, sf_dir):
    """Suppliers, parts, documents, benchmark items and conversations as rows of one schema."""
    own = lambda c: F.concat(F.lit("w"), F.col(c) % 3)
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    items = read(spark, sf_dir, "benchmark")
    first = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    title = X.first_sentence(F.col("text"), 60)
    rows = {
        "repository": supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("nation "), "s_nationkey").alias("body"), own("s_suppkey").alias("workspace"), F.col("s_suppkey").alias("updated")),
        "file": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("body"), own("p_partkey").alias("workspace"), (F.col("p_partkey") % 101).alias("updated"), F.col("p_brand").alias("project")),
        "document": docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), own("doc_id").alias("workspace"), (F.col("doc_id") % 97).alias("updated"), F.col("source").alias("project")),
        "benchmark": items.select(F.col("item_id").alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), own("item_id").alias("workspace")),
        "conversation": first.select(F.col("conv_id").alias("id"), title.alias("title"), title.alias("body"), own("conv_id").alias("workspace"), F.col("conv_id").alias("updated")),
    }
    return search.corpus_of([(kind, df, BOOST[kind], MOST[kind]) for kind, df in rows.items()])


def _asked(spark, sf_dir):
    """The first three words of benchmark items, and parts' names without vowels; some see one kind or workspace only."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))
    names = read(spark, sf_dir, "part", "p_partkey", "p_name").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    short = names.select((F.col("k") + 1000).alias("n"), F.regexp_replace("p_name", "[aeiou]", "").alias("query"))
    kinds = F.when(F.col("n") % 4 == 1, F.array(F.lit("file"), F.lit("document"))).when(F.col("n") % 4 == 3, F.array(F.lit("document")))
    both = items.unionByName(short)
    return both.select(F.col("n").alias("query_id"), "query", kinds.alias("kinds"), F.when(F.col("n") % 4 >= 2, "w1").alias("workspace"), F.when(F.col("n") % 8 == 5, "Brand#4").alias("project"))


def corpus_kinds(spark, sf_dir):
    """What the corpus holds of each kind in each workspace."""
    rows = workspace_corpus(spark, sf_dir)
    return rows.groupBy("workspace", "kind").agg(F.count("*").alias("n"), F.min("boost").alias("boost"), F.max("updated").alias("latest"), F.sum(F.length("body")).alias("chars"))


def workspace_search(spark, sf_dir):
    """BM25 with fuzzy titles and boosts over the whole corpus, then each query's filters."""
    rows = workspace_corpus(spark, sf_dir)
    hits = search.search(search.build(rows.select("id", "title", "body")), rows, _asked(spark, sf_dir))
    return hits.select("query_id", "id", "kind", "score", F.array_join("matched", " ").alias("matched"), "rank")


def kept_index(spark, sf_dir):
    """The same search over an index that was built on older rows, then took changed and new ones and lost others."""
    rows = workspace_corpus(spark, sf_dir)
    key = F.substring_index("id", ":", -1).cast("long")
    late, gone = rows.where(key % 5 == 0), rows.where(key % 7 == 3)
    old = rows.where((key % 5 != 0) | (key % 2 == 0)).select("id", "title", F.when(key % 5 == 0, F.lit("an older text")).otherwise(F.col("body")).alias("body"))
    index = search.updated(search.build(old), late.where(key % 7 != 3).select("id", "title", "body"), gone.select("id"))
    hits = search.search(index, rows.where(key % 7 != 3), _asked(spark, sf_dir))
    return hits.select("query_id", "id", "kind", "score", "rank")


def _context(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("group")).agg(F.max_by("text", "turn").alias("question"))
    said = turns.where("role <> 'user'").select(F.col("conv_id").alias("group"), "turn", F.col("role").alias("source"), "text")
    return search.passages(said), asked


def passage_rows(spark, sf_dir):
    """Every passage of what assistants and systems said."""
    parts, _ = _context(spark, sf_dir)
    return parts.select(F.col("group").alias("conv_id"), "place", "source", "passage")


def passage_ranks(spark, sf_dir):
    """The passages of each conversation that fit its last question best, ranked within the conversation."""
    parts, asked = _context(spark, sf_dir)
    return search.rank_passages(parts, asked).select(F.col("group").alias("conv_id"), "place", "score", "rank")


def passage_gaps(spark, sf_dir):
    """The first words of each last question that its chosen passages do not have."""
    parts, asked = _context(spark, sf_dir)
    chosen = search.rank_passages(parts, asked).select("group", "passage")
    return search.uncovered(chosen, asked).select(F.col("group").alias("conv_id"), F.array_join("missing", " ").alias("missing"))


QUERIES = {f.__name__: f for f in (corpus_kinds, workspace_search, kept_index, passage_rows, passage_ranks, passage_gaps)}

_TITLE = """(SELECT conv_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS title FROM (SELECT conv_id, CASE WHEN f1 = '' THEN flat ELSE f1 END AS s FROM (SELECT *, regexp_extract(flat, '^(.+?[.!?])(?:\\s|$)', 1) AS f1
    FROM (SELECT conv_id, trim(regexp_replace(regexp_replace(arg_min(text, turn), '[#*_>`]', '', 'g'), '\\s+', ' ', 'g')) AS flat FROM conversations WHERE role = 'user' GROUP BY conv_id))))"""
_MOST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in MOST.items()) + " END"
_BOOST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {b}::DOUBLE" for k, b in BOOST.items()) + " END"
_ROWS = f"""x AS (SELECT 'repository' AS kind, s_suppkey AS n, s_name AS title, 'nation ' || s_nationkey AS body, s_suppkey AS updated, NULL AS project FROM supplier
      UNION ALL SELECT 'file', p_partkey, p_name, p_type || ' ' || p_brand, p_partkey % 101, p_brand FROM part UNION ALL SELECT 'document', doc_id, substr(text, 1, 80), substr(text, 1, 20000), doc_id % 97, source FROM documents
      UNION ALL SELECT 'benchmark', item_id, substr(text, 1, 40), text, NULL, NULL FROM benchmark UNION ALL SELECT 'conversation', conv_id, title, title, conv_id, NULL FROM {_TITLE}),
    rs AS (SELECT kind || ':' || n AS id, * EXCLUDE n, 'w' || n % 3 AS workspace, {_BOOST} AS boost FROM x QUALIFY row_number() OVER (PARTITION BY kind, n % 3 ORDER BY updated DESC NULLS LAST, n) <= {_MOST})"""
_QS = """b AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query FROM benchmark UNION ALL SELECT min(p_partkey) + 1000, regexp_replace(p_name, '[aeiou]', '', 'g') FROM part GROUP BY p_name),
    qs AS (SELECT *, CASE query_id % 4 WHEN 1 THEN ['file', 'document'] WHEN 3 THEN ['document'] END AS kinds, CASE WHEN query_id % 4 >= 2 THEN 'w1' END AS in_workspace, CASE WHEN query_id % 8 = 5 THEN 'Brand#4' END AS in_project FROM b)"""
# A query is a subsequence of a title: one step for each of its letters.
_FUZZY = """p AS (SELECT query_id, id, lower(regexp_replace(query, '\\s+', '', 'g')) AS q, lower(title) AS t FROM qs, rs WHERE length(trim(query)) >= 2),
    z(query_id, id, q, t, i, last, score) AS (SELECT query_id, id, q, t, 0, 0, 0::DOUBLE FROM p WHERE length(q) <= length(t)
      UNION ALL SELECT query_id, id, q, t, i + 1, last + spot, score + 1 + CASE WHEN spot = 1 AND last > 0 THEN 4 ELSE 0 END + CASE WHEN last + spot = 1 OR substr(t, last + spot - 1, 1) IN (' ', '/', '-', '_') THEN 3 ELSE 0 END
      FROM (SELECT *, instr(substr(t, last + 1), substr(q, i + 1, 1)) AS spot FROM z WHERE i < length(q)) WHERE spot > 0),
    fz AS (SELECT query_id, id, score - least(length(t) - length(q), 20) * 0.1::DOUBLE AS fuzzy FROM z WHERE i = length(q))"""
_HITS = """j AS (SELECT coalesce(hits.query_id, fz.query_id) AS query_id, coalesce(hits.id, fz.id) AS id, matched, (coalesce(raw, 0) + 0.15::DOUBLE * coalesce(fuzzy, 0)) * boost AS s, rs.* EXCLUDE (id, title, body, boost), kinds
      FROM hits FULL JOIN fz ON hits.query_id = fz.query_id AND hits.id = fz.id JOIN rs ON rs.id = coalesce(hits.id, fz.id) JOIN qs ON qs.query_id = coalesce(hits.query_id, fz.query_id)
      WHERE (kinds IS NULL OR list_contains(kinds, kind)) AND (in_workspace IS NULL OR workspace = in_workspace) AND (in_project IS NULL OR project = in_project)),
    r AS (SELECT query_id, id, kind, floor(s * 1000 + 0.5) / 1000 AS score, array_to_string(coalesce(matched, []), ' ') AS matched, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1000 + 0.5) / 1000 DESC, coalesce(updated, 0) DESC, id) AS rank FROM j WHERE s > 0)"""
_SPACE = "[ \\t\\n\\r\\f\\x0b]"
_PARTS = f"""b AS (SELECT conv_id, turn, role AS source, generate_subscripts(bs, 1) AS spot, regexp_replace(unnest(bs), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS block FROM (SELECT *, string_split_regex(text, '\\n{{2,}}') AS bs FROM conversations WHERE role <> 'user')),
    l AS (SELECT *, CASE WHEN regexp_matches(block, '^[-*•]{_SPACE}') OR regexp_matches(block, '\\|[^\\n]*\\|') THEN [block]
      ELSE string_split(regexp_replace(block, '([.!?]){_SPACE}+([A-Z(`])', '\\1' || chr(30) || '\\2', 'g'), chr(30)) END AS ps FROM b WHERE length(block) >= 24),
    t AS (SELECT conv_id, turn, source, spot, generate_subscripts(ps, 1) AS within, regexp_replace(unnest(ps), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS passage FROM l),
    ps AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, spot, within) - 1)::INTEGER AS place, source, passage FROM t WHERE length(passage) >= 24)"""
_RANKED = f"""{_PARTS}, qq AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    pp AS (SELECT * FROM ps WHERE conv_id IN (SELECT conv_id FROM qq)),
    tk AS (SELECT conv_id, place, {tokens_sql("source")} AS s, {tokens_sql("passage")} AS p FROM pp), ln AS (SELECT conv_id, place, s, list_concat(s, p) AS every FROM tk),
    ix AS (SELECT conv_id, place, term, count(*) AS tf, bool_or(list_contains(s, term)) AS titled, max(len(every)) AS length FROM (SELECT *, unnest(every) AS term FROM ln) GROUP BY ALL),
    st AS (SELECT conv_id, count(*) AS docs, avg(len(every)) AS mean FROM ln GROUP BY conv_id), df AS (SELECT conv_id, term, count(*) AS df FROM ix GROUP BY ALL),
    qt AS (SELECT conv_id, term, count(*) AS times FROM (SELECT conv_id, unnest({tokens_sql("question")}) AS term FROM qq) GROUP BY ALL),
    sc AS (SELECT conv_id, place, floor(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(1.0, mean))) * CASE WHEN titled THEN 2.5 ELSE 1.0 END) * 1000 + 0.5) / 1000 AS score
      FROM ix JOIN qt USING (conv_id, term) JOIN df USING (conv_id, term) JOIN st USING (conv_id) GROUP BY ALL),
    ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, place)::INTEGER AS rank FROM sc) WHERE rank <= 14
      UNION ALL SELECT conv_id, place, 0.0, place + 1 FROM pp WHERE place < 6 AND conv_id NOT IN (SELECT conv_id FROM sc))"""
ORACLES = {
    "corpus_kinds": f"WITH {_ROWS} SELECT workspace, kind, count(*) AS n, min(boost) AS boost, max(updated) AS latest, CAST(sum(length(body)) AS BIGINT) AS chars FROM rs GROUP BY ALL",
    "workspace_search": f"WITH RECURSIVE {_ROWS}, {_QS}, {index_sql('SELECT id, title, body FROM rs', 'SELECT query_id, query FROM qs')}, {_FUZZY}, {_HITS} SELECT * FROM r WHERE rank <= 20",
    "kept_index": f"""WITH RECURSIVE {_ROWS.replace("rs AS (", "r0 AS (")}, rs AS (SELECT * FROM r0 WHERE split_part(id, ':', 2)::BIGINT % 7 <> 3), {_QS},
        {index_sql('SELECT id, title, body FROM rs', 'SELECT query_id, query FROM qs')}, {_FUZZY}, {_HITS} SELECT query_id, id, kind, score, rank FROM r WHERE rank <= 20""",
    "passage_rows": f"WITH {_PARTS} SELECT * FROM ps",
    "passage_ranks": f"WITH {_RANKED} SELECT * FROM ch",
    "passage_gaps": f"""WITH {_RANKED}, have AS (SELECT DISTINCT conv_id, unnest({tokens_sql("passage")}) AS term FROM ch JOIN pp USING (conv_id, place)),
        wt AS (SELECT conv_id, generate_subscripts(ts, 1) AS spot, unnest(ts) AS term FROM (SELECT conv_id, {tokens_sql("question")} AS ts FROM qq)),
        wd AS (SELECT conv_id, term, min(spot) AS spot FROM wt GROUP BY ALL), gone AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS n FROM wd ANTI JOIN have USING (conv_id, term))
        SELECT conv_id, coalesce(string_agg(term, ' ' ORDER BY spot) FILTER (n <= 4), '') AS missing FROM qq LEFT JOIN gone USING (conv_id) GROUP BY conv_id""",
}
