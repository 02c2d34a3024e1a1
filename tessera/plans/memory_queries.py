"""Queries of retrieval, vectors, names and recorded conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import memory as M
from tessera.operators import search
from tessera.plans.search_queries import _INDEX, asked, corpus
from tessera.sources.tables import read


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def knn(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 100."""
    v = _vectors(spark, sf_dir)
    return M.nearest(v, v.where("id % 100 = 0")).select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


def importance_decay(spark, sf_dir):
    """How important each user's events still are at the end of the table's time."""
    events = read(spark, sf_dir, "events", "user_id", "ts", "value")
    last = F.max("ts")
    per = events.groupBy("user_id").agg(last.alias("seen"), F.count("*").alias("uses"), F.avg("value").alias("importance"))
    now = events.agg(F.max("ts").alias("now"))
    age = F.floor((F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("seen").cast("timestamp"))) / 1000) / 86400.0
    return per.crossJoin(F.broadcast(now)).select("user_id", "uses", M.decayed_importance(F.round("importance", 4), age, F.col("uses") / 10).alias("importance"))


def pack_budget(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    kept = M.pack_to_budget(turns, "conv_id", F.col("turn"), F.length("text") + 1, 3200)
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("spent").alias("spent"))


def message_tokens(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text")) + 4).alias("tokens"))


def token_cost(spark, sf_dir):
    """Cost of what users and assistants wrote, at a price a million tokens for each."""
    prices = spark.createDataFrame([("user", 0.5), ("assistant", 1.5), ("system", 0.1)], "role string, price double")
    turns = read(spark, sf_dir, "conversations").withColumn("tokens", X.token_estimate(F.col("text")))
    return turns.join(F.broadcast(prices), "role").groupBy("role").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("price")) / 1e6, 6).alias("cost"))


def conversation_titles(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", X.first_sentence(F.col("text"), 60).alias("title"))


def hybrid_rrf(spark, sf_dir):
    """BM25 ranks fused with the ranks of vectors; a document's vector has its id, a query's that of its item."""
    docs, queries, v = corpus(spark, sf_dir), asked(spark, sf_dir), _vectors(spark, sf_dir)
    hits = search.bm25(search.build(docs), queries, top=20)
    of_docs = v.join(docs.select("id"), "id", "left_semi")
    second = M.nearest(of_docs, v.join(queries.select(F.col("query_id").alias("id")), "id", "left_semi"), top=20)
    fused = M.fuse(hits, second)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("place", F.row_number().over(w)).where("place <= 8").select("query_id", F.col("id").alias("doc_id"), "lexical_rank", "semantic_rank", "score", "place")


def related_items(spark, sf_dir):
    """Up to five vectors of the same label that are similar by more than 0.2, for every vector."""
    v = read(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    got = M.nearest(v, v, top=5, group="label", least=0.2).where("similarity > 0.2")
    return got.select(F.col("query_id").alias("vec_id"), F.col("id").alias("other_id"), "similarity", "rank")


def entity_mentions(spark, sf_dir):
    found = M.entities(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.groupBy("name", "kind").agg(F.count("*").alias("mentions"), F.min("doc_id").alias("first_doc"))


def cooccurrence(spark, sf_dir):
    """Brands ordered together, by how many orders hold both."""
    items = read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_partkey").alias("p_partkey"))
    brands = items.join(read(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_brand").distinct()
    return M.co_occurrence(brands, "l_orderkey", "p_brand")


def centrality(spark, sf_dir):
    return M.centrality(cooccurrence(spark, sf_dir))


def chunks(spark, sf_dir):
    return M.chunk_text(read(spark, sf_dir, "documents", "doc_id", "text"))


def latest_question(spark, sf_dir):
    """The last user turn of every conversation and whether an assistant answered it."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    last = turns.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("asked"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answered"))
    return last.select("conv_id", "asked", F.coalesce(F.col("answered") > F.col("asked"), F.lit(False)).alias("done"))


QUERIES = {f.__name__: f for f in (knn, importance_decay, pack_budget, message_tokens, token_cost, conversation_titles, hybrid_rrf, related_items, entity_mentions, cooccurrence, centrality, chunks, latest_question)}

_TOK = "CAST(greatest(ceil(length(text) / 3.6 + 0.15 * len(regexp_extract_all(text, '[^A-Za-z0-9_\\s]')) + 0.05 * len(regexp_extract_all(text, '\\S+'))), 1) AS BIGINT)"
_PAIR = """b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS weight FROM b x JOIN b y USING (l_orderkey) WHERE x.p_brand < y.p_brand GROUP BY ALL)"""
_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_inner_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])))"
# Tokens by shape, as lists; the engine's own lists of words are parameters of both sides.
_FILES = "list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9_./-]+'), lambda t: regexp_replace(t, '^[./-]+|[./-]+$', '', 'g')), lambda t: len(string_split(t, '/')) BETWEEN 2 AND 7 AND NOT list_contains(string_split(t, '/'), '') AND regexp_matches(string_split(t, '/')[-1], '^.+\\.[a-z]{1,5}$'))"
_SYMBOLS = "list_filter(string_split(text, '`')[2:len(string_split(text, '`')) - 1], lambda t: length(t) > 2 AND regexp_full_match(t, '[A-Za-z_$][A-Za-z0-9_$]*'))"
_DASHED = "list_transform(string_split_regex(text, '[^A-Za-z0-9_-]+'), lambda t: list_filter(string_split(t, '-'), lambda p: p <> ''))"
_LOW = "list_position(list_transform(ps, lambda p: regexp_matches(p, '^[a-z]')), true)"
_SCOPED = "list_filter(string_split_regex(text, '[^A-Za-z0-9_@/-]+'), lambda t: starts_with(t, '@') AND len(string_split(t, '/')) = 2 AND NOT ends_with(t, '/') AND NOT contains(t[2:], '@') AND instr(t, '/') > 2)"
_PACKAGES = f"list_concat(list_transform(list_filter({_DASHED}, lambda ps: {_LOW} > 0 AND {_LOW} < len(ps)), lambda ps: array_to_string(ps[{_LOW}:], '-')), {_SCOPED})"
_VERB = f"list_position(list_transform(ws, lambda w: list_contains({list(M.DECIDING)}, lower(w))), true)"
_BEHIND = f"list_transform(list_filter(list_transform(string_split_regex(text, '[.;\\n]'), lambda c: string_split(c, ' ')), lambda ws: {_VERB} > 0), lambda ws: ws[{_VERB} + 1:])"
_DECISIONS = f"list_filter(list_transform({_BEHIND}, lambda ws: trim(substr(array_to_string(CASE WHEN lower(ws[1]) IN ('to', 'on') THEN ws[2:] ELSE ws END, ' '), 1, 70))), lambda t: length(t) >= 6)"
_MARKED = "list_transform(string_split(replace(regexp_replace(text, '[^A-Za-z0-9_ ]+', ' | ', 'g'), '  ', ' | '), ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Z][A-Za-z]{2,}') THEN w ELSE '|' END)"
_ROWS = f"list_filter(list_transform(string_split(array_to_string({_MARKED}, ' '), '|'), lambda r: string_split(trim(r), ' ')), lambda r: r[1] <> '')"
_CONCEPTS = f"list_filter(list_transform(list_filter(flatten(list_transform({_ROWS}, lambda r: list_transform(range(1, len(r) + 1, 3), lambda i: r[i:i + 2]))), lambda r: NOT list_contains({list(M.NO_CONCEPT)}, r[1])), lambda r: array_to_string(r, ' ')), lambda t: length(t) >= 4)"
ORACLES = {
    "knn": f"""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round({_DOT}, 6) AS similarity FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "importance_decay": """WITH p AS (SELECT user_id, max(ts) AS seen, count(*) AS uses, round(avg(value), 4) AS importance FROM events GROUP BY user_id),
        a AS (SELECT *, floor((epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(seen)) / 1000) / 86400.0 AS age FROM p),
        d AS (SELECT *, pow(0.5, greatest(age, 0.0) / 45) AS decay, least(1.0, uses / 10 / 20) AS kept FROM a)
        SELECT user_id, uses, floor(importance * (decay + (1 - decay) * kept) * 10000 + 0.5) / 10000 AS importance FROM d""",
    "pack_budget": """WITH s AS (SELECT conv_id, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations)
        SELECT conv_id, count(*) AS turns, CAST(max(spent) AS BIGINT) AS spent FROM s WHERE spent <= 3200 GROUP BY conv_id""",
    "message_tokens": f"SELECT conv_id, CAST(sum({_TOK} + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "token_cost": f"""WITH p(role, price) AS (VALUES ('user', 0.5), ('assistant', 1.5), ('system', 0.1)), t AS (SELECT role, {_TOK} AS n FROM conversations)
        SELECT role, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n * CAST(price AS DOUBLE)) / 1e6, 6) AS cost FROM t JOIN p USING (role) GROUP BY role""",
    "conversation_titles": """WITH u AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
        f AS (SELECT conv_id, trim(regexp_replace(regexp_replace(text, '[#*_>`]', '', 'g'), '\\s+', ' ', 'g')) AS flat FROM u),
        e AS (SELECT *, regexp_extract(flat, '^(.+?[.!?])(?:\\s|$)', 1) AS f1 FROM f), g AS (SELECT conv_id, CASE WHEN f1 = '' THEN flat ELSE f1 END AS s FROM e)
        SELECT conv_id, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS title FROM g""",
    "related_items": f"""WITH s AS (SELECT q.vec_id, d.vec_id AS other_id, round({_DOT}, 6) AS similarity FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id AND q.label = d.label)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other_id) AS rank FROM s WHERE similarity > 0.2) WHERE rank <= 5""",
    "hybrid_rrf": f"""WITH {_INDEX}, l AS (SELECT query_id, id, rank FROM ranked WHERE rank <= 20),
        sv AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round({_DOT}, 6) AS similarity FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id
               WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND d.vec_id IN (SELECT doc_id FROM documents)),
        b AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sv) WHERE rank <= 20),
        f AS (SELECT coalesce(l.query_id, b.query_id) AS query_id, coalesce(l.id, b.id) AS doc_id, l.rank AS lexical_rank, b.rank AS semantic_rank,
              round(coalesce(1.0 / (60 + l.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 6) AS score FROM l FULL OUTER JOIN b ON l.query_id = b.query_id AND l.id = b.id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f) WHERE place <= 8""",
    "entity_mentions": f"""WITH e AS (SELECT doc_id, lower(unnest({_FILES})) AS name, 0 AS o FROM documents UNION ALL SELECT doc_id, lower(unnest({_SYMBOLS})), 1 FROM documents
          UNION ALL SELECT doc_id, lower(unnest({_PACKAGES})), 2 FROM documents UNION ALL SELECT doc_id, lower(unnest({_DECISIONS})), 3 FROM documents UNION ALL SELECT doc_id, lower(unnest({_CONCEPTS})), 4 FROM documents),
        k AS (SELECT doc_id, name, min(o) AS o FROM e GROUP BY ALL)
        SELECT name, {list(M.ENTITY_KINDS)}[o + 1] AS kind, count(*) AS mentions, min(doc_id) AS first_doc FROM k GROUP BY ALL""",
    "cooccurrence": f"WITH {_PAIR} SELECT * FROM e",
    "centrality": f"WITH {_PAIR} SELECT name, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT a AS name, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY name",
    "latest_question": """WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS asked, max(turn) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY conv_id)
        SELECT conv_id, asked, coalesce(answered > asked, false) AS done FROM l""",
}
