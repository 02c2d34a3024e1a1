"""Retrieval with ranks, vectors and importance that fades."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 45


def decayed_importance(importance: Column, age_days: Column, uses: Column) -> Column:
    """Importance that halves in 45 days; twenty uses and more keep it whole."""
    decay = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / HALF_LIFE_DAYS)
    kept = F.least(F.lit(1.0), uses / 20)
    return F.floor(importance * (decay + (1 - decay) * kept) * 10000 + 0.5) / 10000


def pack_to_budget(rows: DataFrame, group: str, order: Column, cost: Column, budget: int) -> DataFrame:
    """The leading rows of every group whose running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank)."""
    a = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    b = semantic.select("query_id", "id", F.col("rank").alias("semantic_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(part("lexical_rank") + part("semantic_rank"), 6))


#: Numbers in a block of vectors at most, and queries beyond which a group of one block is dealt to several blocks of them, up to four for cores' sake.
BLOCK_VALUES, FEW_QUERIES = 1 << 22, 4096


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their unit vectors; vectors with null or non-finite components fall out."""
    lists = rows.column("v").combine_chunks()
    v = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
    v = v.reshape(len(lists), len(v) // len(lists))
    ids = rows.column("id").to_numpy()
    good = np.flatnonzero(np.isfinite(v).all(axis=1))
    good = good[np.argsort(ids[good], kind="stable")]
    v = v[good]
    return ids[good], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _top_of(exact: np.ndarray, top: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the top values of every row by six digits, then by column; 64 divides the number of columns."""
    peaks = exact.reshape(len(exact), 64, -1).max(axis=1)
    bar = np.full(len(exact), least)
    if peaks.shape[1] >= top:  # as many columns reach this, so no lower value is among the top
        bar = np.maximum(bar, np.partition(peaks, peaks.shape[1] - top, axis=1)[:, peaks.shape[1] - top])
    row, col = np.nonzero(exact >= bar[:, None] - 2e-6)
    s = np.round(exact[row, col], 6)
    row, col, s = row[s >= least], col[s >= least], s[s >= least]
    # Of values that tie side by side, as copies do, the first ones are enough.
    at = np.arange(len(row))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1])])[: len(row)]
    few = at - np.maximum.accumulate(np.where(new, at, 0)) < top
    row, col, s = row[few], col[few], s[few]
    order = np.lexsort((col, -s, row))
    row, col = row[order], col[order]
    ahead = np.arange(len(row)) - np.searchsorted(row, row) < top
    return row[ahead], col[ahead]


def _several_blocks(right: DataFrame, left: DataFrame, block: int) -> DataFrame:
    """(g, dim, n_right, n_left): numbers of blocks of the groups that have more than one on a side.

    The list is short however many groups there are, as such a group has thousands of rows.
    """
    count = lambda df, name: df.groupBy("g", "dim").agg(F.count("*").alias(name))
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("dim"), F.lit(1)))))
    n_right, n_left = F.ceil(F.col("n") / most), F.ceil(F.col("asked") / most)
    n_left = F.when(n_right > 1, n_left).otherwise(F.greatest(n_left, F.least(F.lit(4), F.ceil(F.col("asked") / FEW_QUERIES))))
    sizes = count(right, "n").join(count(left, "asked"), ["g", "dim"]).select("g", "dim", n_right.alias("n_right"), n_left.alias("n_left"))
    return sizes.where("n_right > 1 or n_left > 1")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, group: str | None = None, least: float = -2.0, block: int = 32768) -> DataFrame:
    """The top most similar other vectors of every query: (query_id, id, similarity, rank).

    vectors and queries are (id, v), with a column group where only rows of one
    group are compared. A group's rows are dealt to blocks of up to block rows, by
    the group's own size; every pair of blocks is one product, in strips, that
    keeps the top rows of each query. So a row is shuffled once for each block of
    the other side, and never a row a pair. Similarities count by their six digits,
    ties by id; vectors of different lengths never meet. Rows with a null id, vector
    or group are left out, so are vectors with components that are null or not
    finite, and similarities below least.
    """
    least = max(least, -2.0)

    def side(df: DataFrame) -> DataFrame:
        kind = df.schema["v"].dataType
        v = F.col("v") if kind.simpleString() in ("array<float>", "array<double>") else F.col("v").cast("array<double>")
        return df.select((F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col("id").cast("long").alias("id"), v.alias("v"), F.size("v").alias("dim")).dropna()

    right, left = side(vectors), side(queries)
    large = F.broadcast(_several_blocks(right, left, block))

    def dealt(rows: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        count = lambda n: F.coalesce(n, F.lit(1).cast("long"))
        mine = F.pmod(F.xxhash64("id"), count(F.col(n_own))).alias(own)
        return rows.join(large, ["g", "dim"], "left").select("g", "dim", "id", "v", mine, F.explode(F.sequence(F.lit(0).cast("long"), count(F.col(n_other)) - 1)).alias(other))

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and rows.num_rows:
            (queries, q), (ids, m) = _matrix(asked), _matrix(rows)
            m = np.concatenate([m, np.zeros((-len(m) % 64, m.shape[1]))])
            strip = max(1, min(512, BLOCK_VALUES // max(len(m), 1)))
            for lo in range(0, len(q) if len(ids) else 0, strip):
                exact = q[lo : lo + strip] @ m.T
                exact[:, len(ids) :] = -4.0
                mine = queries[lo : lo + strip]
                here, end = np.searchsorted(ids, mine), np.searchsorted(ids, mine, "right")
                while (own := np.flatnonzero(here < end)).size:
                    exact[own, here[own]] = -4.0
                    here[own] += 1
                row, col = _top_of(exact, top, least)
                found.append((mine[row], ids[col], exact[row, col]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "id", "similarity"])

    pair = ["g", "dim", "i", "j"]
    met = dealt(left, "j", "n_left", "i", "n_right").groupBy(*pair).cogroup(dealt(right, "i", "n_right", "j", "n_left").groupBy(*pair))
    found = met.applyInArrow(best, "query_id long, id long, similarity double").withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Kinds of names, the most specific first; verbs that announce a decision; words that begin no concept.
ENTITY_KINDS = ("file", "symbol", "package", "decision", "concept")
DECIDING = ("decided", "chose", "agreed", "standardised", "standardized")
NO_CONCEPT = (
    "The This That These Those There When Where What Which While After Before Because However Also Note TODO And But For With "
    "From Into Once Then They Their Should Would Could Will Must"
).split()


def _files(text: Column) -> Column:
    """Tokens of path characters with two to seven parts, the last of which has an extension."""
    runs = F.transform(F.split(text, "[^A-Za-z0-9_./-]+"), lambda t: F.regexp_replace(t, "^[./-]+|[./-]+$", ""))
    parts = lambda t: F.split(t, "/")
    return F.filter(runs, lambda t: F.size(parts(t)).between(2, 7) & ~F.array_contains(parts(t), "") & F.element_at(parts(t), -1).rlike("^.+\\.[a-z]{1,5}$"))


def _symbols(text: Column) -> Column:
    """Identifiers of three characters and more that stand between backticks."""
    quoted = F.split(text, "`")
    return F.filter(F.slice(quoted, 2, F.greatest(F.size(quoted) - 2, F.lit(0))), lambda t: (F.length(t) > 2) & t.rlike("^[A-Za-z_$]") & ~t.rlike("[^A-Za-z0-9_$]"))


def _packages(text: Column) -> Column:
    """Names with a dash from their first part in lower case on, and names within a scope."""
    dashed = F.transform(F.split(text, "[^A-Za-z0-9_-]+"), lambda t: F.filter(F.split(t, "-"), lambda p: p != ""))
    at = lambda ps: F.array_position(F.transform(ps, lambda p: p.rlike("^[a-z]")), True)
    long = F.filter(dashed, lambda ps: (at(ps) > 0) & (at(ps) < F.size(ps)))
    names = F.transform(long, lambda ps: F.array_join(F.slice(ps, at(ps).cast("int"), F.size(ps)), "-"))
    scoped = F.filter(F.split(text, "[^A-Za-z0-9_@/-]+"), lambda t: t.startswith("@") & (F.size(F.split(t, "/")) == 2) & ~t.endswith("/") & (F.locate("@", t, 2) == 0) & (F.locate("/", t) > 2))
    return F.concat(names, scoped)


def _decisions(text: Column) -> Column:
    """What follows the first deciding verb of a clause, up to seventy characters."""
    clauses = F.transform(F.split(text, "[.;\n]"), lambda c: F.split(c, " "))
    verb = lambda ws: F.array_position(F.transform(ws, lambda w: F.lower(w).isin(*DECIDING)), True).cast("int")
    behind = F.transform(F.filter(clauses, lambda ws: verb(ws) > 0), lambda ws: F.slice(ws, verb(ws) + 1, F.size(ws)))
    plain = F.transform(behind, lambda ws: F.when(F.lower(F.get(ws, F.lit(0))).isin("to", "on"), F.slice(ws, 2, F.size(ws))).otherwise(ws))
    return F.filter(F.transform(plain, lambda ws: F.trim(F.substring(F.array_join(ws, " "), 1, 70))), lambda t: F.length(t) >= 6)


def _concepts(text: Column) -> Column:
    """Up to three capitalised words in a row, a space apart, that no stop word begins."""
    apart = F.split(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_ ]+", " | "), "  ", " | "), " ")
    marked = F.transform(apart, lambda w: F.when((F.length(w) > 2) & w.rlike("^[A-Z]") & ~w.rlike("[^A-Za-z]"), w).otherwise("|"))
    rows = F.filter(F.transform(F.split(F.array_join(marked, " "), "\\|"), lambda r: F.split(F.trim(r), " ")), lambda r: r[0] != "")
    threes = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(3)), lambda i: F.slice(r, i, 3))))
    return F.filter(F.transform(F.filter(threes, lambda r: ~r[0].isin(*NO_CONCEPT)), lambda r: F.array_join(r, " ")), lambda t: F.length(t) >= 4)


def entities(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, kind): names in a text, each with the most specific kind that fits.

    Tokens are classified by their shape; a text is read once and gives its names
    of all kinds in one array.
    """
    finders = (_files, _symbols, _packages, _decisions, _concepts)
    tag = lambda i: lambda t: F.struct(F.lower(t).alias("name"), F.lit(i).alias("order"))
    tagged = [F.transform(find(F.col("text")), tag(i)) for i, find in enumerate(finders)]
    found = texts.where("text is not null").select(key, F.explode(F.concat(*tagged)).alias("e")).select(key, "e.*")
    kinds = F.array(*[F.lit(k) for k in ENTITY_KINDS])
    return found.groupBy(key, "name").agg(F.min("order").alias("order")).select(key, "name", kinds[F.col("order")].alias("kind"))


#: Names of a basket that meet in one task.
BASKET = 256


def basket_pairs(mentions: DataFrame, key: str, name: str, block: int = BASKET) -> DataFrame:
    """(a, b, key): every two names a < b of one basket, once, with the basket that supports them.

    A basket is cut by hash into blocks of about block names, and every two blocks of it are a
    group of their own; so a basket of a third of all names becomes many tasks.
    """
    each = mentions.select(F.col(key).alias("g"), F.col(name).alias("n")).dropna().distinct()
    sizes = each.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = each.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spread = dealt.withColumn("other", others).select("g", "n", "own", low.alias("i"), high.alias("j"))
    left = spread.where("own = i").select("g", "i", "j", F.col("n").alias("a"))
    right = spread.where("own = j").select("g", "i", "j", F.col("n").alias("b"))
    met = left.join(right, ["g", "i", "j"])
    # In a group of two blocks each name of one meets each of the other once; within a block both orders meet.
    return met.where("a < b or (a > b and i < j)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("g").alias(key))


def co_occurrence(mentions: DataFrame, key: str, name: str) -> DataFrame:
    """Undirected edges (a, b, weight) between names of one basket; basket_pairs has what supports each."""
    return basket_pairs(mentions, key, name).groupBy("a", "b").agg(F.count("*").alias("weight"))


def centrality(edges: DataFrame) -> DataFrame:
    """Sum of the weights at every vertex."""
    ends = edges.select(F.col("a").alias("name"), "weight").union(edges.select(F.col("b").alias("name"), "weight"))
    return ends.groupBy("name").agg(F.sum("weight").alias("degree"))


def chunk_text(rows: DataFrame, size: int = 1200, overlap: int = 150, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, start, chunk): overlapping parts that end at a paragraph, sentence or line where one is past half."""

    def cut(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, number, text = 0, 0, text or ""
                while start < len(text):
                    end = min(start + size, len(text))
                    if end < len(text):
                        piece = text[start:end]
                        for mark in ("\n\n", ". ", "\n"):
                            at = piece.rfind(mark)
                            if at > size // 2:
                                end = start + at + len(mark)
                                break
                    for column, value in zip(out, (name, number, start, text[start:end].strip())):
                        column.append(value)
                    if end >= len(text):
                        break
                    start, number = max(end - overlap, start + 1), number + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], [key, "chunk_no", "start", "chunk"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(cut, f"{key} {kind}, chunk_no int, start int, chunk string")
