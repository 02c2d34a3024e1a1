"""Rules over file and function metrics, templates, hashed vectors and ordered groups."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import STOP_WORDS
from tessera.sources.scratch import saved

#: Limits beyond which a measure is a finding.
LIMITS = {"density": 0.2, "density_floor": 40, "function_complexity": 20, "function_lines": 120, "file_lines": 600, "nesting": 5, "parameters": 6, "fan_out": 20, "fan_in": 25}


def _rule(rows: DataFrame, name: str, category: str, when: Column, severity: Column, *keys: str) -> DataFrame:
    return rows.where(when).select(*keys, F.lit(name).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"))


def file_rules(files: DataFrame, key: str = "path") -> DataFrame:
    """Findings on files of (key, code, complexity, nesting, is_test); tests are let off."""
    own = files.where("not is_test")
    density = F.col("complexity") / F.greatest(F.col("code"), F.lit(1))
    found = [
        _rule(own, "branch-density", "complexity", (density > LIMITS["density"]) & (F.col("complexity") >= LIMITS["density_floor"]), F.when(density > 0.35, "critical").otherwise("high"), key),
        _rule(own, "oversize", "size", F.col("code") > LIMITS["file_lines"], F.when(F.col("code") > 1200, "high").otherwise("medium"), key),
        _rule(own, "nesting", "complexity", F.col("nesting") > LIMITS["nesting"], F.lit("medium"), key),
    ]
    return reduce(DataFrame.unionByName, found)


def function_rules(functions: DataFrame, key: str = "path") -> DataFrame:
    """Findings on functions of (key, name, complexity, lines, parameters)."""
    cx = F.col("complexity")
    found = [
        _rule(functions, "function-complexity", "complexity", cx > LIMITS["function_complexity"], F.when(cx > 40, "critical").when(cx > 28, "high").otherwise("medium"), key, "name"),
        _rule(functions, "function-length", "size", F.col("lines") > LIMITS["function_lines"], F.lit("medium"), key, "name"),
        _rule(functions, "parameters", "complexity", F.col("parameters") > LIMITS["parameters"], F.lit("low"), key, "name"),
    ]
    return reduce(DataFrame.unionByName, found)


def unless_function_found(files: DataFrame, functions: DataFrame, key: str = "path") -> DataFrame:
    """File findings of a category without those whose functions have one."""
    return files.join(functions.select(key, "category").distinct(), [key, "category"], "left_anti")


def coupling_rules(nodes: DataFrame) -> DataFrame:
    """Findings on (node, fan_in, fan_out)."""
    out = F.col("fan_out")
    found = [
        _rule(nodes, "fan-out", "coupling", out > LIMITS["fan_out"], F.when(out > 40, "high").otherwise("medium"), "node"),
        _rule(nodes, "fan-in", "coupling", F.col("fan_in") > LIMITS["fan_in"], F.lit("low"), "node"),
    ]
    return reduce(DataFrame.unionByName, found)


def untested(files: DataFrame, tests: DataFrame, key: str = "path") -> DataFrame:
    """Complex files (complexity 12, code 60 and more) whose path without test marks no test has."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "(^|/)(tests?|__tests__)/", "$1"), "([._-](test|spec)|test_)", "")
    want = files.where((F.col("complexity") >= 12) & (F.col("code") >= 60)).withColumn("__p", plain(F.col(key)))
    return want.join(tests.select(plain(F.col(key)).alias("__p")).distinct(), "__p", "left_anti").drop("__p")


def undocumented(files: DataFrame) -> DataFrame:
    """Files of 120 lines of code and more with under 3 in 100 of comment."""
    return files.where((F.col("code") >= 120) & (F.col("comment") / F.greatest(F.col("code") + F.col("comment"), F.lit(1)) < 0.03))


def render(template: Column, variables: Column) -> Column:
    """{{name}} filled from a map; unknown names stay as they are."""
    return F.aggregate(F.map_entries(variables), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e.key, F.lit("}}")), F.coalesce(e.value, F.lit(""))))


def template_variables(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit("\\{\\{\\s*([A-Za-z0-9_.]+)\\s*\\}\\}"), F.lit(1))))


_WORD = re.compile("[A-Za-z0-9_$]+")
_STOP = frozenset(STOP_WORDS)
_HUMP = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Characters and rows whose features are counted at a time; a longer text comes alone.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 2000


def _terms(word: str) -> list[str]:
    """What tokens() makes of one word."""
    low, found = word.lower(), []
    if low != word or not word.isalnum():
        parts = [p for p in re.split("[ _$]+", _HUMP.sub(" ", word).lower()) if p]
        found = [p for p in parts if p != low] if len(parts) > 1 else []
    return [t for t in (low, *found) if len(t) > 1 and t not in _STOP]


def _fnv(codes: np.ndarray, ends: np.ndarray, most: int = 64) -> np.ndarray:
    """32-bit FNV-1a of stretches of codes that end at ends, character by character in all of them at once."""
    prime, size = 16777619, np.diff(ends, prepend=0)
    h = np.full(len(ends), 2166136261, np.uint32)
    order = np.argsort(-size, kind="stable")
    for at, n in enumerate(len(size) - np.searchsorted(np.sort(size), np.arange(min(most, int(size.max(initial=0)))), "right")):
        now = order[:n]
        h[now] = (h[now] ^ codes[ends[now] - size[now] + at]) * np.uint32(prime)
    for i in np.flatnonzero(size > most):
        one = int(h[i])
        for c in codes[ends[i] - size[i] + most : ends[i]].tolist():
            one = (one ^ c) * prime & 0xFFFFFFFF
        h[i] = one
    return h.astype(np.int64)


def _numbered(names: Iterable[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(dict.fromkeys(names))}


def _word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of every token of every text."""
    each = [Counter(_WORD.findall(t)) for t in texts]
    words = [w for c in each for w in c]
    known = _numbered(words)
    of_word = [_terms(w) for w in known]
    terms = _numbered(t for ts in of_word for t in ts)
    many = np.array([len(ts) for ts in of_word], np.int64)
    flat = np.fromiter((terms[t] for ts in of_word for t in ts), np.int64)
    # A word's count goes to each of its tokens; a token of several words sums theirs.
    word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    copies = many[word]
    ends = np.cumsum(copies)
    term = flat[np.repeat((np.cumsum(many) - many)[word] - (ends - copies), copies) + np.arange(copies.sum())]
    text = np.repeat(np.repeat(np.arange(len(texts)), [len(c) for c in each]), copies)
    counts = np.repeat(np.array([n for c in each for n in c.values()], float), copies)
    key, of = np.unique(text * max(len(terms), 1) + term, return_inverse=True)
    codes = np.frombuffer("".join(terms).encode("ascii"), np.uint8)
    hashes = _fnv(codes, np.cumsum([len(t) for t in terms], dtype=np.int64))
    return key // max(len(terms), 1), hashes[key % max(len(terms), 1)], np.bincount(of, counts, len(key))


def _gram_features(low: list[str], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of every trigram of trimmed texts in lower case between two spaces, step windows at a time."""
    codes = np.frombuffer((" " + "  ".join(low) + "   ").encode("utf-32-le"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.concatenate([[0], np.flatnonzero(seen)])  # 0: no character
    k = len(alphabet)
    if len(low) * k**3 >= 1 << 63:
        half = [_gram_features(low[: len(low) // 2], step), _gram_features(low[len(low) // 2 :], step)]
        return tuple(np.concatenate([a, b + (len(low) // 2 if i == 0 else 0)]) for i, (a, b) in enumerate(zip(*half)))
    numbers = np.zeros(0x110000, np.int32)
    numbers[alphabet[1:]] = np.arange(1, k)
    letters = numbers[codes]
    size = np.array([len(t) for t in low])
    windows = np.maximum(size, 1)  # an empty text has the two spaces alone
    ends = np.cumsum(windows)
    shift = np.concatenate([[0], np.cumsum(size + 2)[:-1]]) - (ends - windows)
    kind = np.uint32 if len(low) * k**3 < 1 << 32 else np.uint64
    keys, counts = [], []
    for lo in range(0, int(ends[-1]), step):
        hi = min(lo + step, int(ends[-1]))
        here = np.repeat(np.arange(len(low)), np.clip(ends, lo, hi) - np.clip(ends - windows, lo, hi))
        at = np.arange(lo, hi) + shift[here]
        third = np.where(size[here] > 0, letters[at + 2], 0)
        key = ((here * k + letters[at]) * k + letters[at + 1]) * k + third
        key = np.sort(key.astype(kind))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[first])
        counts.append(np.diff(np.append(first, len(key))))
    key, n = keys[0], counts[0]
    if len(keys) > 1:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, np.concatenate(counts))
    key = key.astype(np.int64)
    h, prime = np.full(len(key), 2166136261, np.uint32), np.uint32(16777619)
    for unit in (k * k, k, 1):
        c = alphabet[key // unit % k].astype(np.uint32)
        h = np.where(c > 0, (h ^ c) * prime, h)
    return key // k**3, h.astype(np.int64), n.astype(float)


def _unit_vectors(texts: list[str], low: list[str], size: int) -> np.ndarray:
    total = np.zeros(len(texts) * size)
    for share, (at, h, n) in ((1.0, _word_features(texts)), (0.25, _gram_features(low))):
        weight = share * (1 + np.log(n)) * np.where(h >> 16 & 1, -1.0, 1.0)
        total += np.bincount(at * size + h % size, weight, len(total))
    v = total.reshape(len(texts), size)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CHARS, "right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS, len(sizes))
        yield lo, hi
        lo = hi


def _lowered(text: Column) -> Column:
    return F.lower(F.trim(text))


def _valid(text: str) -> Column:
    return F.call_function("make_valid_utf8", F.col(text).cast("string"))


def hashed_vectors(texts: DataFrame, key: str = "doc_id", size: int = 384) -> DataFrame:
    """(key, v): unit vectors of hashed tokens (1 + ln of their count) and, by a quarter, trigrams.

    Buckets and signs come from a 32-bit hash. A text's features are counted where
    it is read, a slice of texts at a time; nothing is shuffled. Null texts fall out.
    """
    rows = texts.select(F.col(key).alias("k"), _valid("text").alias("t")).where("t is not null").select("k", "t", _lowered(F.col("t")).alias("l"))
    schema = T.StructType([rows.schema["k"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                v = _unit_vectors(batch.column(1)[lo:hi].to_pylist(), batch.column(2)[lo:hi].to_pylist(), size)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, size), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], ["k", "v"])

    return rows.mapInArrow(vectors, schema).select(F.col("k").alias(key), "v")


def hashed_similarity(pairs: DataFrame, key: str, a: str, b: str, size: int = 384) -> DataFrame:
    """(key, similarity): the cosine of the hashed vectors of two texts of a row, from 0 to 1; null where one is null.

    Both vectors are made where the row is read, so no feature, vector or text is
    shuffled. Texts that are equal are sent and counted once.
    """
    texts = pairs.select(F.col(key).alias("k"), _valid(a).alias("a"), _valid(b).alias("b"))
    sides = texts.select("k", F.when(F.col("b").isNotNull(), F.col("a")).alias("a"), F.when(F.col("a") != F.col("b"), F.col("b")).alias("b"))
    rows = sides.select("k", "a", _lowered(F.col("a")).alias("la"), "b", _lowered(F.col("b")).alias("lb"))
    schema = T.StructType([rows.schema["k"], T.StructField("similarity", T.DoubleType())])

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = sum(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in (1, 3))
            for lo, hi in _slices(chars):
                first, low, second, other = (batch.column(c)[lo:hi].to_pylist() for c in (1, 2, 3, 4))
                have, differ = [i for i, t in enumerate(first) if t is not None], [i for i, t in enumerate(second) if t is not None]
                out = np.full(hi - lo, np.nan)
                if have:
                    v = _unit_vectors([*(first[i] for i in have), *(second[i] for i in differ)], [*(low[i] for i in have), *(other[i] for i in differ)], size)
                    left, right = v[: len(have)], v[: len(have)].copy()
                    right[np.searchsorted(have, differ)] = v[len(have) :]
                    out[have] = np.clip((left * right).sum(axis=1), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(out, from_pandas=True)], ["k", "similarity"])

    return rows.mapInArrow(scores, schema).select(F.col("k").alias(key), "similarity")


def leader_groups(rows: DataFrame, pairs: DataFrame, most: int = 100) -> DataFrame:
    """(id, leader): greedy groups in the order of (created, id) over similar pairs (a, b).

    Each round a row with no earlier undecided neighbour leads, and its undecided
    neighbours join the earliest such leader; the result is that of one pass in
    order. rows is (id, created).
    """
    place = rows.select("id", F.struct("created", "id").alias("at"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct()
    near = saved(both.join(place.withColumnRenamed("id", "a").withColumnRenamed("at", "a_at"), "a").join(place.withColumnRenamed("id", "b").withColumnRenamed("at", "b_at"), "b"))
    open_, done = saved(rows.select("id")), None
    for _ in range(most):
        live = near.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").join(open_.withColumnRenamed("id", "b"), "b", "left_semi")
        live = saved(live)
        late = live.where("b_at < a_at").select(F.col("a").alias("id")).distinct()
        leads = saved(open_.join(late, "id", "left_anti"))
        joined = live.join(leads.withColumnRenamed("id", "b"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min(F.struct("b_at", "b"))["b"].alias("leader"))
        step = saved(leads.select("id", F.col("id").alias("leader")).unionByName(joined.join(leads, "id", "left_anti")))
        if step.isEmpty():
            break
        done = step if done is None else done.unionByName(step)
        open_ = saved(open_.join(step, "id", "left_anti"))
    return done


def merge_by_alias(advisories: DataFrame) -> DataFrame:
    """advisories (seq, id, aliases) without those that share a name with an earlier kept one."""
    named = advisories.select("seq", F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    pairs = named.select(F.col("seq").alias("a"), "name").join(named.select(F.col("seq").alias("b"), "name"), "name").where("a < b").select("a", "b").distinct()
    groups = leader_groups(advisories.select(F.col("seq").alias("id"), F.col("seq").alias("created")), pairs)
    return advisories.join(groups.where("id = leader").select(F.col("id").alias("seq")), "seq", "left_semi")


def touched_functions(functions: DataFrame, added: DataFrame, key: str = "path") -> DataFrame:
    """Functions (key, name, line_no, end_line) with an added line (key, new_line) inside."""
    return functions.alias("f").join(added.select(F.col(key).alias("__k"), "new_line").alias("a"), (F.col(f"f.{key}") == F.col("__k")) & F.col("new_line").between(F.col("line_no"), F.col("end_line")), "left_semi")


def access_counts(log: DataFrame, key: str) -> DataFrame:
    """How often and when last each row was returned, from an appended log (key, at)."""
    return log.groupBy(key).agg(F.count("*").alias("uses"), F.max("at").alias("last_used"))


def top_labels(hits: DataFrame, least: float = 1.2) -> DataFrame:
    """The best label of every query with a score of least or more."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.where(F.col("score") >= least).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
