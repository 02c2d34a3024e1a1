"""Toxicity from a learned lexicon, matched through Levenshtein automata."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BASE, SpanHasher, id_crc, map_text, materialise, mix64, runs, table, texts

END = "$"  # closes a term that must be the whole word; a term without it is a stem
QUOTES = "\"“”„«»`"
#: Characters on either side in which quotation marks and words around a match count.
CONTEXT = 48


def edits_allowed(term: str) -> int:
    """Misspellings forgiven: none in stems and short words, one from five letters, two from nine."""
    n = len(term) - 1
    return 0 if not term.endswith(END) or n < 5 else 1 if n < 9 else 2


@dataclass
class Automaton:
    """One deterministic automaton for the trie of terms crossed with their Levenshtein automata.

    A state is a set of (trie node, edits so far). Rows of step are states,
    columns are classes of characters; state 0 is dead. verdict is what a word
    that ends in a state is: 0 nothing, 1 a term, 2 a misspelling, 3 a stem.
    """

    step: np.ndarray
    verdict: np.ndarray
    classes: np.ndarray  # class by code point of the basic plane; 0 parts words
    other: int

    @staticmethod
    def build(terms: list[str]) -> Automaton:
        letters = sorted({c for t in terms for c in t if c != END})
        other = len(letters) + 1
        classes = np.fromiter((other if chr(i).isalnum() else 0 for i in range(0x10000)), np.int32, 0x10000)
        for i, c in enumerate(letters):
            classes[ord(c)] = i + 1
        child: list[dict[str, int]] = [{}]
        room, whole, stem = [0], [False], [False]
        for t in terms:
            node = 0
            for c in t.rstrip(END):
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    room.append(0)
                    whole.append(False)
                    stem.append(False)
                room[node] = max(room[node], edits_allowed(t))
                node = child[node][c]
            room[node] = max(room[node], edits_allowed(t))
            whole[node] |= t.endswith(END)
            stem[node] |= not t.endswith(END)
        allowed = [0] * len(child)  # of the terms that end at a node
        for t in terms:
            node = 0
            for c in t.rstrip(END):
                node = child[node][c]
            if t.endswith(END):
                allowed[node] = edits_allowed(t)

        def close(state: dict[int, int]) -> frozenset:
            """With deletions, each node with its fewest edits; a finished stem is the state None."""
            todo = list(state.items())
            while todo:
                node, e = todo.pop()
                if e == 0 and stem[node]:
                    return frozenset([(-1, 0)])
                for nxt in child[node].values():
                    if e + 1 <= room[nxt] and state.get(nxt, 9) > e + 1:
                        state[nxt] = e + 1
                        todo.append((nxt, e + 1))
            return frozenset(state.items())

        def after(state: frozenset, c: str | None) -> frozenset:
            if (-1, 0) in state:
                return state
            new: dict[int, int] = {}
            for node, e in state:
                if e + 1 <= room[node]:  # one character too many
                    new[node] = min(new.get(node, 9), e + 1)
                for k, nxt in child[node].items():
                    cost = e + (k != c)
                    if cost == 0 or cost <= room[nxt]:
                        new[nxt] = min(new.get(nxt, 9), cost)
            return close(new)

        def judge(state: frozenset) -> int:
            if (-1, 0) in state:
                return 3
            ends = [e for node, e in state if whole[node] and e <= allowed[node]]
            return 0 if not ends else 1 if min(ends) == 0 else 2

        start = close({0: 0}) if terms else frozenset()
        number = {frozenset(): 0, start: 1} if terms else {frozenset(): 0}
        order = [frozenset(), start] if terms else [frozenset()]
        step: list[list[int]] = []
        at = 0
        while at < len(order):
            row = [0]
            for c in [*letters, None]:
                nxt = after(order[at], c)
                if nxt not in number:
                    number[nxt] = len(order)
                    order.append(nxt)
                row.append(number[nxt])
            step.append(row)
            at += 1
        return Automaton(np.array(step, np.int32), np.array([judge(s) for s in order], np.int8), classes, other)

    def match(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words and each word's verdict; all words advance together."""
        kind = np.where(points < 0x10000, self.classes[np.minimum(points, 0xFFFF)], self.other)
        start, end = runs(kind > 0)
        verdict = np.zeros(len(start), np.int8)
        if len(self.step) < 2:
            return start, end, verdict
        live = np.arange(len(start))
        state = np.ones(len(start), np.int32)
        at = start.copy()
        while len(live):
            state = self.step[state, kind[at]]
            at = at + 1
            done = at >= end[live]
            verdict[live[done]] = self.verdict[state[done]]
            go = ~done & (state > 0)
            live, state, at = live[go], state[go], at[go]
        return start, end, verdict


FEATURES = 7


def features(column: pa.Array, automaton: Automaton) -> np.ndarray:
    """Counts of matches by kind and by what stands around them, for whole texts.

    A match between quotation marks counts as quoted; a match with another match
    within the context window counts as piled on.
    """
    part = [t.lower() for t in texts(column)]
    points = np.frombuffer("\n".join(part).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.cumsum([0] + [len(t) + 1 for t in part])
    start, end, verdict = automaton.match(points)
    doc = np.searchsorted(bounds, start, "right") - 1
    words = np.bincount(doc, minlength=len(part))
    hit = np.flatnonzero(verdict)
    marks = np.flatnonzero(np.isin(points, [ord(c) for c in QUOTES]))
    d, s, e = doc[hit], start[hit], end[hit]
    low, high = np.maximum(s - CONTEXT, bounds[d]), np.minimum(e + CONTEXT, bounds[d + 1])
    before = np.searchsorted(marks, s) > np.searchsorted(marks, low)
    behind = np.searchsorted(marks, high) > np.searchsorted(marks, e)
    quoted = before & behind
    crowd = np.searchsorted(s, high) - np.searchsorted(e, low, "right") > 1
    kind = verdict[hit]
    out = np.zeros((len(part), FEATURES))
    for k, chosen in enumerate(((kind == 1) & ~quoted, (kind == 2) & ~quoted, (kind == 3) & ~quoted, quoted, crowd & ~quoted)):
        out[:, k] = np.log1p(np.bincount(d[chosen], minlength=len(part)))
    every = np.bincount(d[~quoted], minlength=len(part))
    out[:, 5] = every > 0
    out[:, 6] = 10 * every / np.maximum(words, 10)
    return out


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -30.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


#: Shortest and longest beginning of a word that can become a stem.
STEM = (4, 12)
_TERM = T.ArrayType(T.StructType([T.StructField("term", T.LongType()), T.StructField("place", T.LongType()), T.StructField("first", T.LongType())]))


def _spans(column: pa.Array, automaton: Automaton) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts of a slice, their code points, and text number, start and end of every word."""
    source = [t.lower() for t in texts(column)]
    points = np.frombuffer("\n".join(source).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.cumsum([0] + [len(t) + 1 for t in source])
    start, end, _ = automaton.match(points)
    return source, points, np.searchsorted(bounds, start, "right") - 1, start, end


def _term_spans(start: np.ndarray, end: np.ndarray, hasher: SpanHasher):
    """(words, ends, hashes) of every word's beginnings, one length after another, and of the closed words."""
    size = end - start
    for k in range(STEM[0], STEM[1] + 1):
        words = np.flatnonzero(size >= k)
        yield words, start[words] + k, hasher(start[words], start[words] + k)
    words = np.flatnonzero(size >= STEM[0])
    yield words, end[words], mix64(hasher(start[words], end[words]) ^ np.uint64(ord(END)))


def _terms():
    """Of every text the distinct (hash of a term, hash of the term and the words on both sides, 1 once a term)."""
    automaton = Automaton.build([])

    def work(column: pa.Array) -> dict[str, pa.Array]:
        _, points, doc, start, end = _spans(column, automaton)
        hasher = SpanHasher(points)
        word = hasher(start, end)
        same = doc[1:] == doc[:-1]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:][same], after[:-1][same] = word[:-1][same], word[1:][same]
        beside = mix64(before * np.uint64(BASE) + after)
        docs, terms, places, firsts = [], [], [], []
        for words, _, term in _term_spans(start, end, hasher):
            place = mix64(term * np.uint64(BASE) ^ beside[words])
            _, first = np.unique(mix64(place ^ mix64(doc[words].astype(np.uint64))), return_index=True)
            docs.append(doc[words][first])
            terms.append(term[first])
            places.append(place[first])
            fresh = np.zeros(len(first), np.int64)
            fresh[np.unique(mix64(term[first] ^ mix64(doc[words][first].astype(np.uint64))), return_index=True)[1]] = 1
            firsts.append(fresh)
        doc_of, term, place, fresh = (np.concatenate(x) for x in (docs, terms, places, firsts))
        order = np.argsort(doc_of, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(doc_of, minlength=len(column))))).astype(np.int32)
        pair = pa.StructArray.from_arrays([pa.array(x[order].view(np.int64)) for x in (term, place, fresh)], ["term", "place", "first"])
        return {"terms": pa.ListArray.from_arrays(pa.array(ends), pair)}

    return work


def _spelled(wanted: np.ndarray):
    """Of every text the terms with a hash among wanted (sorted), as (hash, spelling)."""

    def start_():
        automaton = Automaton.build([])

        def work(column: pa.Array) -> dict[str, pa.Array]:
            source, points, doc, start, end = _spans(column, automaton)
            base = np.cumsum([0] + [len(t) + 1 for t in source])
            out: list[dict[int, str]] = [{} for _ in source]
            for k, (words, stop, term) in enumerate(_term_spans(start, end, SpanHasher(points))):
                at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
                _, first = np.unique(np.where(wanted[at] == term, term, np.uint64(0)), return_index=True)
                for i in first[wanted[at[first]] == term[first]].tolist():
                    w, d = words[i], int(doc[words[i]])
                    closed = END if k == STEM[1] - STEM[0] + 1 else ""
                    out[d][int(term[i].view(np.int64))] = source[d][start[w] - base[d] : stop[i] - base[d]] + closed
            rows = [[{"term": a, "spelling": b} for a, b in sorted(x.items())] for x in out]
            return {"spelled": pa.array(rows, pa.list_(pa.struct([("term", pa.int64()), ("spelling", pa.string())])))}

        return work

    return start_


def choose_terms(found: dict[str, int]) -> list[str]:
    """Of terms with their counts of contexts: the longest that say the same, then the shortest of those."""
    kept = set(found)
    for u, n in found.items():
        if n >= 0.95 * found.get(u[:-1], np.inf):
            kept.discard(u[:-1])
    return sorted(t for t in kept if not any(t[:k] in kept for k in range(1, len(t))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4000) -> ToxicityModel:
    """Learn lexicon and weights from at most about per_class labelled texts of each class.

    labels has doc_id and toxic (0 or 1; other values and nulls are left out, of
    several labels the highest counts). The texts are those of least hash of
    doc_id. A term goes into the lexicon if it stands in enough toxic texts,
    between enough different words, and in hardly any others, so that neither one text nor
    its copies make a term; weights come from logistic regression, where a drawn text
    stands for all of its class. Terms are counted by their hashes and spelled
    out once they are chosen; a term needs a hundredth of the drawn toxic texts
    in contexts, so the drawn texts bound how many reach the driver.
    Without toxic labels every score is near 0.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(train)
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return ToxicityModel()
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    picked = own.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).limit(4 * per_class)
    sample = materialise(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    terms = map_text(sample, _terms, [T.StructField("terms", _TERM)], ("toxic",))
    drawn = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not drawn.get(1) or not drawn.get(0):
        return ToxicityModel()
    enough = max(4, round(0.01 * drawn[1]))
    # Of what lies in the drawn texts, which hold as many clean as toxic ones where there are enough.
    ratio = drawn[1] / drawn[0]
    found = (
        terms.select("toxic", F.explode("terms").alias("t"))
        .groupBy("toxic", "t.term", "t.place")
        .agg(F.sum("t.first").alias("texts"))
        .groupBy("term")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.sum(F.col("toxic") * F.col("texts")).alias("texts"))
        .where((F.col("bad") >= enough) & (F.col("texts") >= enough) & (F.col("bad") >= 12.0 * ratio * F.col("good")))
        .collect()
    )
    bad = {r["term"]: int(r["bad"]) for r in found}
    wanted = np.sort(np.array(list(bad), np.int64).view(np.uint64))
    spelling: dict[int, str] = {}
    if bad:
        kind = T.ArrayType(T.StructType([T.StructField("term", T.LongType()), T.StructField("spelling", T.StringType())]))
        spelled = map_text(sample.where("toxic = 1"), _spelled(wanted), [T.StructField("spelled", kind)], ("doc_id",))
        spelled = spelled.select(F.explode("spelled").alias("s")).groupBy("s.term").agg(F.min("s.spelling").alias("spelling"))
        spelling = {r["term"]: r["spelling"] for r in spelled.collect()}
    model = ToxicityModel(choose_terms({spelling[t]: n for t, n in bad.items()}))
    automaton = Automaton.build(model.terms)

    def start():
        return lambda column: {"x": pa.array(list(features(column, automaton)), pa.list_(pa.float64()))}

    got = map_text(sample, start, [T.StructField("x", T.ArrayType(T.DoubleType()))], ("toxic",))
    got = got.groupBy("toxic", "x").count().toPandas()
    x = np.array([np.asarray(v, float) for v in got["x"]])
    y = got["toxic"].to_numpy(float)
    mass = got["count"].to_numpy(float) / np.where(y == 1, share[1], share[0])
    mass /= mass.sum()
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    for _ in range(60):  # Newton steps, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.append(np.full(FEATURES, 1e-4), 1e-8)
        slope = design.T @ (mass * (p - y)) + ridge * w
        bend = (design * (mass * p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        move = np.linalg.solve(bend, slope)
        w -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return ToxicityModel(model.terms, w[:-1], float(w[-1]))


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def _start(model: ToxicityModel):
    def start():
        automaton = Automaton.build(model.terms)

        def work(column: pa.Array) -> dict[str, pa.Array]:
            score = model.score(features(column, automaton))
            return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

        return work

    return start


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """score (0 to 1) and predicted (score of 0.5 or more) for every whole text.

    Null and empty texts have no match and get the score of the bias. Only the
    text is looked at, so equal texts get equal scores. Columns outside keep are
    dropped, kept ones named as results are replaced. Nothing is shuffled.
    """
    return map_text(docs, _start(model), FIELDS, keep)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows of docs, all columns, that are not predicted toxic."""
    return map_text(docs, _start(model), FIELDS, docs.columns, where=lambda new: pc.equal(new["predicted"], 0))


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(5)) == 0


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
