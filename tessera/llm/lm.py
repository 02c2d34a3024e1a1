"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SpanHasher, by_size, id_crc, materialise, runs, table, utf8_parts

#: Commonest words that are classes of their own, and the classes that all others share by their last two bytes.
MODEL_WORDS, BUCKETS = 250, 400
#: Commonest words whose counts go to every task; the counts of rarer ones are joined.
HEAD_WORDS = 32_768
DIM, CONTEXT, NOISE, BATCH, RATE = 16, 2, 64, 512, 0.4
#: Tokens of a training shard, and the disjoint parts of the texts that are learnt from one after another.
SHARD_TOKENS, ROUNDS = 2_000_000, 2
START, STOP = 0, 1  # ids of the model; words follow, the shared classes are last
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Natural logarithm of ten.
_LN10 = float(np.log(10))


def words_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space, A-Z in lower case."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


#: Odd multiplier that spreads two-byte values before they are dealt to classes.
_SPREAD = 40_503


def bucket_of(word: Column, buckets: int) -> Column:
    """The shared class of a word, from 0: its last two bytes, multiplied and scaled."""
    value = F.conv(F.hex(F.substring(word.cast("binary"), -2, 2)), 16, 10).cast("long")
    return F.shiftright(F.pmod(value * _SPREAD, F.lit(65_536)) * buckets, 16).cast("int")


def bucket_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> np.ndarray:
    """bucket_of for words that are spans of a buffer of bytes."""
    value = data[end - 1].astype(np.int64)
    value += np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64) << 8
    return ((value * _SPREAD & 0xFFFF) * buckets) >> 16


@dataclass
class Lexicon:
    """Hashes of the commonest words, sorted, with their counts and model ids (-1 in a shared class)."""

    keys: np.ndarray
    counts: np.ndarray
    model: np.ndarray
    size: int  # model ids
    buckets: int

    @staticmethod
    def build(words: list[tuple[str, int]], model_words: int, buckets: int = BUCKETS) -> Lexicon:
        """words by falling count."""
        raw = [w.encode() for w, _ in words]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if raw else ends
        keys = SpanHasher(np.frombuffer(b"".join(raw), np.uint8))(starts, ends)
        known = min(model_words, len(words))
        ids = np.where(np.arange(len(words)) < known, np.arange(len(words)) + STOP + 1, -1)
        order = np.argsort(keys)
        counts = np.array([c for _, c in words], np.int64)
        return Lexicon(keys[order], counts[order], ids[order], known + STOP + 1 + buckets, buckets)

    def __post_init__(self):
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int64)
        maybe = np.flatnonzero(self.filter[key >> np.uint64(44)])
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == key[maybe]
            out[maybe[hit]] = at[hit]
        return out


@dataclass
class Tokens:
    """The tokens of some texts in order, each text closed by STOP."""

    doc: np.ndarray
    model: np.ndarray
    before: np.ndarray  # contexts, the nearest first
    head: np.ndarray  # row in the lexicon; -1 for rarer words, -2 for STOP
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def tokens_of(column: pa.Array, lexicon: Lexicon) -> Tokens:
    offsets, data = utf8_parts(column)
    n = len(offsets) - 1
    data = _LOWER[data]
    inside = ~_SPACE[data]
    s, e = runs(inside)
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
    doc = np.searchsorted(offsets, s, "right") - 1
    head = lexicon.find(SpanHasher(data)(s, e))
    model = lexicon.size - lexicon.buckets + bucket_numbers(data, s, e, lexicon.buckets)
    single = np.where(head >= 0, lexicon.model[head], -1) if len(lexicon.model) else np.full(len(s), -1)
    model = np.where(single >= 0, single, model)
    # Stops go in behind the words of each text.
    count = np.bincount(doc, minlength=n)
    stop_at = np.cumsum(count + 1) - 1
    total = len(s) + n
    is_word = np.ones(total, bool)
    is_word[stop_at] = False
    put = lambda values, stop: _spread(values, stop, is_word)
    all_doc = np.repeat(np.arange(n), count + 1)
    ids = put(model, STOP)
    first = np.cumsum(count + 1) - (count + 1)
    place = np.arange(total) - np.repeat(first, count + 1)
    before = np.zeros((CONTEXT, total), np.int64)
    for k in range(CONTEXT):
        ok = np.flatnonzero(place > k)
        before[k, ok] = ids[ok - k - 1]
    return Tokens(all_doc, ids, before, put(head, -2), put(s, 0), put(e, 0), data)


def _spread(values: np.ndarray, other: int, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at), other, np.int64)
    out[at] = values
    return out


class LogBilinear:
    """score(w | context) = sum_k R[context_k] C_k . T[w] + b[w]."""

    def __init__(self, noise: np.ndarray, seed: int = 11, dim: int = DIM):
        rng = np.random.default_rng(seed)
        v = len(noise)
        self.noise = noise
        self.params = {
            "R": rng.normal(0, 0.3, (v, dim)).astype(np.float32),
            "T": rng.normal(0, 0.05, (v, dim)).astype(np.float32),
            "C": np.stack([np.eye(dim) / (k + 1) for k in range(CONTEXT)]).astype(np.float32),
            "b": np.log(noise).astype(np.float32),
        }
        self.total = {k: np.full(p.shape, 1e-2, np.float32) for k, p in self.params.items()}  # AdaGrad's sums of squares

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.params.values(), *self.total.values())])

    def weights(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """For every number of vector(), how often its class was seen as target or as context."""
        dim = self.params["C"].shape[1]
        every = np.full(self.params["C"].size, target.sum())
        return np.tile(np.concatenate([np.repeat(context, dim), np.repeat(target, dim), every, target]), 2)

    def load(self, vector: np.ndarray) -> LogBilinear:
        at = 0
        for part in (self.params, self.total):
            for name, p in part.items():
                part[name] = vector[at : at + p.size].reshape(p.shape).astype(np.float32)
                at += p.size
        return self

    def query(self, before: np.ndarray) -> np.ndarray:
        return sum(self.params["R"][before[k]] @ self.params["C"][k] for k in range(CONTEXT))

    def trainer(self, seed: int, rate: float = RATE):
        """A function that takes NCE steps over positions, with AdaGrad; noise is shared by a batch."""
        rng = np.random.default_rng(seed)
        total = self.total
        log_noise = np.log(self.noise * NOISE).astype(np.float32)
        cumulative = np.cumsum(self.noise)

        def step(before: np.ndarray, target: np.ndarray) -> None:
            p, n = self.params, len(target)
            r = [p["R"][before[k]] for k in range(CONTEXT)]
            q = sum(r[k] @ p["C"][k] for k in range(CONTEXT))
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(cumulative) - 1)
            t = p["T"][target]
            good = (q * t).sum(axis=1) + p["b"][target] - log_noise[target]
            bad = q @ p["T"][drawn].T + (p["b"] - log_noise)[drawn]
            g = (1 / (1 + np.exp(np.clip(good, -30, 30)))).astype(np.float32)
            f = (-1 / (1 + np.exp(-np.clip(bad, -30, 30)))).astype(np.float32)
            dq = g[:, None] * t + f @ p["T"][drawn]
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            _add_rows(grad["T"], target, g[:, None] * q)
            np.add.at(grad["T"], drawn, f.T @ q)
            grad["b"] += np.bincount(target, g, len(p["b"])).astype(np.float32)
            np.add.at(grad["b"], drawn, f.sum(axis=0))
            for k in range(CONTEXT):
                grad["C"][k] = r[k].T @ dq
                _add_rows(grad["R"], before[k], dq @ p["C"][k].T)
            for k in p:
                grad[k] /= n
                total[k] += grad[k] ** 2
                p[k] += rate * grad[k] / np.sqrt(total[k])

        def learn(tokens: Tokens) -> None:
            order = rng.permutation(len(tokens.model))
            for lo in range(0, len(order), BATCH):
                at = order[lo : lo + BATCH]
                step(tokens.before[:, at], tokens.model[at])

        return learn

    def log_probs(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities; equal contexts are worked out once."""
        v = len(self.noise)
        code = before[0]
        for k in range(1, CONTEXT):
            code = code * v + before[k]
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(0, len(one) + 4096, 4096))
        out = np.empty(len(target))
        classes = np.hstack([self.params["T"], self.params["b"][:, None]]).T.copy()
        reach = np.linalg.norm(self.params["T"], axis=1).max()
        for lo, a, b in zip(range(0, len(one), 4096), bounds[:-1], bounds[1:]):
            q = self.query(before[:, one[lo : lo + 4096]])
            s = np.hstack([q, np.ones((len(q), 1), np.float32)]) @ classes
            if np.linalg.norm(q, axis=1).max() * reach + np.abs(self.params["b"]).max() > 60:  # exp could run over
                s -= s.max(axis=1, keepdims=True)
            at = order[a:b]
            own = s[which[at] - lo, target[at]].astype(np.float64)
            np.exp(s, out=s)
            out[at] = own - np.log(s.sum(axis=1).astype(np.float64))[which[at] - lo]
        return out


def _add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """into[rows] += values with repeated rows, by sorted runs."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    into[ordered[first]] += np.add.reduceat(values[order], first, axis=0)


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, c) over all words of docs."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def train(docs: DataFrame, lexicon: Lexicon, noise: np.ndarray, tokens: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """One pass over all texts in rounds; in each, shards learn from common parameters and are averaged.

    A text's round and shard follow from the hash of its id and text, and there
    is a shard for about every shard_tokens tokens, so the model does not depend on
    how files are split. In the average a class's vectors count as often as the
    shard saw the class; parameters that no shard touched stay. Spark sums one
    parameter at a time: the driver gets the parameters alone, however many
    shards there are. Rows of one id and text go to one shard, which reads them
    as a stream.
    """
    model = LogBilinear(noise)
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    source = docs.select(F.col("text").cast("string").alias("text"), key.alias("key"))
    shards = max(1, -(-tokens // shard_tokens))
    for turn in range(rounds):
        begin = model.vector()

        def run(batches, begin=begin, turn=turn):
            own = LogBilinear(noise).load(begin)
            learn = own.trainer(turn + 1)
            target, context = np.zeros(len(noise)), np.zeros(len(noise))
            for batch in batches:
                for part in by_size(batch.column(0)):
                    found = tokens_of(part, lexicon)
                    learn(found)
                    target += np.bincount(found.model, minlength=len(noise))
                    context += np.bincount(found.before.ravel(), minlength=len(noise))
            if target.any():
                vector, weight = own.vector().astype(np.float64), own.weights(target, context)
                for lo in range(0, len(vector), 8192):
                    w = weight[lo : lo + 8192]
                    at = np.flatnonzero(w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((at + lo).astype(np.int32)), pa.array(vector[at + lo] * w[at]), pa.array(w[at])], ["at", "value", "weight"]
                    )

        part = source.where(F.pmod(F.shiftright("key", 32), F.lit(rounds)) == turn)
        dealt = part.repartition(shards, "key").sortWithinPartitions("key").select("text")
        got = dealt.mapInArrow(run, "at int, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value"))
        rows = got.toPandas()
        if len(rows):
            vector = begin.copy()
            vector[rows["at"].to_numpy()] = rows["value"].to_numpy()
            model.load(vector)
    return model


def score(
    docs: DataFrame, learn: Column, model_words: int = MODEL_WORDS, head_words: int = HEAD_WORDS, buckets: int = BUCKETS, rounds: int = ROUNDS
) -> DataFrame:
    """Token counts and log10 scores of every whole text, learning from the rows where learn holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, one
    row for each row of docs. base_score is the add-one unigram score. score is
    the model's: a word among the model_words commonest, or the end, by its
    normalised probability after the two tokens before it; any other word by
    that of the class of its last two bytes, times its add-one share in the class.

    Words are counted over all training texts. The counts of the head_words
    commonest go to the tasks; those of rarer words, however many, are joined to
    the texts' rare words in Spark. Null and empty texts are the end alone.
    Nothing learned (no training rows) gives base_score 0 and uniform
    probabilities. Repeated rows and ids are scored each on their own; other
    columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = docs.where("learn")
    counts = materialise(count_words(training))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    stops = training.count()
    n, v = int(sums[0]) + stops, int(sums[1]) + bool(stops)
    # The head is cut between two counts, so that no more than head_words rows reach the driver;
    # a number of occurrences has one row, so few rows are summed up in order.
    above = F.sum("words").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.groupBy("c").agg(F.count("*").alias("words")).withColumn("above", above).where(F.col("above") <= head_words).agg(F.min("c")).first()[0]
    top = [(r["word"], int(r["c"])) for r in counts.where(F.col("c") >= (n + 1 if cut is None else cut)).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    lexicon = Lexicon.build(top, model_words, buckets)
    inner = top[:model_words]
    # Tokens and distinct words of the shared classes; at most as many rows as classes.
    shared = counts.groupBy(bucket_of(F.col("word"), buckets).alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    class_n, class_v = np.zeros(buckets), np.zeros(buckets)
    for r in shared.collect():
        class_n[r["b"]], class_v[r["b"]] = r["n"], r["v"]
    for w, c in inner:
        raw = np.frombuffer(w.encode(), np.uint8)
        b = int(bucket_numbers(raw, np.array([0]), np.array([len(raw)]), buckets)[0])
        class_n[b] -= c
        class_v[b] -= 1
    mass = np.concatenate(([0.0, stops], [c for _, c in inner], class_n)) + 1.0
    model = train(training, lexicon, mass / mass.sum(), n, rounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared_from = lexicon.size - buckets
    base_floor = float(np.log10(n + v + 1))
    floor = np.concatenate((np.zeros(shared_from), np.log10(class_n + class_v + 1)))

    def run(batches):
        log_head = np.log10(np.append(lexicon.counts, [stops, 0]) + 1.0)  # -2 is the end, -1 a rare word
        known = np.append(lexicon.counts, [stops, 0]) > 0
        for batch in batches:
            lo = 0
            for part in by_size(batch.column(1)):
                t, m = tokens_of(part, lexicon), len(part)
                ids = batch.column(0).slice(lo, m)
                lo += m
                seen = np.bincount(t.doc, minlength=m)
                logs = log_head[t.head]
                add = lambda w, t=t, m=m: np.bincount(t.doc, w, minlength=m)
                own = model.log_probs(t.before, t.model) / _LN10 + np.where(t.model >= shared_from, logs - floor[t.model], 0.0)
                rare = np.flatnonzero(t.head == -1)
                size = t.end[rare] - t.start[rare]
                ends = np.cumsum(size)
                raw = t.data[np.repeat(t.start[rare] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
                strings = pa.LargeStringArray.from_buffers(len(rare), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())
                per = np.concatenate(([0], np.cumsum(np.bincount(t.doc[rare], minlength=m)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(seen.astype(np.int64)),
                        pa.array(add(known[t.head]).astype(np.int64)),
                        pa.array(add(logs) - seen * base_floor),
                        pa.array(add(own)),
                        pa.ListArray.from_arrays(pa.array(per), strings),
                    ],
                    ["doc_id", "n_tokens", "known", "base", "own", "rare"],
                )

    scored = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, known long, base double, own double, rare array<string>"
    )
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = (
        scored.select("row", F.explode("rare").alias("word"))
        .join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count("*").alias("more"))
    )
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return (
        scored.drop("rare")
        .join(tail, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("known") + more).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + logs).alias("base_score"),
            (F.col("own") + logs).alias("score"),
        )
    )


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(7)) == 2


def op5_lm(spark, sf_dir: str) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"), ~held_out())
    return got.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
