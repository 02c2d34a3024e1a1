"""Language identification with error-correcting output codes."""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_crc, map_text, table, utf8_parts

#: Buckets for each length of n-gram (2 and 3 bytes).
BUCKETS = 4096
#: Rows whose features are dense at a time (32 KB each, 64 in double precision).
BLOCK = 500
UNKNOWN = "und"


def features(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of whole lower-cased texts."""
    offsets, data = utf8_parts(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, 2 * buckets), np.float32)
    code = data.astype(np.uint32)
    for k, size in enumerate((2, 3)):
        if len(data) < size:
            continue
        gram = code[: len(code) - size + 1].copy()
        for j in range(1, size):
            gram = gram * np.uint32(257) + code[j : len(code) - size + 1 + j]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(buckets)))
        inside = doc[: len(gram)] == doc[size - 1 :]
        at = doc[: len(gram)][inside] * buckets + gram[inside].astype(np.int64)
        out[:, k * buckets : (k + 1) * buckets] = np.bincount(at, minlength=n * buckets).reshape(n, buckets)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, one a class, far apart from each other.

    Up to 7 classes get every split of the classes in two; more get the best of
    several random codes of 10 bits for each doubling.
    """
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 7:
        columns = [(1, *c) for c in product((1, -1), repeat=classes - 1) if -1 in c]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = (code.shape[1] - (code @ code.T)[np.triu_indices(classes, 1)].max()) / 2
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.ones((0, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((2 * BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    least_gap: float = 0.0  # between the two nearest codewords; below it a text is ambiguous
    most_loss: float = float("inf")  # of the nearest codeword; above it a text is in none of the languages

    def losses(self, x: np.ndarray) -> np.ndarray:
        # In double precision and rounded, so that equal texts agree whatever rows lie beside them.
        weight = self.weight.astype(np.float64)
        blocks = [x[lo : lo + BLOCK].astype(np.float64) @ weight for lo in range(0, max(len(x), 1), BLOCK)]
        margin = np.round(np.concatenate(blocks), 4) + self.bias
        return np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(axis=1) for row in self.code], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword of every row by weighted loss, its share of belief, its loss a bit, and the second's more."""
        loss = self.losses(x)
        share = np.exp((loss.min(axis=1, keepdims=True) - loss) * self.scale)
        share /= share.sum(axis=1, keepdims=True)
        two = np.sort(loss, axis=1)[:, :2] / max(self.trust.sum(), 1e-9)
        gap = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(x), np.inf)
        return loss.argmin(axis=1), share.max(axis=1), two[:, 0], gap


def _packed():
    """Features of every text as compressed bytes; most of them are zeros."""
    return lambda column: {"x": pa.array([zlib.compress(r.astype("<f4").tobytes(), 1) for r in features(column)], pa.binary())}


def _dealt(classes: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and class numbers of four fifths of the packed rows, then those of every fifth.

    Classes follow each other, and rows of a class are ordered by their bytes, not
    as they arrived. Rows are unpacked class by class, straight into place.
    """
    label = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
    n = len(label)
    most, fifth = (np.empty((k, 2 * BUCKETS), np.float32) for k in (n - n // 5, n // 5))
    at = 0
    while classes:
        for row in sorted(map(zlib.decompress, classes.pop(0))):
            k, aside = at // 5, at % 5 == 4
            (fifth if aside else most)[k if aside else at - k] = np.frombuffer(row, "<f4")
            at += 1
    aside = np.arange(n) % 5 == 4
    return most, label[~aside], fifth, label[aside]


def fit(docs: DataFrame, train: Column, per_language: int = 500, most_texts: int = 8000, rounds: int = 150) -> LanguageModel:
    """Learn from about per_language texts of each value of lang, fewer where that makes more than most_texts.

    The texts are those of least hash of doc_id and text, an even draw that is
    the same at every run; repeated texts count once. One logistic classifier a
    bit of the codewords is trained on the driver over four fifths of them,
    about most_texts rows of features (32 KB each) at the most, which travel
    compressed (2 to 6 KB) and are laid into one matrix there. A bit's trust
    is how far its accuracy exceeds chance. On the last fifth the scale of belief is
    fitted, and the bounds outside which a text is ambiguous or in none of the
    languages: half the gap that 99 of 100 texts exceed, and half more than the
    greatest loss, log 2 (no evidence at all) at the least.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel()
    langs = sorted(r["lang"] for r in counts)
    most = min(per_language, max(2, most_texts // len(langs)))
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, most / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.where(draw < F.element_at(limit, F.col("lang"))).select("lang", "text").distinct()

    packed: dict[str, list[bytes]] = defaultdict(list)
    for r in map_text(sample, _packed, [T.StructField("x", T.BinaryType())], ("lang",), rows=BLOCK).collect():
        packed[r["lang"]].append(r["x"])
    if not packed:
        return LanguageModel()
    langs = sorted(packed)
    x, label, kept_x, kept_label = _dealt([packed.pop(v) for v in langs])
    code = codewords(len(langs))
    y = code[label]
    weight = np.zeros((x.shape[1], code.shape[1]), np.float32)
    bias = np.zeros(code.shape[1])
    balance = (len(label) / len(langs) / np.maximum(np.bincount(label, minlength=len(langs)), 1))[label][:, None]
    slow_w, slow_b, step = np.zeros_like(weight), np.zeros_like(bias), 8.0
    for _ in range(rounds):  # gradient descent with momentum
        pull = -y * balance / (1 + np.exp(np.clip(y * (x @ weight + bias), -30, 30))) / len(label)
        slow_w = 0.9 * slow_w - step * (x.T @ pull.astype(np.float32) + 1e-5 * weight)
        slow_b = 0.9 * slow_b - step * 0.1 * pull.sum(axis=0)
        weight, bias = (weight + slow_w).astype(np.float32), bias + slow_b
    right = ((x @ weight + bias) * y > 0).mean(axis=0) if len(bias) else np.zeros(0)
    model = LanguageModel(langs, code, weight, bias, np.maximum(2 * right - 1, 0.05))
    return _calibrated(model, kept_x, kept_label) if len(kept_x) and len(langs) > 1 else model


def _calibrated(model: LanguageModel, x: np.ndarray, label: np.ndarray) -> LanguageModel:
    loss = model.losses(x)

    def surprise(scale: float) -> float:
        share = -(loss - loss.min(axis=1, keepdims=True)) * scale
        return float((np.log(np.exp(share).sum(axis=1)) - share[np.arange(len(label)), label]).mean())

    # The most cautious scale that explains the labels about as well as the best one.
    scales = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0)
    model.scale = next(s for s in scales if surprise(s) <= min(map(surprise, scales)) + 0.005)
    best, _, nearest, gap = model.predict(x)
    right = best == label
    if right.any():
        model.least_gap = 0.5 * float(np.quantile(gap[right], 0.01))
        model.most_loss = max(float(np.log(2)), 1.5 * float(nearest[right].max()))
    return model


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
]


def _start(model: LanguageModel):
    def start():
        def work(column: pa.Array) -> dict[str, pa.Array]:
            empty = pc.fill_null(pc.invert(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}")), True)
            empty = empty.to_numpy(zero_copy_only=False)
            pred, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            unsure, foreign = np.zeros(len(column), bool), np.zeros(len(column), bool)
            if model.langs:
                names = np.array(model.langs, object)
                for lo in range(0, len(column), BLOCK):
                    best, sure, nearest, gap = model.predict(features(column.slice(lo, BLOCK)))
                    pred[lo : lo + BLOCK], score[lo : lo + BLOCK] = names[best], sure
                    unsure[lo : lo + BLOCK], foreign[lo : lo + BLOCK] = gap < model.least_gap, nearest > model.most_loss
            pred[empty], score[empty] = UNKNOWN, 0.0
            return {
                "lang_pred": pa.array(pred, pa.string()),
                "score": pa.array(score, pa.float64()),
                "ambiguous": pa.array(unsure | foreign | empty, pa.bool_()),
                "kept": pa.array(~(foreign | empty), pa.bool_()),
            }

        return work

    return start


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score (0 to 1) and ambiguous for every whole text.

    A text is ambiguous where the second codeword is nearly as near as the first
    or none is near. Null texts, empty texts and texts without a letter are 'und' with score 0,
    as is everything under a model that saw no language. A tie goes to the
    language first in the alphabet. Only the text is looked at; equal texts get
    equal answers. Columns outside keep are dropped and kept ones with the names
    of results are replaced. Nothing is shuffled.
    """
    return map_text(docs, _start(model), FIELDS, keep)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of docs, all columns, whose text has letters and is not far from every codeword.

    Where no language was learnt, all texts with letters stay.
    """
    return map_text(docs, _start(model), FIELDS, docs.columns, where=lambda new: new["kept"])


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(4)) == 2


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
