"""Hard-negative mining by Kronecker-packed integer products.

Candidates' components are biased to be non-negative and laid into separate fields
of one wide integer, a component of all candidates of a block at a time. One
multiplication by an anchor's component then multiplies all of them, the sum
over components holds all inner products side by side, and taking the biases off
leaves exact integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

#: Rows of a block at about the most: anchors, and candidates packed into one wide integer a component.
ANCHORS, CANDIDATES = 512, 4096
_MOST = 2**63 - 1


class Packed:
    """A block of integer vectors (rows), as one wide integer a component."""

    def __init__(self, rows: np.ndarray, widest: int):
        """rows hold integers as doubles; widest is the largest magnitude of an anchor's component."""
        self.count, self.dims = rows.shape
        self.lift = -int(min(rows.min(initial=0), 0))
        self.anchor_lift = widest
        top = int(max(rows.max(initial=0), 0)) + self.lift
        #: Bytes of a field: the sum over components of products of lifted values fits.
        need = max(1, self.dims * 2 * widest * top).bit_length() // 8 + 1
        self.field = next((n for n in (2, 4, 8) if need <= n), need)
        if self.field <= 8:
            lifted = (rows.astype(np.int64) + self.lift).T.astype(f"<u{self.field}")
            self.wide = [int.from_bytes(x.tobytes(), "little") for x in lifted]
            self.sums = rows.astype(np.int64).sum(axis=1)
        else:
            whole = [[int(x) for x in row] for row in rows.tolist()]
            self.wide = [int.from_bytes(b"".join((r[d] + self.lift).to_bytes(self.field, "little") for r in whole), "little") for d in range(self.dims)]
            self.sums = [sum(r) for r in whole]

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of the block's rows with an anchor; those beyond 64 bits count as the nearest 64-bit value."""
        lifted = [int(x) + self.anchor_lift for x in anchor.tolist()]
        total = sum(x * wide for x, wide in zip(lifted, self.wide))
        raw = total.to_bytes(self.count * self.field, "little")
        off = self.lift * sum(lifted)
        if self.field <= 8:
            return np.frombuffer(raw, f"<u{self.field}").astype(np.int64) - off - self.anchor_lift * self.sums
        fields = (int.from_bytes(raw[k * self.field : (k + 1) * self.field], "little") for k in range(self.count))
        return np.array([min(max(x - off - self.anchor_lift * s, -_MOST), _MOST) for x, s in zip(fields, self.sums)], np.int64)


def _matrix(raw: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(len(raw), dims)


def _best(scores: np.ndarray, ids: np.ndarray, some: np.ndarray, most: int) -> np.ndarray:
    """Of the positions in some, the most with the highest scores, ties by the least id."""
    if len(some) > 4 * most:
        cut = np.partition(scores[some], len(some) - most)[len(some) - most]
        some = some[scores[some] >= cut]
    return some[np.lexsort((ids[some], -scores[some]))][:most]


def _blocks(rows: DataFrame, key: list[str], size: int, name: str, columns: list[str]) -> DataFrame:
    """Rows of each key cut by hash of vec_id into blocks of about size rows: key, block, all blocks of the key, and the rows as an array."""
    tally = rows.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(tally, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    return dealt.groupBy(*key, "blocks", "block").agg(F.collect_list(F.struct(*columns)).alias(name))


def _meet(anchors: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Every block of anchors beside every block of rows of the same key, a row for each two."""
    right = materialise(_blocks(rows, key, CANDIDATES, "rows", ["vec_id", "label", "raw"]))
    left = _blocks(anchors, key, ANCHORS, "anchors", columns).select(*key, "anchors")
    counts = right.groupBy(*key).agg(F.max("blocks").alias("blocks"))
    left = left.join(counts, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left.join(right.drop("blocks"), [*key, "block"]).select("dims", "anchors", "rows")


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Of every two blocks: the anchors, their matrix, the rows' ids and labels, and the packed rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            dims = batch.column("dims")[k].as_py()
            anchors, rows = batch.column("anchors")[k].values, batch.column("rows")[k].values
            lead = _matrix(anchors.field("raw"), dims)
            packed = Packed(_matrix(rows.field("raw"), dims), int(np.abs(lead).max(initial=0)))
            yield anchors, lead, rows.field("vec_id").to_numpy(), rows.field("label").to_numpy(), packed


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, dims and raw: each component x becomes floor(scale * x), x as double, as 8 bytes.

    Rows with a null vec_id, label or vector take no part, nor do those with a null or
    non-finite component, or one that is no longer finite when scaled. Of rows that
    repeat a vec_id the one of the least label, then vector, stands for all.
    """
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            ends = v.offsets.to_numpy().astype(np.int64)
            flat = np.floor(v.values.to_numpy(zero_copy_only=False)).astype("<f8") + 0.0  # -0 becomes 0
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(np.diff(ends).astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "raw"]
            )

    packed = rows.mapInArrow(pack, "vec_id long, label long, dims int, raw binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "dims", "raw")).alias("m")).select("vec_id", "m.*")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and positive the hardest rows of other labels within bounds of the positive's score.

    rows are those of integer_vectors. A row's score is its exact inner product with
    the anchor; higher scores come first, ties by the smaller vec_id. An anchor's
    positives are its first rows of the same label, itself excluded (all, if fewer than
    positives). A negative n of a positive p satisfies low * p <= 100 * n <= high * p.
    Vectors of different lengths are never compared; empty ones score 0 with one another.
    Scores beyond 64 bits count as the nearest 64-bit value. An empty table gives no rows.

    Anchors are the stated query set; they meet all rows in pairs of blocks: first blocks of
    one label, then, for the negatives, blocks over all labels. A task passes on an
    anchor's few best rows of a block. A label of a third of all rows is many blocks.
    """
    rows = materialise(rows)
    anchors = rows.where(is_anchor)

    def find_positives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, lead, ids, _, packed in _pairs(batches):
            out: list[tuple] = []
            for name, vector in zip(own.field("vec_id").to_pylist(), lead):
                scores = packed.scores(vector)
                best = _best(scores, ids, np.flatnonzero(ids != name), positives)
                out += [(name, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["anchor_id", "positive_id", "positive_score"])

    near = _meet(anchors, rows, ["dims", "label"], ["vec_id", "raw"]).mapInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    near = near.withColumn("place", F.expr("row_number() over (partition by anchor_id order by positive_score desc, positive_id)")).where(F.col("place") <= positives)
    chosen = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("chosen"))
    asked = materialise(anchors.join(chosen, "vec_id"))

    def find_negatives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        for own, lead, ids, labels, packed in _pairs(batches):
            out: list[tuple] = []
            for name, label, wanted, vector in zip(own.field("vec_id").to_pylist(), own.field("label").to_pylist(), own.field("chosen").to_pylist(), lead):
                bounds = [(w["positive_id"], p := w["positive_score"], -((-low * p) // 100), (high * p) // 100) for w in wanted]
                scores = packed.scores(vector)
                least, most = min(b[2] for b in bounds), max(b[3] for b in bounds)
                some = np.flatnonzero((labels != label) & (scores >= least) & (scores <= most))
                if not len(some):
                    continue
                own_scores = scores[some]
                for positive, score, lo, hi in bounds:
                    best = _best(scores, ids, some[(own_scores >= lo) & (own_scores <= hi)], negatives)
                    out += [(name, positive, score, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], names)

    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _meet(asked, rows, ["dims"], ["vec_id", "label", "raw", "chosen"]).mapInArrow(find_negatives, kinds)
    rank = F.expr("row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)")
    return far.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, where every seventh has the label after its own."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
