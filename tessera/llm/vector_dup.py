"""Near-duplicate vectors by tiled comparison in the order of principal components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, materialise, table

COSINE = 0.93
#: Vectors in a block at about the most; a task compares two blocks at a time.
BLOCK = 2048
#: Vectors the rotation is fitted on. Any rotation gives the same links, a good one gives them sooner.
SAMPLE = 10_000
#: Leading dimensions after which the bound on the rest is looked at.
STEPS = (8, 24)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    # Scaling by the largest component first keeps the squares in range.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(raw: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors about the origin, the strongest first."""
    x = _unit(raw)
    values, axes = np.linalg.eigh(x.T @ x)
    return axes[:, np.argsort(-values, kind="stable")]


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of rows with this cosine or more; i < j when a and b are the same block.

    Products are summed over leading dimensions first. What the others can add is
    at most the product of the two suffix norms; a pair whose sum and bound stay
    below the cosine is dropped there. Pairs left at the end are measured again
    on the vectors as given.
    """
    ua, ub = _unit(a), _unit(b)
    ra, rb = ua @ axes, ub @ axes
    slack = cosine - 1e-9
    n = ra.shape[1]
    cuts = [c for c in STEPS if c < n]
    tail = lambda x, c: np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0))
    first = cuts[0] if cuts else n
    total = ra[:, :first] @ rb[:, :first].T
    alive = total + np.outer(tail(ra, first), tail(rb, first)) >= slack
    if same:
        alive &= np.tri(len(a), dtype=bool, k=-1).T
    i, j = np.nonzero(alive)
    summed = total[i, j]
    for lo, hi in zip([first, *cuts[1:]], [*cuts[1:], n]):
        keep_i, keep_j, keep_s = [], [], []
        ta, tb = tail(ra, hi), tail(rb, hi)
        for at in range(0, len(i), 200_000):
            p, q = i[at : at + 200_000], j[at : at + 200_000]
            s = summed[at : at + 200_000] + np.einsum("ij,ij->i", ra[p, lo:hi], rb[q, lo:hi])
            ok = s + ta[p] * tb[q] >= slack
            keep_i.append(p[ok])
            keep_j.append(q[ok])
            keep_s.append(s[ok])
        i, j, summed = (np.concatenate(x) if x else np.zeros(0, int) for x in (keep_i, keep_j, keep_s))
        i, j = i.astype(np.int64), j.astype(np.int64)
    exact = np.concatenate(
        [np.einsum("ij,ij->i", ua[i[k : k + 200_000]], ub[j[k : k + 200_000]]) for k in range(0, len(i), 200_000)] or [np.zeros(0)]
    )
    return i[exact >= cosine], j[exact >= cosine]


def _roots(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes the position of the node of least rank that edges reach."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label = place.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[order[new]]
        if (new == label).all():
            return order[label]
        label = new


def link_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows are compared when their labels are equal, not null, and their vectors
    have as many components. A vector that is null, empty, zero or holds null or
    non-finite components links with nothing, and so does a row with a null
    vec_id (its component_id and kept are null). Equal vectors under one label
    are gathered first and compared once; each counts as a link of the others.

    A label's vectors are laid into cells of a grid over the first two principal
    components. Unit vectors of this cosine are at most w = sqrt(2 - 2 cosine)
    apart in each of them, so with cells of width w only neighbouring cells are
    compared. A cell is cut by hash into blocks of about block rows, and every
    pair of blocks is a row of its own, so a label of a third of all rows
    becomes many tasks. A task passes on only each vector's number of links and
    a spanning star of its links. Other columns are ignored.
    """
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    dtype, item = ("<f8", pa.float64()) if double else ("<f4", pa.float32())
    id_kind, label_kind = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding")

    def read(batches):
        for batch in batches:
            raw, digest, dims = [], [], []
            for v in batch.column(2).to_pylist():
                x = np.array([], dtype) if v is None or any(c is None for c in v) else np.asarray(v, dtype)
                good = x.size > 0 and np.isfinite(x).all() and bool((x != 0).any())
                raw.append((x + 0).tobytes() if good else None)  # + 0 makes -0 equal to 0
                digest.append(hashlib.sha256(raw[-1]).digest() if good else None)
                dims.append(int(x.size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "dims", "digest", "raw"],
            )

    sound = rows.mapInArrow(read, f"vec_id {id_kind}, label {label_kind}, dims int, digest binary, raw binary")
    sound = sound.where("vec_id is not null and label is not null and raw is not null")
    standing = materialise(
        sound.groupBy("label", "dims", "digest")
        .agg(F.min(F.struct("vec_id", "raw")).alias("m"), F.count("*").alias("copies"))
        .select("label", "dims", "digest", F.col("m.vec_id").alias("vec_id"), F.col("m.raw").alias("raw"), "copies")
    )
    drawn = standing.select("dims", "raw", F.xxhash64("vec_id").alias("h")).orderBy("h", "raw").limit(sample).collect()
    axes: dict[int, np.ndarray] = {}
    for d in sorted({r["dims"] for r in drawn}):
        axes[d] = rotation(np.stack([np.frombuffer(r["raw"], dtype) for r in drawn if r["dims"] == d]))
    width = math.sqrt(max(2 - 2 * cosine, 0.0)) + 1e-9

    def axis(d: int) -> np.ndarray:
        return axes[d] if d in axes else np.eye(d)

    def locate(batches):
        for batch in batches:
            cell = np.zeros((batch.num_rows, 2), np.int32)
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            raw = batch.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                lead = _unit(np.stack([np.frombuffer(raw[k], dtype) for k in at])) @ axis(d)[:, :2]
                cell[at, : lead.shape[1]] = np.floor(lead / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell[:, 0]), pa.array(cell[:, 1])], ["label", "dims", "raw", "vec_id", "copies", "c1", "c2"]
            )

    placed = standing.select("label", "dims", "raw", "vec_id", "copies").mapInArrow(
        locate, f"label {label_kind}, dims int, raw binary, vec_id {id_kind}, copies long, c1 int, c2 int"
    )
    cell = ["label", "dims", "c1", "c2"]
    stats = materialise(placed.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    dealt = placed.join(stats, cell).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def fold(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        return pa.table(
            {
                **{c: t.column(c).slice(0, 1) for c in [*cell, "block"]},
                "ids": pa.array([t.column("vec_id").to_pylist()], pa.list_(t.schema.field("vec_id").type)),
                "copies": pa.array([t.column("copies").to_pylist()], pa.list_(pa.int64())),
                "matrix": pa.array([b"".join(t.column("raw").to_pylist())], pa.binary()),
            }
        )

    key = [*cell, "block"]
    blocks = materialise(
        dealt.drop("blocks")
        .groupBy(*key)
        .applyInArrow(fold, f"label {label_kind}, dims int, c1 int, c2 int, block int, ids array<{id_kind}>, copies array<long>, matrix binary")
    )
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = (
        stats.withColumn("o", F.explode(steps))
        .select("label", "dims", F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("blocks").alias("n"), (F.col("c1") + F.col("o.x")).alias("c1"), (F.col("c2") + F.col("o.y")).alias("c2"))
        .join(stats, cell)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("p1 <> c1 or p2 <> c2 or i <= j")
        .select("label", "dims", "p1", "p2", "i", "c1", "c2", "j")
    )
    left = blocks.select("label", "dims", F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("block").alias("i"), F.col("ids").alias("ids_a"), F.col("copies").alias("copies_a"), F.col("matrix").alias("a"))
    right = blocks.select("label", "dims", "c1", "c2", F.col("block").alias("j"), F.col("ids").alias("ids_b"), F.col("copies").alias("copies_b"), F.col("matrix").alias("b"))
    tasks = (
        near.join(left, ["label", "dims", "p1", "p2", "i"])
        .join(right, ["label", "dims", "c1", "c2", "j"])
        .select("dims", F.expr("p1 = c1 and p2 = c2 and i = j").alias("same"), "ids_a", "copies_a", "a", "ids_b", "copies_b", "b")
    )

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                dims, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ids_a, ids_b = batch.column(2)[k].values, batch.column(5)[k].values
                mass_a, mass_b = batch.column(3)[k].values.to_numpy(), batch.column(6)[k].values.to_numpy()
                a = np.frombuffer(batch.column(4)[k].as_py(), dtype).reshape(-1, dims)
                b = np.frombuffer(batch.column(7)[k].as_py(), dtype).reshape(-1, dims)
                i, j = close_pairs(a, b, axis(dims), cosine, same)
                if not len(i):
                    continue
                ids = ids_a if same else pa.concat_arrays([ids_a, ids_b])
                j = j if same else j + len(a)
                mass = mass_a if same else np.concatenate((mass_a, mass_b))
                links = np.bincount(i, mass[j], len(ids)) + np.bincount(j, mass[i], len(ids))
                root = _roots(len(ids), i, j, np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(some)), ids.take(pa.array(root[some])), pa.array(links[some].astype(np.int64))], ["b", "a", "links"]
                )

    found = materialise(tasks.mapInArrow(compare, f"b {id_kind}, a {id_kind}, links long"))
    degree = found.groupBy(F.col("b").alias("standing")).agg(F.sum("links").alias("links"))
    classes = components(found.where("a <> b").select("a", "b").distinct()).withColumnRenamed("id", "standing")
    groups = (
        standing.select("label", "dims", "digest", F.col("vec_id").alias("standing"), "copies")
        .join(degree, "standing", "left")
        .join(classes, "standing", "left")
        .select("label", "dims", "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "standing").alias("component_id"))
    )
    every = rows.mapInArrow(read, f"vec_id {id_kind}, label {label_kind}, dims int, digest binary, raw binary").drop("raw")
    every = every.withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest")))
    got = every.join(groups, ["label", "dims", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_vector_dup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
