"""A Merkle manifest of a dataset whose nodes keep SHA-256 midstates.

A child's digest as hex text is 64 bytes, one block of SHA-256. So the state of a
parent before each of its slots is eight words; paths carry a copy of the state
before the node's own slot, and folding resumes it with the replaced digest and
the siblings to the right, without hashing those to the left again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_crc, materialise, table

#: Children of a node, and the levels that are built inside one block of nodes.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
STEP = "array<struct<state: binary, left: binary, right: binary>>"


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid - 1)
    return lo


#: The standard's constants: 32 bits of the fractions of square roots and of cube roots of primes.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each."""
    w = [block[:, i] for i in range(16)]
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            low = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            high = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w.append(w[i - 16] + low + w[i - 7] + high)
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return np.stack([a, b, c, d, e, f, g, h], axis=1) + state


def as_hex(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as hex text: blocks (n, 16)."""
    raw = digest.astype(">u4").view(np.uint8).reshape(len(digest), 32)
    half = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(digest), 64)
    text = np.where(half < 10, half + 48, half + 87).astype(np.uint8)
    return text.view(">u4").astype(np.uint32).reshape(len(digest), 16)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of nodes whose states have taken all their children."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 1 << 31
    last[:, 15] = children * 512
    return compress(state, last)


def _words(column: pa.Array) -> np.ndarray:
    """(n, 8) words of a column of 32-byte values."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, 8)


def _bytes(words: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of the given lengths, laid end to end in words."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    data = np.ascontiguousarray(words).astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def rise(start: np.ndarray, levels: np.ndarray, digest: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Paths of nodes to the tops of their blocks, and those tops, block by block.

    start has true at each block's first node; levels is how many levels stand
    above each node within its block.
    """
    block = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    place = np.arange(len(start)) - first[block]
    at = np.arange(len(start))  # of each node, its ancestor among the nodes of the level
    height = levels[first]
    most = int(levels.max(initial=0))
    states = np.zeros((len(start), most, 8), np.uint32)
    beside = np.zeros((len(start), most, 4, 8), np.uint32)  # two to the left, two to the right
    there = np.zeros((len(start), most, 4), bool)
    for level in range(most):
        n = len(digest)
        parent = block * BLOCK + place // FAN
        goes = height[block] > level
        head = np.concatenate(([True], (parent[1:] != parent[:-1]) | ~goes[1:] | ~goes[:-1]))
        heads = np.flatnonzero(head)
        count = np.diff(np.append(heads, n))
        up = np.cumsum(head) - 1
        text = as_hex(digest)
        state = np.broadcast_to(START, (len(heads), 8)).astype(np.uint32)
        before = np.zeros((len(heads), FAN, 8), np.uint32)
        for slot in range(FAN):
            before[:, slot] = state
            some = np.flatnonzero(count > slot)
            if len(some):
                state = state.copy()
                state[some] = compress(state[some], text[heads[some] + slot])
        top = finish(state, count)
        still = ~goes[heads]
        top[still] = digest[heads[still]]
        # What the level adds to each path.
        slot, of = at - heads[up[at]], up[at]
        states[:, level] = before[of, slot]
        for k in range(FAN - 1):  # siblings by slot: those before the own slot, then those behind it
            left = slot > k
            beside[left, level, k] = digest[heads[of[left]] + k]
            there[left, level, k] = True
            right = slot + 1 + k < count[of]
            beside[right, level, 2 + k] = digest[at[right] + 1 + k]
            there[right, level, 2 + k] = True
        at, digest, block, place = of, top, block[heads], np.where(goes[heads], place[heads] // FAN, place[heads])
    kept = np.arange(most)[None, :] < levels[:, None]
    side, has = beside[kept], there[kept]
    struct = pa.StructArray.from_arrays(
        [
            _bytes(states[kept], np.full(int(kept.sum()), 32)),
            _bytes(side[:, :2][has[:, :2]], 32 * has[:, :2].sum(axis=1)),
            _bytes(side[:, 2:][has[:, 2:]], 32 * has[:, 2:].sum(axis=1)),
        ],
        ["state", "left", "right"],
    )
    ends = np.concatenate(([0], np.cumsum(levels))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), struct), digest


def _climb(nodes: DataFrame) -> DataFrame:
    """nodes (grp, pos, n, digest, ...) with their path to, and the digest of, the top of their block."""
    names = nodes.columns
    source = nodes.repartition("grp", F.expr(f"pos div {BLOCK}")).sortWithinPartitions("grp", "pos")

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        grp = np.array(batch.column("grp").to_pylist(), object)
        block = batch.column("pos").to_numpy() // BLOCK
        n = batch.column("n").to_numpy()
        start = np.concatenate(([True], (grp[1:] != grp[:-1]) | (block[1:] != block[:-1])))
        levels = np.zeros(len(n), np.int64)
        for level in range(LEVELS):
            levels += n > FAN**level
        path, tops = rise(start, levels, _words(batch.column("digest")))
        top = _bytes(tops[np.cumsum(start) - 1], np.full(len(n), 32))
        return pa.RecordBatch.from_arrays([*batch.columns, path, top], [*names, "path", "top"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, block = batch.column("grp"), batch.column("pos").to_numpy() // BLOCK
            # Rows of the batch's last block wait for the next batch: all before that block is whole.
            edge = batch.num_rows - 1
            while edge > 0 and block[edge - 1] == block[-1] and grp[edge - 1] == grp[batch.num_rows - 1]:
                edge -= 1
            if edge:
                yield solve(pa.concat_batches([*held, batch.slice(0, edge)]))
                held = []
            elif held and (held[-1].column("grp")[-1] != grp[0] or held[-1].column("pos")[-1].as_py() // BLOCK != block[0]):
                yield solve(pa.concat_batches(held))
                held = []
            held.append(batch.slice(edge))
        if held:
            yield solve(pa.concat_batches(held))

    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, path {STEP}, top binary")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with pos, from 0 in each grp by order, and n, the rows of the grp.

    Rows are range-partitioned by (grp, order), counted in each partition, and
    each partition starts where the ones before it end; no group is in one task.
    """
    names = [*rows.columns, "part", "nth"]
    ranged = rows.withColumn("salt", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange("grp", *order, "salt").sortWithinPartitions("grp", *order, "salt").drop("salt")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = np.array(batch.column("grp").to_pylist(), object)
            new = np.concatenate(([grp[0] != last], grp[1:] != grp[:-1]))
            at = np.arange(len(grp))
            since = np.maximum.accumulate(np.where(new, at, -1))
            nth = np.where(since < 0, seen + at, at - since)
            last, seen = grp[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(nth.astype(np.int64))], names)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    placed = materialise(ranged.mapInArrow(run, f"{kinds}, part int, nth long"))
    tally = placed.groupBy("grp", "part").agg(F.count("*").alias("c"))
    starts = tally.selectExpr(
        "grp", "part", "sum(c) over (partition by grp order by part) - c as before", "sum(c) over (partition by grp) as n"
    )
    return placed.join(starts, ["grp", "part"]).withColumn("pos", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Written blocks of nodes, then of those blocks' tops and so on, up to one node a group."""
    levels = [materialise(_climb(nodes))]
    while not levels[-1].where("n > 1").isEmpty():
        tops = levels[-1].where(f"pos % {BLOCK} = 0")
        tops = tops.selectExpr("grp", f"pos div {BLOCK} as pos", f"cast(ceil(n / {BLOCK}) as long) as n", "top as digest")
        levels.append(materialise(_climb(tops)))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest level with whole paths; tops (grp, path, ...) continues those of the highest. No key has more than a block's rows."""
    whole = levels[-1].drop("path", "top").join(tops, "grp")
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    for level in levels[-2::-1]:
        above = whole.select("grp", F.col("pos").alias("blk"), F.col("path").alias("further"), *carried)
        own = level.withColumn("blk", F.expr(f"pos div {BLOCK}")).drop("top")
        whole = own.join(above, ["grp", "blk"]).withColumn("path", F.concat("path", "further")).drop("blk", "further")
    return whole


def build(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """leaves (grp, digest, ...) with subroot, root and the path of states and siblings from each leaf to the root.

    Per group, leaves follow order, ties the digest; while multiple nodes remain,
    every three consecutive ones become one. The groups' last nodes, in
    bytewise order of grp, become the root in the same way. A step of a path is
    the parent's state before the node's slot and the siblings left and right.
    """
    low = _levels(numbered(leaves, [*order, "digest"]))
    subroots = low[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest"))
    high = _levels(numbered(subroots, ["name"]))
    peak = high[-1].select("grp", F.array().cast(STEP).alias("path"), F.col("top").alias("root"))
    tops = _descend(high, peak).select(F.col("name").alias("grp"), "path", "root", F.col("digest").alias("subroot"))
    return _descend(low, tops)


def fold(rows: DataFrame, leaf: str, into: str) -> DataFrame:
    """rows with the root that follows when the digest in column leaf stands at the end of path."""
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            steps = path.values
            ends = path.offsets.to_numpy().astype(np.int64)
            state = _words(steps.field("state"))
            parts = []
            for side in ("left", "right"):
                column = steps.field(side)
                length = np.array([len(x) for x in column.to_pylist()], np.int64) // 32
                parts += [length, np.concatenate(([0], np.cumsum(length))), _words(column)]
            n_left, _, _, n_right, where, right = parts
            now = _words(batch.column(leaf))
            size = np.diff(ends)
            for level in range(int(size.max(initial=0))):
                row = np.flatnonzero(size > level)
                step = ends[row] + level
                to = compress(state[step], as_hex(now[row]))
                for k in range(FAN - 1):
                    some = np.flatnonzero(n_right[step] > k)
                    if len(some):
                        to[some] = compress(to[some], as_hex(right[where[step[some]] + k]))
                now[row] = finish(to, n_left[step] + n_right[step] + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(now, np.full(len(now), 32))], [*names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{into}` binary")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, and folded with verified.

    folded is the root recomputed from the leaf as it stands after a change:
    where changed holds, text replaces the document's text. Digests are 32 bytes.

    A null field counts as `-`. Groups are sources, a null source first. Documents
    ascend by doc_id, null first; rows that repeat a doc_id follow the bytes of
    their leaves, so equal rows are interchangeable leaves. A null doc_id counts as
    empty text where its crc32 is asked for. Texts are hashed whole by Spark,
    however long; an empty text is a value of no bytes. An empty table gives no rows.
    Columns other than doc_id, source, lang, n_chars and text are ignored.
    """
    fields = lambda t: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t]
    own = leaf_digest(fields(F.col("text")))
    other = F.when(changed, leaf_digest(fields(text))) if changed is not None else F.lit(None).cast("binary")
    grp = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    leaves = docs.select(grp.alias("grp"), "doc_id", own.alias("digest"), other.alias("other"))
    tree = build(leaves, ["doc_id"]).withColumn("now", F.coalesce("other", "digest"))
    tree = fold(tree.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "now"), "now", "folded")
    return tree.drop("now").withColumn("verified", F.col("folded") == F.col("root"))


def proof(path: Column) -> Column:
    """The siblings along a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaves, proofs and the root that each leaf folds to after every second document lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    tree = manifest(docs, id_crc() % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return tree.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), "verified"
    )
