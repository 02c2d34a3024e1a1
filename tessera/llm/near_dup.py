"""Near-duplicate documents by ProbMinHash sketches, banding and verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import components, map_text, materialise, mix64, quoted, runs, SpanHasher, table, utf8_parts

WORDS = 5
SIMILARITY = 0.8
#: Two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: all but 1 in 20,000 at 0.8.
BANDS, ROWS = 25, 5
#: Rows of a block when outsiders of a bucket are compared with its members.
BLOCK = 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of whole texts: (text number, hash, times), in no set order.

    Words are runs of letters and digits in lower case. A text of fewer words is
    one shingle of all it has; one without words has none.
    """
    offsets, data = utf8_parts(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    inside = _IN_WORD[data]
    starts, ends = runs(inside)
    # A word that runs across the border of two texts is two words.
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    doc = np.searchsorted(offsets, starts, "right") - 1
    word = SpanHasher(data)(starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < words))
    n = max(0, len(word) - words + 1)
    key = np.zeros(n, np.uint64)
    for j in range(words):
        key = mix64(key * _GOLDEN + word[j : j + n])
    whole = doc[:n] == doc[words - 1 :] if n else np.zeros(0, bool)
    docs, keys = [doc[:n][whole]], [key[whole]]
    for d in short.tolist():
        h = np.zeros(1, np.uint64)
        for w in word[first[d] : first[d] + count[d]]:
            h = mix64(h * _GOLDEN + w)
        docs.append(np.array([d]))
        keys.append(h)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    if not len(doc):
        return doc.astype(np.int64), key, np.zeros(0, np.int64)
    both = mix64(key ^ mix64(doc.astype(np.uint64) * _GOLDEN))
    _, at, times = np.unique(both, return_index=True, return_counts=True)
    return doc[at], key[at], times


def prob_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash sketches, one row of registers a text.

    Every element of a text sends out a Poisson process of arrivals at a rate of
    its weight; each arrival falls on a random register, and a register keeps
    the element that came first. Arrivals depend on the element alone, so texts
    share a register's element with the probability that is their probability
    Jaccard similarity. All elements take their next arrival together; one stops
    when it comes later than the latest first arrival of its text.
    """
    time = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, np.uint64)
    base = doc.astype(np.int64) * registers
    doc, rate, now = doc.astype(np.int64), weight.astype(float), np.zeros(len(doc))
    seed, step = mix64(key ^ np.uint64(0xA24BAED4963EE407)), 0
    while len(doc):
        step += 1
        bits = mix64(seed + np.uint64(step * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = base + (mix64(bits ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, at, now)
        won = time[at] == now
        owner[at[won]] = key[won]
        last = time.reshape(docs, registers).max(axis=1)
        go = now < last[doc]
        doc, base, key, seed, rate, now = doc[go], base[go], key[go], seed[go], rate[go], now[go]
    return owner.reshape(docs, registers)


def _sketches(bands: int, rows: int, words: int):
    def start():
        def work(column: pa.Array) -> dict[str, pa.Array]:
            n = len(column)
            doc, key, times = shingles(column, words)
            sketch = prob_minhash(doc, key, times, n, bands * rows).reshape(n, bands, rows)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (n, bands)).copy()
            for r in range(rows):
                h = mix64(h * _GOLDEN + sketch[:, :, r])
            some = np.bincount(doc, minlength=n) > 0
            keys = [row if ok else None for row, ok in zip(h.view(np.int64).tolist(), some)]
            source = column.cast(pa.binary()).to_pylist()
            return {
                "digest": pa.array([hashlib.sha256(t or b"").digest() for t in source], pa.binary()),
                "bands": pa.array(keys, pa.list_(pa.int64())),
            }

        return work

    return start


def _packed(key: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted 64-bit hashes, then (position, times) of those that occur more than once."""
    more = np.flatnonzero(times > 1)
    extra = np.stack([more, times[more]], axis=1).astype("<u4")
    return np.array([len(key)], "<u8").tobytes() + key.astype("<u8").tobytes() + extra.tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their times."""
    n = int.from_bytes(raw[:8], "little")
    key, times = np.frombuffer(raw, "<u8", n, 8), np.ones(n)
    extra = np.frombuffer(raw, "<u4", offset=8 + 8 * n).reshape(-1, 2)
    times[extra[:, 0]] = extra[:, 1]
    return key, times


def _sets(words: int):
    def start():
        def work(column: pa.Array) -> dict[str, pa.Array]:
            doc, key, times = shingles(column, words)
            order = np.lexsort((key, doc))
            doc, key, times = doc[order], key[order], times[order]
            ends = np.cumsum(np.bincount(doc, minlength=len(column))).tolist()
            out = [_packed(key[a:b], times[a:b]) for a, b in zip([0, *ends], ends)]
            return {"shingles": pa.array(out, pa.binary())}

        return work

    return start


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two sets (sorted distinct hashes, times).

    The sum over shared elements i of 1 / sum_j max(a_j / a_i, b_j / b_i); with
    equal weights it is the plain Jaccard similarity.
    """
    (ka, wa), (kb, wb) = a, b
    shared, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    # Element j takes its part from a where a_j / b_j is above a_i / b_i; order by that ratio once.
    order = np.argsort(wa[ia] / wb[ib])
    ta, tb = wa[ia][order], wb[ib][order]
    only_a, only_b = wa.sum() - ta.sum(), wb.sum() - tb.sum()
    from_a, from_b = ta.sum() - np.cumsum(ta), np.cumsum(tb)
    return float((1 / ((from_a + only_a) / ta + (from_b + only_b) / tb)).sum())


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, similarity) of pairs, read from the sets of both."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            value = [
                probability_jaccard(unpacked(x), unpacked(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(value, pa.float64())], ["a", "b", "similarity"]
            )

    kind = pairs.schema["a"].dataType.simpleString()
    # Sorted merges at every size; a leader with very many pairs is split by the adaptive skew join.
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _bridges(block: pa.Table, similarity: float) -> pa.Table:
    """Links between classes among a block of outsiders and a block of members of one bucket.

    The similarity is at most the sum over shared shingles of the root of the
    product of shares; those sums come from matrix products, and only pairs they
    do not rule out are measured. Pairs within one class, or joined by links
    found here before, are passed over, so links come out as a spanning forest.
    """
    rows = block.to_pydict()
    sets = [unpacked(x) for x in rows["shingles"]]
    lead = np.flatnonzero(np.array(rows["leads"], bool))
    rest = np.flatnonzero(~np.array(rows["leads"], bool))
    far = np.array(rows["far"])
    names, number = np.unique(np.array(rows["class"], object).astype(str), return_inverse=True)
    name_of = dict(zip(number.tolist(), rows["class"]))
    out_a, out_b = [], []
    if len(lead) and len(rest):
        keys = [np.concatenate([sets[k][0] for k in side]) for side in (lead, rest)]
        both = np.intersect1d(np.unique(keys[0]), np.unique(keys[1]), assume_unique=True)
        bound = np.zeros((len(lead), len(rest)), np.float32)

        def dense(side: np.ndarray, lo: int, hi: int) -> np.ndarray:
            m = np.zeros((len(side), hi - lo), np.float32)
            for i, k in enumerate(side.tolist()):
                key, times = sets[k]
                at = np.searchsorted(both[lo:hi], key)
                ok = (at < hi - lo) & (both[lo:hi][np.minimum(at, hi - lo - 1)] == key)
                m[i, at[ok]] = np.sqrt(times[ok] / times.sum())
            return m

        for lo in range(0, len(both), 8192):
            hi = min(lo + 8192, len(both))
            bound += dense(lead, lo, hi) @ dense(rest, lo, hi).T
        maybe = (bound >= similarity - 1e-3) & (number[lead][:, None] != number[rest][None, :])
        maybe &= np.abs(far[lead][:, None] - far[rest][None, :]) <= 1 - similarity + 1e-9
        i, j = np.nonzero(maybe)
        order = np.argsort(-bound[i, j], kind="stable")
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for p, q in zip(lead[i[order]].tolist(), rest[j[order]].tolist()):
            x, y = find(number[p]), find(number[q])
            if x != y and probability_jaccard(sets[p], sets[q]) >= similarity:
                parent[x] = y
                out_a.append(name_of[int(number[p])])
                out_b.append(name_of[int(number[q])])
    kind = block.schema.field("class").type
    return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """Class of every document: rows (doc_id, class_id, copies_of).

    Documents of one text are copies; the one of least doc_id stands for them
    (copies_of). Representatives that share a band are candidates, and a link is
    a probability Jaccard similarity of the counted shingles of similarity or
    more. class_id is the least doc_id that links reach.

    No bucket is expanded into all pairs. First the least member of each bucket
    is compared with the others, and classes form. What can still join classes
    is a link from an outsider, a member not in the class of its bucket's first,
    to a member of another class; the triangle inequality of the distance
    (1 - similarity) to the first rules many out. Outsiders and members of a
    bucket are cut into blocks of about block rows, and each pair of blocks is
    compared in a task of its own, which returns a spanning forest of links.

    Null texts count as empty; texts without words link only to their copies.
    Rows with a null doc_id are left out (they cannot be named); repeated ids
    are one document. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    sketch = materialise(map_text(docs, _sketches(bands, rows, words), fields))
    standing = sketch.groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    standing = standing.select("digest", F.col("m.doc_id").alias("doc_id"), F.col("m.bands").alias("bands"))

    bucket = standing.select("doc_id", F.explode("bands").alias("bucket"))
    first = bucket.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Members of buckets of two or more, each beside the bucket's first.
    member = materialise(bucket.join(first.hint("merge"), "bucket").where("doc_id <> a").select("bucket", "a", F.col("doc_id").alias("b")))
    pairs = member.select("a", "b").distinct()
    named = member.select(F.col("a").alias("doc_id")).union(member.select("b")).distinct()
    sets = map_text(docs.join(named.hint("merge"), "doc_id", "left_semi"), _sets(words), [T.StructField("shingles", T.BinaryType())])
    sets = materialise(sets.dropDuplicates(["doc_id"]))
    seen = materialise(_similar(pairs, sets))
    classes = components(seen.where(F.col("similarity") >= similarity).select("a", "b"))

    of = lambda c: classes.select(F.col("id").alias(c), F.col("component").alias(f"class_{c}"))
    near = (
        member.join(seen, ["a", "b"])
        .join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .select("bucket", "b", (1 - F.col("similarity")).alias("far"), F.coalesce("class_a", "a").alias("class_a"), F.coalesce("class_b", "b").alias("class"))
        .withColumn("out", F.col("class") != F.col("class_a"))
    )
    near = materialise(near.drop("class_a"))
    # Buckets with an outsider and another member; and how far their outsiders reach.
    room = near.groupBy("bucket").agg(
        F.min(F.when(F.col("out"), F.col("far"))).alias("least"),
        F.max(F.when(F.col("out"), F.col("far"))).alias("most"),
        F.ceil(F.count_if("out") / block).cast("int").alias("n_out"),
        F.ceil(F.count("*") / block).cast("int").alias("n_all"),
        F.count("*").alias("n"),
    ).where("n_out > 0 and n > 1").drop("n")
    reach = 1 - similarity + 1e-9
    open_ = near.join(room, "bucket").where((F.col("far") >= F.col("least") - reach) & (F.col("far") <= F.col("most") + reach))
    lot = lambda n: F.pmod(F.xxhash64("b"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leads = open_.where("out").select("bucket", lot(F.col("n_out")).alias("i"), every("n_all").alias("j"), "b", "far", "class", F.lit(True).alias("leads"))
    others = open_.select("bucket", every("n_out").alias("i"), lot(F.col("n_all")).alias("j"), "b", "far", "class", F.lit(False).alias("leads"))
    dealt = materialise(leads.union(others))
    bridges = materialise(
        dealt.join(sets.withColumnRenamed("doc_id", "b").hint("merge"), "b")
        .groupBy("bucket", "i", "j")
        .applyInArrow(lambda t: _bridges(t, similarity), f"a {kind}, b {kind}")
    )
    joined = components(bridges.distinct())
    final = classes.join(joined.select(F.col("id").alias("component"), F.col("component").alias("wider")), "component", "left")
    final = final.select("id", F.coalesce("wider", "component").alias("class"))
    alone = joined.join(classes, "id", "left_anti").select("id", F.col("component").alias("class"))
    table_ = (
        standing.select("digest", F.col("doc_id").alias("copies_of"))
        .join(final.union(alone).withColumnRenamed("id", "copies_of"), "copies_of", "left")
        .select("digest", "copies_of", F.coalesce("class", "copies_of").alias("class_id"))
    )
    return sketch.select("doc_id", "digest").join(table_, "digest").select("doc_id", "class_id", "copies_of")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, one document of every class: the one of least doc_id.

    Rows with a null doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.withColumn("kept", F.col("doc_id") == F.col("class_id"))
