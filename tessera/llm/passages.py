"""Repeated passages between documents by seed and extend over winnowed anchors.

Every window of words names one anchor, the run of SEED words with the least hash
in it (winnowing), so equal windows name equal anchors at the same place. Documents are
joined on their anchors. A seed is extended word by word to both sides against the anchor's
first document; where the extension ends short of what a window needs, occurrences that
go on alike meet again, under the first of them. After ROUNDS of that the windows still open
meet by all their words. Windows found either way merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BASE, SpanHasher, map_text, materialise, mix64, runs, table, utf8_parts

#: Words of a window that counts as a repeat, and of an anchor.
WINDOW, SEED = 50, 20
#: Extensions against a first occurrence before windows meet by all their words: near copies differ each elsewhere,
#: so a few first ones decide most windows, and the number of jobs does not depend on the data.
ROUNDS = 5
#: A longer word is compared by its digest.
_LONG = 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

SEEDS = T.ArrayType(
    T.StructType(
        [
            T.StructField("anchor", T.LongType()),
            T.StructField("around", T.BinaryType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("lo", T.IntegerType()),
            T.StructField("hi", T.IntegerType()),
        ]
    )
)


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in every stretch of width values."""
    value, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = value[step:] < value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        span += step
    return at


def _spread(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a space behind each, and the start of each text."""
    offsets, raw = utf8_parts(column)
    n = len(offsets) - 1
    out = np.full(len(raw) + n, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = raw
    return out, offsets[:-1] + np.arange(n)


def _seeds(window: int, seed: int) -> Callable[[], Callable[[pa.Array], dict[str, pa.Array]]]:
    wide = window - seed + 1

    def work(part: pa.Array) -> dict[str, pa.Array]:
        data, begin = _spread(part)
        white = _WHITE[data]
        start, end = runs(~white)
        of = np.searchsorted(begin, start, "right") - 1
        lists: list[list[dict]] = [[] for _ in range(len(part))]
        n = len(start)
        if n >= window:
            # Words joined by one space, and where each begins there.
            kept = ~white | np.concatenate(([False], ~white[:-1]))
            line = data[kept].tobytes()
            place = np.concatenate(([0], np.cumsum(end - start + 1)))
            word = mix64(SpanHasher(data)(start, end))
            power = np.full(n + 1, BASE, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            np.multiply.accumulate(back, out=back)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * power[:n], dtype=np.uint64)))
            gram = mix64((total[seed:] - total[:-seed]) * back[: n - seed + 1])
            least = _first_least(gram, wide)
            inside = of[: n - window + 1] == of[window - 1 :]
            chosen = np.unique(least[: n - window + 1][inside])
            first, last = np.searchsorted(of, of[chosen], "left"), np.searchsorted(of, of[chosen], "right")
            hi = np.minimum(window - seed, chosen - first)
            lo = np.maximum(0, window - (last - chosen))
            left, right = place[chosen - hi].tolist(), (place[chosen + window - lo] - 1).tolist()
            rows = zip(of[chosen].tolist(), gram[chosen].view(np.int64).tolist(), (chosen - first).tolist(), lo.tolist(), hi.tolist(), left, right)
            for doc, anchor, pos, a, b, x, y in rows:
                around = blake2b(line[x:y], digest_size=16, salt=b"%d" % b).digest()
                lists[doc].append({"anchor": anchor, "around": around, "pos": pos, "lo": a, "hi": b})
        kind = pa.list_(pa.struct([("anchor", pa.int64()), ("around", pa.binary()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))
        return {"seeds": pa.array(lists, kind)}

    return lambda: work


def _short(words: list[bytes]) -> list[bytes]:
    return [w if len(w) <= _LONG else b"\0" + blake2b(w, digest_size=16).hexdigest().encode() for w in words]


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _branch(key: int, side: bytes, words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8, key=key.to_bytes(8, "little", signed=True), person=side).digest(), "little", signed=True)


def extend(key: int, lo: int, hi: int, own: tuple[list, list], first: tuple[list, list], window: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Extend a seed against the first occurrence: the windows both have, and where the others go on.

    own and first are the words to the left, nearest first, and those from the seed's
    first on. A window is named by how many words it has to the left of the seed,
    lo to hi of them are to be decided. Returned are the least and largest both
    have, and (key, lo, hi) of the rest: windows that reach a word on the left, or
    else on the right, in which the two differ, under a key of the words up to that one.
    """
    left, right = _common(own[0], first[0]), _common(own[1], first[1])
    rest = []
    if hi > left:
        rest.append((_branch(key, b"left", own[0][: left + 1]), max(lo, left + 1), hi))
    if (top := min(hi, left, window - 1 - right)) >= lo:
        rest.append((_branch(key, b"right", own[1][: right + 1]), lo, top))
    return max(lo, window - right), min(hi, left), rest


def _contexts(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Occurrences with the words around them, as far as a window of theirs reaches."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "doc_id", "h", "pos", "lo", "hi", "left", "right"]
    marks = marks.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "pos", "lo", "hi")).alias("marks"))
    # Rows that repeat a doc_id with its text have the same occurrences: one of them is enough.
    source = docs.join(marks.hint("merge"), ["doc_id", "h"]).select("doc_id", "h", "text", "marks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = _short(batch.column("text")[k].as_py().encode().split())
                marks = batch.column("marks")[k].as_py()
                for at in range(0, len(marks), 2000):
                    some = marks[at : at + 2000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([m["anchor"] for m in some], pa.int64()),
                            pa.concat_arrays([batch.column("doc_id").slice(k, 1)] * n),
                            pa.concat_arrays([batch.column("h").slice(k, 1)] * n),
                            *[pa.array([m[c] for m in some], pa.int32()) for c in ("pos", "lo", "hi")],
                            pa.array([b" ".join(words[m["pos"] - m["hi"] : m["pos"]][::-1]) for m in some], pa.binary()),
                            pa.array([b" ".join(words[m["pos"] : m["pos"] + window - m["lo"]]) for m in some], pa.binary()),
                        ],
                        names,
                    )

    return source.mapInArrow(run, f"key long, doc_id {id_kind}, h long, pos int, lo int, hi int, left binary, right binary")


def _round(rows: DataFrame, window: int) -> DataFrame:
    """Every occurrence extended against the first of its key: found windows (key null), and the rest under new keys."""
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    firsts = rows.groupBy("key").agg(F.min(F.struct("doc_id", "h", "pos", "left", "right")).alias("m"), F.max("doc_id").alias("last"))
    firsts = firsts.where("m.doc_id < last").select("key", F.col("m.doc_id").alias("first_id"), F.col("m.left").alias("first_left"), F.col("m.right").alias("first_right"))
    pairs = rows.join(firsts.hint("merge"), "key")
    names = ["key", "doc_id", "h", "pos", "lo", "hi", "left", "right"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lo, hi, left, right, first_left, first_right = (batch.column(c).to_pylist() for c in ("key", "lo", "hi", "left", "right", "first_left", "first_right"))
            later = np.array([a != b for a, b in zip(batch.column("doc_id").to_pylist(), batch.column("first_id").to_pylist())])
            at: list[int] = []
            new: list[tuple] = []
            for k in range(batch.num_rows):
                own, first = (left[k].split(), right[k].split()), (first_left[k].split(), first_right[k].split())
                least, most, rest = extend(key[k], lo[k], hi[k], own, first, window)
                if later[k] and least <= most:
                    at.append(k)
                    new.append((None, least, most, None, None))
                for name, a, b in rest:
                    at.append(k)
                    new.append((name, a, b, left[k], right[k]))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in new], pa.int64()),
                    *[batch.column(c).take(where) for c in ("doc_id", "h", "pos")],
                    *[pa.array([x[c] for x in new], pa.int32()) for c in (1, 2)],
                    *[pa.array([x[c] for x in new], pa.binary()) for c in (3, 4)],
                ],
                names,
            )

    return pairs.mapInArrow(run, f"key long, doc_id {id_kind}, h long, pos int, lo int, hi int, left binary, right binary")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(digest, doc_id, h, pos, lo, hi): each open window of an occurrence with the digest of its words; lo is hi."""
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    rows = rows.join(shared.hint("merge"), "key")
    names = ["digest", "doc_id", "h", "pos", "lo", "hi"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            new: list[tuple[bytes, int]] = []
            for k, (lo, hi, left, right) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "left", "right")])):
                before = left.split()[::-1]
                words = before + right.split()
                place = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
                line = b" ".join(words)
                for a in range(lo, hi + 1):
                    start = len(before) - a
                    at.append(k)
                    new.append((blake2b(line[place[start] : place[start + window] - 1], digest_size=16).digest(), a))
            where = pa.array(at, pa.int64())
            spot = pa.array([x[1] for x in new], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.binary()), *[batch.column(c).take(where) for c in ("doc_id", "h", "pos")], spot, spot], names)

    return rows.mapInArrow(run, f"digest binary, doc_id {id_kind}, h long, pos int, lo int, hi int")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Spans of words (doc_id, h, start, end) all of whose windows an earlier document has; h is xxhash64 of the text.

    Spans may overlap; their union are the maximal repeats. docs are (doc_id, text, h).
    """
    docs = docs.where("doc_id is not null")
    found = map_text(docs, _seeds(window, seed), [T.StructField("seeds", SEEDS)], keep=("doc_id", "h"))
    seeds = materialise(found.select("doc_id", "h", F.explode("seeds").alias("s")).select("doc_id", "h", "s.*"))
    # Occurrences with the same words as far as their windows reach need no extension: the first document decides for all.
    alike = materialise(seeds.groupBy("anchor", "around").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    varied = alike.groupBy("anchor").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("anchor", F.lit(True).alias("varied"))
    wanted = alike.join(varied.hint("merge"), "anchor", "left").where("varied or last > first")
    met = materialise(
        seeds.join(wanted.select("anchor", "around", "first", "varied").hint("merge"), ["anchor", "around"])
        .where("varied or doc_id > first")
        .select("anchor", "doc_id", "h", "pos", "lo", "hi", (F.col("doc_id") > F.col("first")).alias("settled"))
    )
    columns = ["doc_id", "h", "pos", "lo", "hi"]
    spans = met.where("settled").select(columns)
    rows = materialise(_contexts(docs, met.where("not settled"), window), "zstd")
    for _ in range(ROUNDS):
        step = materialise(_round(rows, window), "zstd")
        spans = spans.union(step.where("key is null").select(columns))
        rows = step.where("key is not null")
    open_ = materialise(_windows(rows, window), "zstd")
    firsts = open_.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    spans = spans.union(open_.join(firsts.hint("merge"), "digest").where("doc_id > first").select(columns))
    return spans.select("doc_id", "h", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + window).alias("end"))


def remove_passages_between(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """For every row of docs (doc_id, text): kept, n_words, n_removed and the removed spans.

    Words are runs of bytes other than space and \\t to \\r. A word goes where a
    window of window words that covers it also starts in a document with a
    smaller doc_id, in the texts as given; kept are the others, joined by one space. removed
    lists the maximal spans [start, end) of words that went.

    Null texts have no words and an empty kept, like empty ones. A null doc_id is neither smaller nor
    larger than another: such a row loses nothing and takes nothing. Rows that repeat a doc_id are one
    document's, never each other's earlier copies; each is judged by its own text. Texts of fewer
    words than a window lose nothing. A text is read whole, however long, in a task that
    holds it and its words. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    spans = repeats(docs, window, seed).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                kept, n_words, n_removed, removed = [], [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = (text or "").encode().split()
                    n_words.append(len(words))
                    if not gone:
                        kept.append(b" ".join(words))
                        n_removed.append(0)
                        removed.append([])
                        continue
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [g["start"] for g in gone], 1)
                    np.add.at(edge, [g["end"] for g in gone], -1)
                    away = np.cumsum(edge[:-1]) > 0
                    starts, ends = runs(away)
                    kept.append(b" ".join(w for w, off in zip(words, away.tolist()) if not off))
                    n_removed.append(int(away.sum()))
                    removed.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span)],
                    ["doc_id", "kept", "n_words", "n_removed", "removed"],
                )

    joined = docs.join(spans.hint("merge"), ["doc_id", "h"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {id_kind}, kept string, n_words long, n_removed long, removed array<struct<start: int, end: int>>")


def op11_passages(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that an earlier one has."""
    got = remove_passages_between(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
