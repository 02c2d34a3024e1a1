"""Removal of repeated passages: runs of lines with 50 words or more, and chunks of lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_text, materialise, mix64, quoted, table, texts

#: Lines in the rolling window, and one in how many windows ends a chunk.
WINDOW, SPACING = 2, 3
#: A line of this many words is a passage in itself and so a chunk of its own.
PASSAGE_WORDS = 50
_MUL = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in lines], np.uint64)


def boundaries(lines: list[str], window: int = WINDOW, spacing: int = SPACING, passage_words: int = PASSAGE_WORDS) -> list[int]:
    """Ends of the chunks of lines (exclusive, the last is the number of lines).

    A chunk ends after a line where the rolling hash over the hashes of it and
    the lines before it in the window is a multiple of spacing, so boundaries
    move with the content when lines are put in before. A line of passage_words
    words or more stands alone.
    """
    n = len(lines)
    h = line_hashes(lines)
    roll = np.zeros(n, np.uint64)
    for back in range(window):
        shifted = np.concatenate((np.zeros(back, np.uint64), h[: n - back])) if back else h
        roll = mix64(roll * _MUL + shifted)
    cut = roll % np.uint64(spacing) == 0
    cut[: window - 1] = False
    long = np.array([x.count(" ") + 1 >= passage_words for x in lines], bool)
    cut |= long
    cut[:-1] |= long[1:]
    cut[-1] = True
    return (np.flatnonzero(cut) + 1).tolist()


def digest_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _is_passage(lines: list[str]) -> bool:
    """Whether a repeat of these lines is removed: several lines with text, or one long line."""
    full = sum(1 for x in lines if x.strip())
    return full >= 2 or (full == 1 and max(x.count(" ") for x in lines) + 1 >= PASSAGE_WORDS)


def _digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def windows(lines: list[str], passage_words: int = PASSAGE_WORDS) -> list[tuple[int, int, bytes]]:
    """Shortest runs of lines with passage_words words: (first line, end, digest), each first and last line with text.

    One run starts at each line with text and one ends at each, where the text
    has that many words after or before it; two such lines with blank ones between
    make one more. Any run of lines of so many words is the union of those inside it, so a
    passage repeats as a whole just where its windows do. The digest is of the lines and the blank lines between.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    total = np.concatenate(([0], np.cumsum([len(lines[i].split()) for i in full], dtype=np.int64)))
    n = len(full)
    if total[-1] < passage_words:
        return []
    ahead = np.searchsorted(total, total[:-1] + passage_words)
    behind = np.searchsorted(total, total[1:] - passage_words, side="right") - 1
    spans = {(s, e) for s, e in enumerate(ahead.tolist()) if e <= n} | {(s, e) for e, s in enumerate(behind.tolist(), 1) if s >= 0}
    # Two long lines with blank ones between: no window so far holds the blank ones.
    spans |= {(k, k + 2) for k in range(n - 1) if full[k + 1] > full[k] + 1 and (k, k + 1) in spans and (k + 1, k + 2) in spans}
    parts = []
    for k, i in enumerate(full):
        blank = lines[full[k - 1] + 1 : i] if k else []
        parts.append(_digest16("\n".join(blank).encode("utf-8", "surrogatepass") + b"\n") if blank else bytes(16))
        parts.append(_digest16(lines[i].encode("utf-8", "surrogatepass")))
    joined = b"".join(parts)
    return [(full[s], full[e - 1] + 1, _digest16(joined[32 * s + 16 : 32 * e])) for s, e in sorted(spans)]


CHUNK = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk", T.IntegerType()),
            T.StructField("digest", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
RUN = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )
)


def _chunks(with_text: bool):
    def start():
        def work(column: pa.Array) -> dict[str, pa.Array]:
            out = []
            for text in texts(column):
                lines, rows, last = text.split("\n"), [], 0
                for k, end in enumerate(boundaries(lines)):
                    part = lines[last:end]
                    if _is_passage(part):
                        whole = "\n".join(part)
                        rows.append({"chunk": k, "digest": digest_of(whole), "text": whole if with_text else None})
                    last = end
                out.append(rows)
            kind = pa.list_(pa.struct([("chunk", pa.int32()), ("digest", pa.int64()), ("text", pa.string())]))
            return {"chunks": pa.array(out, kind)}

        return work

    return start


def _runs():
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))

    def work(column: pa.Array) -> dict[str, pa.Array]:
        out = [[{"start": s, "end": e, "digest": d} for s, e, d in windows(text.split("\n"))] for text in texts(column)]
        return {"runs": pa.array(out, kind)}

    return work


def _without(batches, count: int, at: int):
    """Texts (column at of count) without their removed chunks and runs; lines go with their line ends."""
    inner = [*[f"c{i}" for i in range(count)], *REMOVED]
    for batch in batches:
        text = batch.column(at)
        gone = batch.column(batch.schema.get_field_index("__gone"))
        runs = batch.column(batch.schema.get_field_index("__runs"))
        cleaned, chunks, lines_out, bytes_out = [], [], [], []
        for t, g, r in zip(text.to_pylist(), gone.to_pylist(), runs.to_pylist()):
            if not g and not r:
                cleaned.append(t)
                chunks.append(0)
                lines_out.append(0)
                bytes_out.append(0)
                continue
            lines, last, dropped = (t or "").split("\n"), 0, 0
            away = np.zeros(len(lines), bool)
            # The digests guard rows of other text under the same doc_id.
            named = {(x["chunk"], x["digest"]) for x in g or ()}
            numbers = {k for k, _ in named}
            for k, end in enumerate(boundaries(lines) if named else ()):
                if k in numbers and (k, digest_of("\n".join(lines[last:end]))) in named:
                    away[last:end] = True
                    dropped += 1
                last = end
            repeated = {(x["start"], x["end"], x["digest"]) for x in r or ()}
            for run in windows(lines) if repeated else ():
                if run in repeated:
                    away[run[0] : run[1]] = True
            cleaned.append("\n".join(x for x, off in zip(lines, away.tolist()) if not off) if away.any() else t)
            chunks.append(dropped)
            lines_out.append(int(away.sum()))
            bytes_out.append(len((t or "").encode()) - len((cleaned[-1] or "").encode()))
        columns = batch.columns[:count]
        columns[at] = pa.array(cleaned, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(n, pa.int64()) for n in (chunks, lines_out, bytes_out)]], inner)


REMOVED = ["removed_chunks", "removed_lines", "removed_bytes"]


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Occurrences to remove: rows (doc_id, chunk, digest), every one but the first of equal passages.

    Equal digests only nominate; an occurrence is removed when its text equals,
    byte for byte, the text of the digest's first occurrence. First is the least
    (doc_id, chunk), wherever it lies.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    field = [T.StructField("chunks", CHUNK)]
    slim = map_text(docs, _chunks(False), field).select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.chunk", "c.digest")
    firsts = slim.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.chunk").alias("first_chunk")))
    full = map_text(docs, _chunks(True), field).select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*")
    # Sorted merges by choice: the plan is then the same at every size, and a digest
    # or document with many rows is split by the adaptive skew join.
    again = materialise(full.join(firsts.hint("merge"), "digest"))
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("chunk") == F.col("first_chunk"))
    model = again.where(is_first).select("digest", F.col("text").alias("first_text")).dropDuplicates(["digest"])
    return again.where(~is_first).join(model.hint("merge"), "digest").where("text = first_text").select("doc_id", "chunk", "digest").distinct()


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs to remove: rows (doc_id, start, end, digest), every window whose lines an earlier place has.

    Equal windows are those of equal 128-bit digests. The first is the least
    (doc_id, start); one that overlaps it in the same document stays.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    slim = map_text(docs, _runs, [T.StructField("runs", RUN)]).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    firsts = slim.groupBy("digest").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.end").alias("first_end")))
    later = (F.col("doc_id") > F.col("first_doc")) | ((F.col("doc_id") == F.col("first_doc")) & (F.col("start") >= F.col("first_end")))
    return slim.join(firsts.hint("merge"), "digest").where(later).select("doc_id", "start", "end", "digest").distinct()


def _clean(docs: DataFrame, runs: bool) -> DataFrame:
    gone = repeated_chunks(docs).groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "digest")).alias("__gone"))
    names = [c for c in docs.columns if c not in REMOVED]
    # Inside, columns have neutral names: Arrow maps do not quote a name with a dot.
    at, key = names.index("text"), names.index("doc_id")
    source = docs.select(*[(quoted(c).cast("string") if c == "text" else quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    if runs:
        long = repeated_runs(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "digest")).alias("__runs"))
        gone = gone.hint("merge").join(long, "doc_id", "full_outer")
    else:
        gone = gone.withColumn("__runs", F.lit(None).cast(RUN))
    inner = source.columns
    source = source.join(gone.withColumnRenamed("doc_id", f"c{key}").hint("merge"), f"c{key}", "left").select(*inner, "__gone", "__runs")
    schema = T.StructType([source.schema[c] for c in inner] + [T.StructField(c, T.LongType()) for c in REMOVED])
    return source.mapInArrow(lambda batches: _without(batches, len(inner), at), schema).toDF(*names, *REMOVED)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks alone taken out of text, and what was removed.

    Columns of docs stay, other than ones named removed_chunks, removed_lines or
    removed_bytes, which are replaced. No row goes: a text of which nothing is
    left becomes ''. Null texts stay null, empty ones empty, and rows with a null
    doc_id keep their text. Rows that repeat a doc_id with its text are cleaned alike;
    of rows of other text under one doc_id only passages that repeat go. An empty table gives no rows.
    """
    return _clean(docs, False)


def remove_passages(docs: DataFrame) -> DataFrame:
    """As remove_repeats, and every run of lines with 50 words or more that an earlier place has goes whole.

    removed_chunks counts repeated chunks only; removed_lines and removed_bytes
    count all that was removed. Every line removed is left where it comes first.
    """
    return _clean(docs, True)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document what was removed, and size and md5 of what is left."""
    got = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    return got.select("doc_id", *REMOVED, F.octet_length(left).cast("long").alias("left_bytes"), F.md5(left.cast("binary")).alias("left_md5"))
