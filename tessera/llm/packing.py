"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, texts

WINDOW = 2048
END_ID = 1


class ByteBpe:
    """Token ids of whole texts, those of the tokenizers file.

    Texts are cut at the added tokens that the tokenizers file lists, which get
    its ids. The rank file holds the same vocabulary and gives the same ids for
    what lies between (the tests compare whole texts) in a quarter of the time.
    """

    def __init__(self, ranks_path: str, pattern: str, tokenizer_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer_path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit values."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts.

    Leaf c stands for windows with c free places. tightest(n) climbs from leaf n
    to the first subtree on the right that holds a window and descends to its
    leftmost leaf: the least capacity that is n or more.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, name: int) -> None:
        self.held[free].append(name)
        i, count = free + self.size, self.count
        while i:
            count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of need or more, -1 if there is none."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
                if not i:
                    return -1
            i += 1
        while i < self.size:
            i <<= 1
            if not count[i]:
                i += 1
        return i - self.size

    def take(self, free: int) -> int:
        i, count = free + self.size, self.count
        while i:
            count[i] -= 1
            i >>= 1
        return self.held[free].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece; pieces are at most a window long.

    Pieces go in by falling length (ties by position), each into the open window
    with the least room that still holds it.
    """
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        free = tree.tightest(n)
        if free < 0:
            free, name, opened = window, opened, opened + 1
        else:
            name = tree.take(free)
        where[i], offset[i] = name, window - free
        if free > n:
            tree.add(free - n, name)
    return where, offset


def pack(
    docs: DataFrame,
    ranks_path: str | None = None,
    tokenizer_path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    block_tokens: int = 16_000_000,
) -> DataFrame:
    """Cut documents (doc_id, text) into pieces and lay the pieces into windows.

    A document longer than a window first fills whole windows of its own; its
    rest and all shorter documents are packed by best-fit decreasing. Each Spark
    partition packs what it scans, in blocks of about block_tokens tokens, so
    nothing is shuffled and memory stays bounded; a task that runs again after a
    lost executor gives the same windows.

    Null and empty texts are the end id alone. Equal texts and repeated ids are
    packed like any others, an empty table gives no rows, other columns are
    ignored. Returns doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset, one row for each piece.
    """
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    pattern = public_tokenizers.PATTERN
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def lay(ids: list, tokens: list[bytes], first: int, id_type: pa.DataType) -> tuple[Iterator[pa.RecordBatch], int]:
        total = np.fromiter((len(t) // 4 for t in tokens), np.int64, len(tokens))
        pieces = -(-total // window)
        doc = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
        length = np.minimum(window, total[doc] - start)
        seq = np.empty(len(doc), np.int64)
        offset = np.zeros(len(doc), np.int64)
        whole = length == window
        seq[whole] = first + np.arange(int(whole.sum()))
        first += int(whole.sum())
        if not whole.all():
            inner, offset[~whole] = best_fit_decreasing(length[~whole], window)
            seq[~whole] = first + inner
            first += int(inner.max()) + 1

        def rows() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(doc), 4096):
                d = doc[lo : lo + 4096].tolist()
                s, n = start[lo : lo + 4096], length[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in d], id_type),
                        pa.array(s),
                        pa.array(n),
                        pa.array([tokens[i][4 * a : 4 * (a + b)] for i, a, b in zip(d, s.tolist(), n.tolist())], pa.binary()),
                        pa.array(total[d]),
                        pa.array(seq[lo : lo + 4096]),
                        pa.array(offset[lo : lo + 4096]),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        return rows(), first

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(ranks_path, pattern, tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[bytes] = []
        held, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids.append(name)
                tokens.append(bpe.encode(text) + end)
                held += len(tokens[-1]) // 4
                if held >= block_tokens:
                    out, first = lay(ids, tokens, first, id_type)
                    yield from out
                    ids, tokens, held = [], [], 0
        if ids:
            yield from lay(ids, tokens, first, id_type)[0]

    return source.mapInArrow(run, schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
