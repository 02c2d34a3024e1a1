"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multiplier of the polynomial byte hash; odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path under the shared folder named by spark.checkpoint.dir.

    Only where the session names none and Spark runs on one machine (unit tests)
    a temporary folder is made and put into the session's settings.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, under the session's codec where none is named.

    This cuts lineage: an executor that is lost later costs a reread of shared
    files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets (one more than rows) and bytes of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


#: Bytes and rows of text that one call of an operator's function gets; a longer text comes alone.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 4000


def by_size(column: pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """Slices of a text column of up to most bytes and rows rows each, in order."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(column):
        before = ends[lo - 1] if lo else 0
        hi = min(max(lo + 1, int(np.searchsorted(ends, before + most, "right"))), lo + rows, len(column))
        yield column.slice(lo, hi - lo)
        lo = hi


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def map_text(
    docs: DataFrame,
    fn: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] = ("doc_id",),
    where: Callable[[dict[str, pa.Array]], pa.Array] | None = None,
    most: int = SLICE_BYTES,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Run a function of the text column over slices of Arrow batches, partition by partition.

    fn() is called once a partition and returns a function from a slice of the
    text column, of most bytes and rows rows or a single longer text, to new columns; the
    memory of a task is that of a slice, however many rows a batch has. Columns in keep pass through; a new column replaces a kept
    one of the same name. where, given the new columns, picks the rows to keep;
    then the new columns themselves are not returned.
    """
    names = [f.name for f in fields] if where is None else []
    kept = [c for c in keep if c not in names]
    # Inside, columns have neutral names: Arrow maps do not quote a name with a dot.
    columns = list(dict.fromkeys([*kept, "text"]))
    at = columns.index("text")
    source = docs.select(*[(quoted(c).cast("string") if c == "text" else quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    added = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)] if where is None else []
    schema = T.StructType([source.schema[f"c{i}"] for i in range(len(kept))] + added)
    inner = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            old = batch.columns[: len(kept)]
            lo = 0
            for part in by_size(batch.column(at), most, rows):
                new = work(part)
                here = [c.slice(lo, len(part)) for c in old]
                lo += len(part)
                if where is not None:
                    out = pa.RecordBatch.from_arrays(here, inner).filter(where(new))
                    if out.num_rows:
                        yield out
                else:
                    yield pa.RecordBatch.from_arrays(here + [new[n] for n in names], inner)

    return source.mapInArrow(run, schema).toDF(*kept, *names)


def quoted(name: str) -> Column:
    """A column by its plain name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHasher:
    """Hashes of many byte spans of one buffer from a single prefix sum.

    The hash of a span is the polynomial sum of its bytes; spans are compared
    after multiplying with the inverse power of their start, modulo 2^64.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = np.uint64(BASE)
        np.multiply.accumulate(power, out=power)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])
        inverse = np.empty(n + 1, np.uint64)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        np.multiply.accumulate(inverse, out=inverse)
        self.inverse = inverse

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), the least id.

    Every round takes the least label among neighbours and then follows the
    label once more, so long chains halve. Labels are written to the shared
    folder each round. Vertices without an edge do not appear.
    """
    both = materialise(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v")
        .distinct()
    )
    label = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("component"))
    label = materialise(label)
    while True:
        near = (
            both.join(label.withColumnRenamed("id", "v"), "v")
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        hop = label.select(F.col("id").alias("c"), F.col("component").alias("further"))
        new = materialise(
            step.join(hop, "c").select("id", "was", F.least("c", "further").alias("component"))
        )
        changed = not new.where("component <> was").isEmpty()
        label = new.select("id", "component")
        if not changed:
            return label
