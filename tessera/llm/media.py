"""Texts stored as lossless WebP, read back, and described."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import map_text, table
from tessera.llm.webp import OPAQUE, decode, encode

#: Bytes of one row of 64 pixels; a payload is a whole number of rows.
ROW = 192
#: Rows of one still. Longer payloads are several stills, one file after another.
TILE_ROWS = 64
#: Bytes and rows of text in one slice: many stills are read in lockstep.
SLICE_BYTES, SLICE_ROWS = 8_000_000, 6000
#: Pixels worked on in one call.
BATCH_PIXELS = 500_000


def payload_of(raw: bytes) -> bytes:
    """raw with spaces behind it up to a positive multiple of ROW."""
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" ")


def tiles_of(payload: bytes) -> list[np.ndarray]:
    """Images of 64 columns and up to TILE_ROWS rows; a pixel's red, green and blue are three bytes."""
    rgb = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(np.uint32)
    argb = OPAQUE | rgb[..., 0] << np.uint32(16) | rgb[..., 1] << np.uint32(8) | rgb[..., 2]
    return [argb[k : k + TILE_ROWS] for k in range(0, len(argb), TILE_ROWS)]


def samples_of(image: np.ndarray) -> np.ndarray:
    """8-bit samples (height, width, 3)."""
    return np.stack([(image >> np.uint32(s)) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8)


def files_in(media: bytes) -> list[bytes]:
    """The files of a stored form."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and spread of each channel, and the share of rows that repeat the row above, in whole numbers."""
    flat = samples.reshape(-1, 3).astype(np.int64)
    mean = (flat.sum(axis=0) * 1000) // len(flat)
    spread = ((flat * flat).sum(axis=0) * 1000) // len(flat)
    step = int(np.abs(np.diff(flat[:, 1])).sum()) if len(flat) > 1 else 0
    same = int((samples[1:] == samples[:-1]).all(axis=(1, 2)).sum())
    numbers = [samples.shape[1], samples.shape[0], *mean.tolist(), *spread.tolist(), step, same]
    return "w{} h{} mean {} {} {} square {} {} {} step {} same {}".format(*numbers)


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of every payload."""
    tiles = [tiles_of(p) for p in payloads]
    flat = [t for some in tiles for t in some]
    files: list[bytes] = []
    lo = 0
    while lo < len(flat):
        hi, size = lo, 0
        while hi < len(flat) and (hi == lo or size + flat[hi].size <= BATCH_PIXELS):
            size += flat[hi].size
            hi += 1
        files += encode(flat[lo:hi])
        lo = hi
    out, at = [], 0
    for some in tiles:
        out.append(b"".join(files[at : at + len(some)]))
        at += len(some)
    return out


def load(media: list[bytes], stills: int = 5000) -> list[np.ndarray]:
    """The samples (rows, 64, 3) of every stored form."""
    files = [files_in(m) for m in media]
    flat = [f for some in files for f in some]
    images: list[np.ndarray] = []
    for lo in range(0, len(flat), stills):
        images += [samples_of(i) for i in decode(flat[lo : lo + stills])]
    out, at = [], 0
    for some in files:
        out.append(np.concatenate(images[at : at + len(some)]))
        at += len(some)
    return out


FIELDS = [
    T.StructField("media", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]


def to_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_media: bool = True) -> DataFrame:
    """Every whole text stored as WebP (column media), read back, and described.

    The UTF-8 bytes, with spaces up to a positive multiple of 192, are the red,
    green and blue samples of rows of 64 pixels. The columns beside media are
    computed from what the stored bytes decode to. Null and empty texts are one
    row of spaces. Equal texts give equal values; an empty table gives no rows;
    columns outside keep are dropped, kept ones named as ours are replaced.
    """
    fields = FIELDS if with_media else FIELDS[1:]

    def start():
        def work(column: pa.Array) -> dict[str, pa.Array]:
            raw = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
            out: list[tuple] = []
            media = store([payload_of(r) for r in raw])
            for r, m, samples in zip(raw, media, load(media)):
                back = samples.tobytes()
                out.append(
                    (
                        m if with_media else None,
                        len(r),
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-16:]),
                        len(m),
                        hashlib.sha256(m).hexdigest(),
                        feature_of(samples),
                    )
                )
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * len(kinds)
            return {f.name: pa.array(c, k) for f, c, k in zip(FIELDS, columns, kinds)}

        return work

    return map_text(docs, start, fields, keep, most=SLICE_BYTES, rows=SLICE_ROWS)


def op9_media(spark, sf_dir: str) -> DataFrame:
    return to_media(table(spark, sf_dir, "documents"), with_media=False)
