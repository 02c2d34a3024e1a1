import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import webp as W
from tessera.llm.media import files_in, load, op9_media, payload_of, store, to_media

OPAQUE = np.uint32(0xFF000000)


def image(rng, h, w, colours):
    return OPAQUE | rng.integers(0, colours, (h, w)).astype(np.uint32) * np.uint32(0x010203)


def some_images():
    rng = np.random.default_rng(0)
    out = [image(rng, h, w, k) for h, w, k in ((1, 64, 1), (3, 64, 2), (5, 64, 4), (7, 64, 9), (9, 64, 200), (40, 64, 60000), (1, 1, 3), (13, 7, 50), (2, 300, 17))]
    return out + [np.tile(image(rng, 2, 64, 5000), (8, 1))]


TRANSFORMS = [None, (), (W.PREDICTOR,), (W.CROSS,), (W.SUBTRACT,), (W.PALETTE,), (W.PREDICTOR, W.CROSS), (W.SUBTRACT, W.PREDICTOR), (W.PALETTE, W.PREDICTOR)]


@pytest.mark.parametrize("force", TRANSFORMS)
def test_every_transform_and_mode(force):
    for mode in range(14) if force and W.PREDICTOR in force else [2]:
        for bits in (None, 0, 1, 6):
            images = some_images()
            for a, b in zip(W.decode(W.encode(images, force=force, mode=mode, cache_bits=bits)), images):
                assert a.shape == b.shape and (a == b).all()


def test_codes_are_complete_and_decodable():
    rng = np.random.default_rng(4)
    counts = (rng.zipf(1.3, (20, 280)) * (rng.random((20, 280)) < 0.4)).astype(np.int64)
    n = W.code_lengths(counts)
    used = counts > 0
    assert (np.where(used, 1 << (15 - n), 0).sum(axis=1) == 1 << 15).all() and n.max() <= 14


def test_hand_written_file():
    """One red pixel, all codes of one symbol, as the format's text describes it."""
    w = W.Writer()
    for value, bits in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(value, bits)
    for symbol in (0, 255, 0, 255, 0):
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(symbol > 1), 1)
        w.put(symbol, 8 if symbol > 1 else 1)
    data = w.value.to_bytes((w.size + 7) // 8, "little")
    body = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    file = b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body
    assert W.decode([file])[0].tolist() == [[0xFFFF0000]]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_payloads_round_trip(raws):
    payloads = [payload_of(r) for r in raws]
    assert [x.tobytes() for x in load(store(payloads))] == payloads


def test_long_text_is_several_stills_and_equal_texts_are_equal():
    p = payload_of(b"abc def " * 20_000)
    a, b = store([p, payload_of(b"x")]), store([payload_of(b"y"), p])
    assert a[0] == b[1] and len(files_in(a[0])) > 1


def test_not_webp():
    with pytest.raises(ValueError):
        W.decode([b"RIFF0000WEBPVP8 xxxx"])


def check(text, r):
    raw = (text or "").encode()
    p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest())
    assert r["tail_crc32"] == zlib.crc32(p[-16:])


def test_edges(spark):
    texts = [None, "", "é" * 96, "x" * 192, "x" * 193, "line\n" * 9000]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = to_media(df, keep=("doc_id", "feature")).collect()
    for r in rows:
        check(texts[r["doc_id"]], r)
        assert hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
    assert rows[0]["feature"] == rows[1]["feature"]
    assert to_media(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_media(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        check(docs[r["doc_id"]], r)
