import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.pieces import Encoder, PieceModel, encode_documents, op10_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b ", "▁x ▁", "rrrrrr ", "a" * 900 + "b", "x\n\n\ty  \n z", "日本語", "\x00\x01", "<s> </s><0x41>", "\U0001d518\U0001f600", "é" * 40]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PieceModel.load(PATH))


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_texts(encoder, reference):
    for text, ids in zip(ODD, encoder.encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text)
        assert encoder.decode(ids) == reference.decode(reference.encode(text))


def test_long_runs_without_a_space(encoder, reference):
    import random

    draw = random.Random(3)
    for text in ("a" * 3000, "ab" * 2000, "".join(draw.choices("etaoins", k=4000)), "".join(draw.choices("etaoinß日", k=3000)), "=" * 50_000):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode(text)


def test_memory_of_words_is_bounded(reference):
    small = Encoder(PieceModel.load(PATH), cache_bytes=2000)
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(20))
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == reference.encode(text)
        assert small.held < 20_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abrtls \néß.,1") | st.characters(), max_size=30), max_size=5))
def test_any_text(texts):
    e = test_any_text.__dict__.setdefault("e", Encoder(PieceModel.load(PATH)))
    r = test_any_text.__dict__.setdefault("r", sentencepiece.SentencePieceProcessor(model_file=PATH))
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == r.encode(text)


def test_plain_viterbi_is_the_best_path(encoder):
    """Without the rule of merges the search must find the greatest sum of scores."""
    m = PieceModel.load(PATH)
    m.merges = False
    m.score = -np.log2(np.arange(2, len(m.score) + 2))
    by_name = {int(k): i for i, k in enumerate(m.keys.tolist())}
    from tessera.llm.pieces import _hash

    for word in ("thing", "there", "other"):
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        best = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                row = by_name.get(_hash(points[s:e]))
                if row is not None:
                    best[e] = max(best[e], best[s] + m.score[row])
        rows, _ = m.viterbi([word])
        assert m.score[rows].sum() == pytest.approx(best[-1])


def test_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5)], "doc_id long, text string, ids int")
    rows = encode_documents(df, keep=("doc_id", "ids")).collect()
    assert sorted(r["n_ids"] for r in rows) == [0, 0, 2]
    assert all(r["round_trip"] for r in rows)
    assert encode_documents(df.limit(0)).count() == 0


def test_whole_table(spark, sf, reference):
    got = op10_pieces(spark, sf)
    want = {r["doc_id"]: reference.encode(r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        ids = np.array(want[r["doc_id"]], "<u4").tobytes()
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids))
    assert got.where("not round_trip").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
