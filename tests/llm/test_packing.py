import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import ByteBpe, best_fit_decreasing, op1_packing, pack

ROWS = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (5, "  odd\n\n\t spaces é中 "), (6, "a <|endoftext|> b")]


JSON = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
OURS = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, JSON)


@pytest.fixture(scope="module")
def reference():
    return LIBRARY


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text() | st.sampled_from(["<|endoftext|>", "<|endof", " ", "\n\n", "word", "\u3000"]), max_size=8).map("".join))
def test_ids_equal_the_tokenizers_library(text):
    assert np.frombuffer(OURS.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_best_fit_is_the_plain_algorithm(lengths):
    where, offset = best_fit_decreasing(np.array(lengths), 64)
    free: dict[int, int] = {}
    for i in np.argsort(-np.array(lengths), kind="stable").tolist():
        fits = [f for f in free.values() if f >= lengths[i]]
        room = free.get(int(where[i]), 64)
        assert room == (min(fits) if fits else 64)
        assert offset[i] == 64 - room
        free[int(where[i])] = room - lengths[i]


def check(rows, docs, reference):
    want = {}
    for name, text in docs:
        want.setdefault(name, []).append(reference.encode(text or "", add_special_tokens=False).ids + [1])
    by_seq: dict[int, list] = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        assert any(ids == w[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(w) for w in want[r["doc_id"]])
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum(len(w) for ws in want.values() for w in ws)


def test_edge_cases_round_trip(spark, reference):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id long, text string, length int")
    check(pack(df, block_tokens=3000).collect(), ROWS, reference)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf, reference):
    got = op1_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.doc_id.nunique() == docs.count()
    total = got.groupby("doc_id").length.sum()
    assert (total == got.groupby("doc_id").doc_tokens.first()).all()
    per = got.groupby("sequence_id").length.sum()
    assert per.sum() / (2048 * len(per)) > 0.9
