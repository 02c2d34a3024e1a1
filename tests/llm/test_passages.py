import hashlib
import random
import re

import numpy as np
import pytest

from tests.test_queries import canon
from tessera.llm import passages
from tessera.llm.oracles import PASSAGES
from tessera.llm.passages import _first_least, extend, op11_passages, remove_passages_between

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """Every window of every text, the least doc_id first; (doc_id, text) -> kept and count."""
    first = {}
    for i, text in docs:
        words = WORD.findall(text or "")
        for s in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def ran(spark, docs, window, seed):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in docs], "doc_id long, text string, `h` string, `kept.spans` array<int>")
    rows = remove_passages_between(df, window, seed).collect()
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))  # maximal: no two touch
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows], key=str)


def test_first_least_is_the_leftmost():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 31):
        want = [s + int(np.argmin(x[s : s + width])) for s in range(len(x) - width + 1)]
        assert _first_least(x, width).tolist() == want


def test_extend_splits_what_the_first_does_not_decide():
    own = ([b"c", b"b", b"x"], [b"s", b"t", b"u", b"v"])
    first = ([b"c", b"b", b"a"], [b"s", b"t", b"u", b"w"])
    least, most, rest = extend(5, 2, 3, own, first, 6)
    assert (least, most) == (3, 2)  # no window of six words is in both: two to the left, three to the right
    assert [(a, b) for _, a, b in rest] == [(3, 3), (2, 2)] and len({k for k, _, _ in rest}) == 2
    assert extend(5, 2, 3, own, own, 6) == (2, 3, [])


@pytest.mark.parametrize("seed, rounds", [(0, 5), (1, 0), (2, 1)])
def test_equals_every_window(spark, seed, rounds, monkeypatch):
    monkeypatch.setattr(passages, "ROUNDS", rounds)
    rng = random.Random(seed)
    words = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared = [words(rng.randrange(8, 40), 50) for _ in range(5)]
    docs = []
    for i in range(60):
        body = words(rng.randrange(0, 12), 6)
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            body += p[a : a + rng.randrange(6, 40)] + words(rng.randrange(0, 5), 6)
        docs.append((rng.randrange(50), rng.choice([" ", "\n", " \t "]).join(body)))
    docs += [(200 + k, " ".join(["the"] * n)) for k, n in enumerate((10, 11, 12, 40, 300))]
    docs += [(300, None), (301, ""), (302, " \n"), (None, docs[3][1]), (303, docs[3][1]), (303, docs[3][1]), (303, docs[5][1])]
    docs += [(-4, "a" * 5000 + " " + " ".join(shared[0])), (7, "é ü " * 12), (8, "é ü " * 15)]
    assert ran(spark, docs, 10, 4) == brute(docs, 10)


def test_windows_are_judged_on_the_input(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    docs = [(1, " ".join(a)), (2, " ".join(a + b)), (3, " ".join(a[6:] + b))]
    got = {r[0]: r[2:] for r in ran(spark, docs, 10, 4)}
    assert got[2] == (12, " ".join(b)) and got[3] == (18, "")


def test_hot_group_and_empty_table(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(14)]
    docs = [(i, " ".join([f"q{rng.randrange(3)}" for _ in range(5)] + passage + [f"q{rng.randrange(3)}" for _ in range(5)])) for i in range(300)]
    assert ran(spark, docs, 10, 4) == brute(docs, 10)
    assert ran(spark, [], 10, 4) == []


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs, 50)}
    assert {r[0]: tuple(r[1:]) for r in op11_passages(spark, sf).collect()} == want


def test_sql(spark, sf, duck):
    got, want = canon(op11_passages(spark, sf).toPandas()), canon(duck.sql(PASSAGES).df())
    assert got.equals(want)
