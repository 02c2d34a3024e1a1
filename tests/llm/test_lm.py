import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.llm.lm import LogBilinear, op5_lm, score


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def base(docs, learn):
    c = Counter(w for i, t in docs for w in tokens(t) if learn(i))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for _, t in docs]


def test_probabilities_sum_to_one():
    noise = np.arange(1, 21) / 210
    m = LogBilinear(noise)
    before = np.array([[3] * 20, [4] * 20])
    assert np.exp(m.log_probs(before, np.arange(20))).sum() == pytest.approx(1, abs=1e-5)


def test_small_and_odd_texts(spark):
    docs = [(1, "The cat\tsat"), (2, None), (3, ""), (4, "the THE éa x y"), (4, "the dog"), (5, "word " * 30000)]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, n_tokens int")
    got = score(df, F.col("doc_id") < 4, model_words=2, head_words=3)
    n, want = base(docs, lambda i: i < 4)
    rows = got.collect()
    assert {r["train_tokens"] for r in rows} == {n}
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == sorted((a, b, round(float(c), 6)) for a, b, c in want)
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = score(df, F.lit(False)).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0)
    assert score(df.limit(0), F.lit(True)).count() == 0


def test_base_and_gain_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r["doc_id"], r["text"]) for r in docs]
    n, want = base(docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = op5_lm(spark, sf).toPandas().set_index("doc_id")
    for (i, _), (a, b, c) in zip(docs, want):
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n)
        assert r.base_score == pytest.approx(float(c), rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def bigram(docs, learn):
    """log10 of held-out texts under a Witten-Bell bigram over the add-one unigram."""
    one, two, follows, seen = Counter(), Counter(), Counter(), Counter()
    for i, t in docs:
        if learn(i):
            words = tokens(t)
            one.update(words)
            for a, b in zip(["<s>", *words], words):
                follows[a] += (a, b) not in two
                two[a, b] += 1
                seen[a] += 1
    n, v = sum(one.values()), len(one)
    total = 0.0
    for i, t in docs:
        if not learn(i):
            words = tokens(t)
            for a, b in zip(["<s>", *words], words):
                p = (one[b] + 1) / (n + v + 1)
                total += np.log10((two[a, b] + follows[a] * p) / (seen[a] + follows[a]) if seen[a] else p)
    return total


def test_half_of_a_bigrams_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    best = bigram([(r["doc_id"], r["text"]) for r in rows], lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    base, own = op5_lm(spark, sf).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert own - base > 0.5 * (best - base)


def test_the_model_does_not_depend_on_how_files_are_split(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = score(docs.coalesce(1), F.col("doc_id") % 3 > 0).toPandas().set_index("doc_id").score
    many = score(docs.repartition(9), F.col("doc_id") % 3 > 0).toPandas().set_index("doc_id").score
    assert np.allclose(one.sort_index(), many.sort_index(), rtol=1e-3)


def test_scores_by_plain_softmax(spark, monkeypatch):
    """Every token's probability worked out one by one from the model's parameters."""
    kept = {}

    def fixed(docs, lexicon, noise, *rest):
        kept["m"] = LogBilinear(noise, seed=5)
        kept["m"].params["T"] *= 20
        return kept["m"]

    monkeypatch.setattr(lm, "train", fixed)
    docs = [(1, "the cat sat on the mat"), (2, "a cat ate the rat"), (3, "the bat é"), (4, "unseen cat"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score(df, F.col("doc_id") < 4, model_words=2, head_words=4, buckets=3).collect()}
    c = Counter(w for i, t in docs if i < 4 for w in tokens(t))
    top = sorted((w for w in c if w), key=lambda w: (-c[w], w))[:2]

    def bucket(w):
        raw = w.encode()
        return (((raw[-2] if len(raw) > 1 else 0) * 256 + raw[-1]) * 40_503 % 65_536 * 3) >> 16

    def name(w):
        return 1 if w is None else 2 + top.index(w) if w in top else 4 + bucket(w)

    p = kept["m"].params
    for i, t in docs:
        total, before = 0.0, [0, 0]
        for w in tokens(t):
            q = sum(p["R"][before[k]] @ p["C"][k] for k in range(2))
            s = np.exp((p["T"] @ q + p["b"]).astype(float))
            total += np.log10(s[name(w)] / s.sum())
            if name(w) >= 4:
                own = [x for x in c if x and name(x) == name(w)]
                total += np.log10((c[w] + 1) / (sum(c[x] for x in own) + len(own) + 1))
            before = [name(w), before[0]]
        assert got[i] == pytest.approx(total, rel=1e-5)
