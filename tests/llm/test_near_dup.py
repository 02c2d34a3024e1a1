import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.near_dup import keep_one, near_duplicates, op4_near_dup, prob_minhash, probability_jaccard, shingles, _packed, unpacked


def counted(text):
    w = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []))


def jaccard(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def classes(texts, least=0.8):
    """Brute force over all pairs."""
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, ids = {i: counted(t) for i, t in texts.items()}, sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            same = (texts[i] or "") == (texts[j] or "")
            if same or (sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) and jaccard(sets[i], sets[j]) >= least):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def prose(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


def test_shingles_equal_plain_counts():
    rng = random.Random(1)
    texts = [" ".join(prose(rng, 30)), "a b c d e a b c d e a b", "One two", "", None, "é!x y,z w v u", "x" * 10]
    doc, key, times = shingles(pa.array(texts))
    for k, t in enumerate(texts):
        assert sorted(times[doc == k].tolist()) == sorted(counted(t).values())
        assert len(set(key[doc == k].tolist())) == len(counted(t))


def test_sketch_estimates_probability_jaccard():
    a = {i: w for i, w in zip(range(60), [1, 2, 5] * 20)}
    b = {i: w for i, w in zip(range(20, 90), [1, 1, 4, 2, 3] * 14)}
    doc = np.array([0] * len(a) + [1] * len(b))
    key = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = prob_minhash(doc, key, np.array([*a.values(), *b.values()]), 2, 4096)
    exact = jaccard(Counter(a), Counter(b))
    assert abs((s[0] == s[1]).mean() - exact) < 0.04
    pack = lambda d: unpacked(_packed(np.array(sorted(d), "<u4"), np.array([d[k] for k in sorted(d)])))
    assert probability_jaccard(pack(a), pack(b)) == pytest.approx(exact)


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(12):
        base = prose(rng, rng.choice([40, 120]))
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(9))
            texts[n] = " ".join(copy)
            n += 1
    texts |= {n: None, n + 1: "", n + 2: "just two", n + 3: "just two", n + 4: "just three"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df, block=3).collect()}
    assert got == classes(texts)


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in near_duplicates(df).collect()} == {(1, 1)}
    assert keep_one(df).count() == 3
    assert near_duplicates(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: r["class_id"] for r in op4_near_dup(spark, sf).collect()}
    assert got == classes(dict(zip(docs.doc_id, docs.text)))
