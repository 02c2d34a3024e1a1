import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.test_queries import canon
from tessera.llm.negatives import Packed, integer_vectors, mine, op12_hard_negatives
from tessera.llm.oracles import NEGATIVES

KIND = "vec_id long, label int, embedding array<double>, `raw.x` string, dims int"


def brute(rows, positives, negatives, low, high):
    """rows: (vec_id, label, integers); every tenth row asks."""
    out = []
    for i, label, v in rows:
        if i % 10:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i and len(w) == len(v)))
        for score, positive, _ in [s for s in scores if s[2] == label][:positives]:
            p = -score
            fit = [(-s, j) for s, j, other in scores if other != label and low * p <= -s * 100 <= high * p][:negatives]
            out += [(i, positive, k + 1, j, p, n) for k, (n, j) in enumerate(fit)]
    return sorted(out)


def floored(rows):
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]


def ran(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    return sorted(tuple(r) for r in mine(integer_vectors(df), F.col("vec_id") % 10 == 0, **bounds).collect())


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (1, 300, 40_000, 2**20, 2**28):
        rows = rng.integers(-most, most + 1, (37, 9)).astype(float)
        anchors = rng.integers(-most, most + 1, (5, 9)).astype(float)
        packed = Packed(rows, int(np.abs(anchors).max()))
        for a in anchors:
            assert packed.scores(a).tolist() == [sum(int(x) * int(y) for x, y in zip(a, r)) for r in rows]
    assert Packed(np.zeros((2, 3)), 0).scores(np.zeros(3)).tolist() == [0, 0]


def test_wide_components():
    rows = np.array([[1e25, -3.0], [-1e25, 5.0], [0.0, 7.0]])
    packed = Packed(rows, int(1e20))
    assert packed.scores(np.array([0.0, 2.0])).tolist() == [-6, 10, 14]
    assert packed.scores(np.array([1e20, 1.0])).tolist() == [2**63 - 1, -(2**63 - 1), 7]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(3), [x + rng.uniform(-0.4, 0.4) for x in rng.choice(base)]) for i in range(120)]
    rows += [(200 + k, k % 3, rows[10][2]) for k in range(6)]  # ties
    want = brute(floored(rows), 5, 3, 50, 95)
    assert want and ran(spark, rows) == want
    assert ran(spark, rows, positives=2, negatives=9, low=20, high=100) == brute(floored(rows), 2, 9, 20, 100)


def test_rows_that_take_no_part(spark):
    good = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.4, 0.3]), (3, 2, [0.45, 0.4])]
    want = brute(floored(good), 5, 3, 50, 95)
    bad = [(None, 1, [0.5, 0.5]), (4, None, [0.5, 0.5]), (5, 1, None), (6, 2, [None, 0.4]), (7, 2, [float("nan"), 0.4]), (8, 2, [float("inf"), 0.1]), (9, 2, [1e308, 0.1])]
    assert want and ran(spark, good + bad) == want
    # Another length is never compared, repeats of a vec_id are one row, empty vectors score 0.
    assert ran(spark, good + [(11, 2, [0.4, 0.3, 0.1]), (2, 2, [0.4, 0.3]), (2, 2, [0.9, 0.9])]) == want
    assert ran(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
    assert ran(spark, []) == []


def test_sql(spark, sf, duck):
    got, want = canon(op12_hard_negatives(spark, sf).toPandas()), canon(duck.sql(NEGATIVES).df())
    assert len(got) > 50 and got.equals(want)
