import hashlib

import numpy as np
import pytest

from tessera.llm.sharding import SHARDS, SLOTS, lookup_table, op3_sharding, place


def test_shares_and_moves():
    a = lookup_table([f"s{i}" for i in range(10)], 1009)
    b = lookup_table([f"s{i}" for i in range(9)], 1009)
    assert np.ptp(np.bincount(a)) <= 1
    assert (a[a < 9] != b[a < 9]).mean() < 0.35


def test_brute_force_table():
    names, m = ["x", "y", "z"], 13
    number = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
    order = [[(number(f"{s}/offset") + k * (number(f"{s}/skip") % (m - 1) + 1)) % m for k in range(m)] for s in names]
    owner: dict[int, int] = {}
    while len(owner) < m:
        for i in range(3):
            free = [p for p in order[i] if p not in owner]
            if free:
                owner[free[0]] = i
    assert lookup_table(names, m).tolist() == [owner[k] for k in range(m)]


def test_bad_parameters():
    for shards, slots in ((["a"], 10), ([], 11), (["a", "a"], 11)):
        with pytest.raises(ValueError):
            lookup_table(shards, slots)


def test_null_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "doc_id long, shard string")
    rows = place(df).collect()
    assert len(rows) == 4
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 == len({r["slot"] for r in rows if r["doc_id"] == 1})
    assert place(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    got, owner = op3_sharding(spark, sf).toPandas(), lookup_table()
    for r in got.head(50).itertuples():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SLOTS
        assert (r.slot, r.shard) == (slot, SHARDS[owner[slot]])
