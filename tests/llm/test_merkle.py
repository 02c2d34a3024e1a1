import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.test_queries import canon
from tessera.llm.common import id_crc
from tessera.llm.merkle import START, as_hex, compress, finish, manifest, numbered, op13_merkle, proof
from tessera.llm.oracles import MERKLE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        head = i // 3 * 3
        out.append(("".join(level[head:i]), "".join(level[i + 1 : head + 3])))
        i //= 3
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> what the query returns, sorted."""
    leaf = lambda r: sha("".join(field(v) for v in r))
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, at)
            crc = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            now = leaf((*r[:4], r[4].replace("\n", ""))) if crc % 2 == 0 and r[4] is not None else leaf(r)
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


def ran(df):
    text = lambda c: F.lower(F.hex(c))
    got = manifest(df, id_crc() % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    got = got.select("doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(proof(F.col("path")), 256), text("folded"), "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_states_resume():
    rng = np.random.default_rng(1)
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(3)]
    words = [np.frombuffer(d, ">u4").astype(np.uint32)[None, :] for d in digests]
    state = START[None, :]
    for n, w in enumerate(words, 1):
        state = compress(state, as_hex(w))
        want = hashlib.sha256("".join(d.hex() for d in digests[:n]).encode()).digest()
        assert finish(state, np.array([n])).astype(">u4").tobytes() == want
    many = rng.integers(0, 2**32, (50, 8), dtype=np.uint64).astype(np.uint32)
    assert [as_hex(many)[i].astype(">u4").tobytes().decode() for i in range(50)] == [m.astype(">u4").tobytes().hex() for m in many]


def test_numbered_without_a_task_per_group(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k // 2, k) for k in range(500)], "grp string, v long, k long").repartition(7)
    got = numbered(df, ["v"]).collect()
    for g in "ab":
        rows = sorted((r["pos"], r["v"], r["n"]) for r in got if r["grp"] == g)
        assert [r[0] for r in rows] == list(range(len(rows))) and {r[2] for r in rows} == {len(rows)}
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_equals_plain_trees(spark):
    rng = random.Random(2)
    kinds = [None, "", "a", "b", "é", "zz"]
    rows = [(k, rng.choice(kinds[2:]), rng.choice([None, "en"]), rng.choice([None, k]), rng.choice(["x\ny", "one", "", None, "ü\n" * 50])) for k in range(150)]
    rows += [(1000, None, "en", 1, "lone\n"), (1001, "", None, None, None), (1002, "single", None, 0, "\n" * 3)]
    rows += [(None, "a", "en", 3, "no id\n"), (5, "a", "en", 1, "again\n"), (5, "a", "en", 1, "again\n"), (2000, "b", "en", 9, "long\n" * 40_000)]
    # One group beyond one block of 729 leaves, and beyond the powers of three around it.
    rows += [(10_000 + k, "big", "en", 2, f"t{k}\n") for k in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("grp", F.lit(1)).withColumn("path", F.lit("p")).withColumn("a.b", F.lit(2))
    assert ran(df) == brute(rows)


def test_small_and_empty(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(2, "s", "en", 4, "text")]
    (got,) = ran(spark.createDataFrame(one, kind))
    assert got[1] == got[2] == got[3] == got[5] and got[4] == sha("") and got[6]
    assert ran(spark.createDataFrame([], kind)) == []
    rows = [(k, f"s{n}", None, None, "a\nb") for n in (2, 3, 4, 9, 10, 28) for k in range(n)]
    assert ran(spark.createDataFrame(rows, kind)) == brute(rows)


def test_only_changed_documents_fail(spark, sf):
    got = op13_merkle(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (docs[r["doc_id"]] or "")
        assert r["verified"] is not changed


def test_sql(spark, sf, duck):
    got, want = canon(op13_merkle(spark, sf).toPandas()), canon(duck.sql(MERKLE).df())
    assert got.equals(want)
