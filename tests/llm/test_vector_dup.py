import numpy as np

from tessera.llm.vector_dup import close_pairs, link_vectors, op6_vector_dup, rotation


def brute(rows, cosine=0.93):
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and len(v) and not any(c is None for c in v):
            x = np.array(v, float)
            if np.isfinite(x).all() and (x != 0).any():
                good[i] = (x / np.linalg.norm(x), label)
    links = {i: [j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= cosine] for i in good}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), None if i is None else min(seen))
    return out


def near(rng, v, eps):
    return (v + eps * rng.normal(size=len(v))).tolist()


def test_close_pairs_is_exact():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 40))
    x = np.concatenate([b + 0.3 * rng.normal(size=(30, 40)) for b in base])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(180) for j in range(i + 1, 180) if u[i] @ u[j] >= 0.9}
    i, j = close_pairs(x, x, rotation(x), 0.9, True)
    assert set(zip(i.tolist(), j.tolist())) == want
    i, j = close_pairs(x[:90], x[90:], np.eye(40), 0.9, False)
    assert {(a, b + 90) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in want if a < 90 <= b}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(6):
            v = rng.normal(size=8)
            for _ in range(12):
                rows.append((n, near(rng, v, 0.25), label))
                n += 1
    rows += [(n + k, rows[3][1], 0) for k in range(5)]
    n += 5
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [None] + [1.0] * 7, 0), (n + 3, [float("nan")] * 8, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, dims string")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(df, block=7).collect()}
    assert got == want
    assert link_vectors(df.limit(0)).count() == 0


def test_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df).collect()}
    assert got == {None: (0, None, None), 4: (0, 4, True)}


def test_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op6_vector_dup(spark, sf).collect()} == brute(rows)
