import random

from tessera.llm.line_dedup import boundaries, op7_line_dedup, remove_repeats


def lines(rng, n):
    return [f"line {rng.randrange(10**9)} of words" for _ in range(n)]


def chunks(text):
    ls, out, last = (text or "").split("\n"), [], 0
    for end in boundaries(ls):
        out.append(ls[last:end])
        last = end
    return out


def passage(part):
    full = sum(1 for x in part if x.strip())
    return full >= 2 or (full == 1 and max(len(x.split(" ")) for x in part) >= 50)


def expected(docs):
    """Plain passes over all texts, the least doc_id first."""
    seen, out = set(), {}
    for i in sorted(docs):
        left, gone = [], 0
        for part in chunks(docs[i]):
            key = "\n".join(part)
            if passage(part) and key in seen:
                gone += 1
                continue
            if passage(part):
                seen.add(key)
            left += part
        out[i] = ("\n".join(left) if gone else docs[i], gone)
    return out


def test_boundaries_move_with_the_content():
    rng = random.Random(5)
    body = lines(rng, 60)
    ends = boundaries(body)
    moved = boundaries(lines(rng, 3) + body)
    assert {e + 3 for e in ends if e > 4} <= set(moved)
    assert ends[-1] == 60 and boundaries([""]) == [1]


def test_long_line_stands_alone():
    long = " ".join(f"w{i}" for i in range(60))
    ends = boundaries(["a", long, "b"])
    assert 1 in ends and 2 in ends


def test_equals_plain_passes(spark):
    rng = random.Random(7)
    shared = [lines(rng, 6) for _ in range(4)] + [[" ".join(f"w{k}" for k in range(70))]]
    docs = {}
    for i in range(40):
        body = lines(rng, 3) + rng.choice(shared) + lines(rng, 4)
        docs[i] = "\n".join(body)
    docs |= {100: None, 101: "", 102: docs[5], 103: "\n\n\n", 104: "one\r\ntwo"}
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs.items()], "doc_id long, text string, source string, removed_lines int")
    got = {r["doc_id"]: (r["text"], r["removed_chunks"]) for r in remove_repeats(df).collect()}
    assert got == expected(docs)
    assert got[102][1] > 0 and len(got[102][0]) < len(docs[102])


def test_nulls_and_repeats(spark):
    two = "first line here\nsecond line here"
    df = spark.createDataFrame([(None, two), (3, two), (3, two), (9, two)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in remove_repeats(df).collect())
    assert got[0] == (0, two) and got[1] == got[2] == (3, two)
    assert remove_repeats(df.limit(0)).count() == 0


def test_one_id_two_texts(spark):
    a, b = "first line here\nsecond line here", "other line here\nanother line here\nlast"
    df = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(r["text"] for r in remove_repeats(df).collect()) == sorted([a, "", b])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    want = expected(dict(zip(docs.doc_id, docs.text)))
    got = {r["doc_id"]: r["removed_chunks"] for r in op7_line_dedup(spark, sf).collect()}
    assert got == {i: gone for i, (_, gone) in want.items()}
