import random

import corpus_pipeline as P
from tessera.llm.line_dedup import op7_line_dedup, remove_passages
from tessera.llm.common import table


def in_repeated_runs(docs):
    """For every document its lines in a run of 50 words or more that an earlier place has, by growing all pairs of equal lines."""
    places, out = {}, {}
    for i in sorted(docs):
        ls = (docs[i] or "").split("\n")
        gone = set()
        for a, line in enumerate(ls):
            if not line.strip():
                continue
            for j, b in places.get(line, ()):
                other = ls if j == i else docs[j].split("\n")
                most = min(len(ls) - a, len(other) - b, a - b if j == i else len(ls))
                n = 0
                while n < most and ls[a + n] == other[b + n]:
                    n += 1
                while n and not ls[a + n - 1].strip():
                    n -= 1
                if sum(len(x.split()) for x in ls[a : a + n]) >= 50:
                    gone |= set(range(a, a + n))
            places.setdefault(line, []).append((i, a))
        out[i] = gone
    return out


def kept(text, gone):
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_whole_passages_go_wherever_chunks_end(spark):
    rng = random.Random(11)
    some = lambda n: [" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(n)]
    shared = [some(n) for n in (2, 3, 4, 6) for _ in range(4)]
    docs = {i: "\n".join(some(3) + shared[i % 16] + some(3)) for i in range(48)}
    got = {r["doc_id"]: r["text"] for r in remove_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = in_repeated_runs(docs)
    assert all(len(want[i]) == len(shared[i % 16]) for i in range(16, 48))
    assert got == {i: kept(t, want[i]) for i, t in docs.items()}


def test_small_texts_against_all_pairs(spark):
    """Few lines of few kinds: overlaps in one document, blank lines, runs just below and at 50 words."""
    rng = random.Random(3)
    kinds = ["", " ", *(" ".join(f"{k}{w}" for k in range(w)) for w in (5, 12, 24, 25, 26, 49, 50))]
    docs = {i: "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 12))) for i in range(150)}
    got = {r["doc_id"]: r["text"].split("\n") for r in remove_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = in_repeated_runs(docs)
    assert sum(map(len, want.values())) > 100
    for i, t in docs.items():
        # Chunks of several short lines may go besides, so what is left is part of what the runs leave.
        rest = iter(kept(t, want[i]).split("\n"))
        assert got[i] == [""] or all(x in rest for x in got[i])


def test_repeated_runs_equal_all_pairs(spark):
    from tessera.llm.line_dedup import repeated_runs

    rng = random.Random(4)
    kinds = ["", " ", *(" ".join(f"{k}{w}" for k in range(w)) for w in (5, 12, 24, 25, 26, 49, 50))]
    docs = {i: "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 12))) for i in range(150)}
    got = {i: set() for i in docs}
    for r in repeated_runs(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert got == in_repeated_runs(docs)


def test_query_leaves_no_repeated_run(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    want = in_repeated_runs(docs)
    got = {r["doc_id"]: r for r in op7_line_dedup(spark, sf).collect()}
    assert any(want.values())
    assert all(got[i]["removed_lines"] >= len(gone) for i, gone in want.items())


def test_stage_recounts_characters(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(i, f"first {i}\n{a}\n{b}\nlast {i}", "en", "s", 999) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(P.drop_repeated_lines(spark, docs, "").collect())
    assert got[0]["text"] == rows[0][1]
    assert [(r["text"], r["n_chars"]) for r in got[1:]] == [(t := f"first {i}\nlast {i}", len(t)) for i in range(1, 6)]
