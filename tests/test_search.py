"""Search with filters and fuzzy titles, an index kept up to date, passages."""

from pyspark.sql import functions as F

from tessera.operators import search as S

ROWS = "id string, kind string, title string, body string, boost double, updated long, workspace string, project string"
ASKED = "query_id int, query string, kinds array<string>, workspace string, project string"
CORPUS = [
    ("a", "document", "Payment retries", "how the queue retries a payment", 1.0, 5, "w1", "p"),
    ("b", "document", "Notes", "payment payment payment and retries", 1.0, 9, "w1", "q"),
    ("c", "file", "src/queue.ts", "queue", 1.0, 1, "w2", None),
    ("d", "workflow", "Workflows", "nothing here", 2.0, 1, "w1", None),
    ("e", "file", "same", "alpha", None, 3, "w1", None),
    ("f", "file", "same", "alpha", 1.0, 4, "w1", None),
    ("g", "file", None, None, 1.0, None, None, None),
]


def hits(spark, queries, corpus=CORPUS, index=None, **more):
    rows = spark.createDataFrame(corpus, ROWS)
    index = index or S.build(rows.select("id", "title", "body"))
    got = S.search(index, rows, spark.createDataFrame(queries, ASKED), **more).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.id, r.matched) for r in got]


def test_title_outranks_body_and_filters_come_after(spark):
    asked = [(1, "payment", None, None, None), (2, "payment", ["file"], None, None), (3, "queue", None, "w2", None), (4, "payment", None, None, "q"), (5, "the of", None, None, None), (6, "", None, None, None)]
    got = hits(spark, asked, fuzzy=False)
    assert got == [(1, "a", ["payment"]), (1, "b", ["payment"]), (3, "c", ["queue"]), (4, "b", ["payment"])]


def test_weights_are_those_of_the_whole_corpus(spark):
    rows = spark.createDataFrame(CORPUS, ROWS)
    index = S.build(rows.select("id", "title", "body"))
    score = lambda w: {r.id: r.score for r in S.search(index, rows, spark.createDataFrame([(1, "payment retries", None, w, None)], ASKED), fuzzy=False).collect()}
    assert score("w1") == score(None)


def test_fuzzy_titles(spark):
    asked = [(1, "wkflw", None, None, None), (2, "w", None, None, None), (3, "zzz", None, None, None), (4, "src queue", ["file"], None, None)]
    got = hits(spark, asked)
    assert [h[:2] for h in got] == [(1, "d"), (4, "c")] and got[0][2] == []
    assert hits(spark, asked, fuzzy=False)[0][:2] == (4, "c")


def test_ties_go_to_the_latest_update(spark):
    assert [h[1] for h in hits(spark, [(1, "alpha", None, None, None)], fuzzy=False)] == ["f", "e"]


def test_kept_index_equals_a_new_one(spark):
    rows = spark.createDataFrame(CORPUS, ROWS)
    old = S.build(spark.createDataFrame([("a", "Old", "gone words"), ("c", "src/queue.ts", "queue"), ("z", "Payment", "payment")], "id string, title string, body string"))
    index = S.updated(old, rows.where("id <> 'c'").select("id", "title", "body"), spark.createDataFrame([("z",)], "id string"))
    asked = [(1, "payment retries", None, None, None), (2, "queue", None, None, None), (3, "gone", None, None, None)]
    assert hits(spark, asked, index=index) == hits(spark, asked) and index.docs == len(CORPUS)


def test_empty_corpus(spark):
    assert hits(spark, [(1, "payment", None, None, None)], corpus=[]) == []


SAID = "group int, turn int, source string, text string"


def test_passages(spark):
    text = "Short one.\n\nThe first sentence is long enough. And the second one is as well! but this goes on here.\n\n\n- a list of things\n- stays one passage. Whole\n\nA table | of cells | is whole. Too it is"
    got = S.passages(spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "system", None), (2, 0, "tool", "")], SAID)).orderBy("place").collect()
    assert [(r.place, r.passage) for r in got] == [
        (0, "The first sentence is long enough."), (1, "And the second one is as well! but this goes on here."), (2, "- a list of things\n- stays one passage. Whole"), (3, "A table | of cells | is whole. Too it is"),
    ]


def test_passages_rank_within_their_group(spark):
    said = [(1, 0, "assistant", "Apples are red and round fruits. Pears are green and long fruits. Nothing else is to be said here."), (2, 0, "assistant", "Apples and apples and more apples again. Another sentence without the word.")]
    parts = S.passages(spark.createDataFrame(said, SAID))
    questions = spark.createDataFrame([(1, "apples and bananas"), (2, "unrelated words"), (3, "no context")], "group int, question string")
    got = [(r.group, r.rank, r.place, r.score > 0) for r in S.rank_passages(parts, questions).orderBy("group", "rank").collect()]
    assert got == [(1, 1, 0, True), (2, 1, 0, False), (2, 2, 1, False)]
    missing = {r.group: r.missing for r in S.uncovered(S.rank_passages(parts, questions).select("group", "passage"), questions).collect()}
    assert missing == {1: ["bananas"], 2: ["unrelated", "words"], 3: ["no", "context"]}


def test_corpus_of_unlike_tables(spark):
    a = spark.createDataFrame([(k, f"t{k}", "w", k) for k in range(5)], "id int, title string, workspace string, updated int")
    b = spark.createDataFrame([("x", "title", "body " * 10, "w", "p")], "id string, title string, body string, workspace string, project string")
    got = S.corpus_of([("a", a, 1.5, 2), ("b", b, 1.0, 9)], body=7).orderBy("id").collect()
    assert [(r.id, r.boost, r.updated, r.body, r.project) for r in got] == [("a:3", 1.5, 3, "", None), ("a:4", 1.5, 4, "", None), ("b:x", 1.0, None, "body bo", "p")]


def test_letters_nominate_only_possible_titles(spark):
    titles = spark.createDataFrame([("1", "abc"), ("2", "acb"), ("3", "a b c"), ("4", "ab")], "id string, title string")
    asked = spark.createDataFrame([(1, "A c"), (2, "b"), (3, "abcabc")], "query_id int, query string")
    got = S.fuzzy_titles(S.title_letters(titles), asked).select("query_id", "id").collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, "1"), (1, "2"), (1, "3")]
    assert S.fuzzy_titles(S.title_letters(titles), asked).where(F.col("fuzzy") <= 0).count() == 0
