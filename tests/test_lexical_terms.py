"""The lexical pool deals out only postings of the queries' words."""

from __future__ import annotations

from sieveline.operators import retrieval as ret


def test_scores_by_query_words_only_equal_those_by_the_whole_index(spark):
    texts = [(1, "alpha beta beta gamma"), (2, "Alpha delta"), (3, "epsilon " * 50), (4, None), (5, "—"), (6, "beta zeta eta theta")]
    docs = spark.createDataFrame(texts, "id long, text string")
    q = spark.createDataFrame([(10, "alpha"), (10, "beta"), (20, "zeta"), (20, "nowhere")], "query_id long, term string")
    mine = ret.postings(docs, terms=q)
    assert {r.term for r in mine.collect()} == {"alpha", "beta", "zeta"}
    assert {(r.id, r.dl) for r in ret.lengths(docs).collect()} == {(1, 4), (2, 2), (3, 50), (6, 4)}
    want = {(r.query_id, r.id): r.score for r in ret.bm25(ret.postings(docs), q).collect()}
    assert want and want == {(r.query_id, r.id): r.score for r in ret.bm25(mine, q, sizes=ret.lengths(docs)).collect()}


def test_vectors_in_steps(spark):
    """Queries taken a few at a time find what they find at once; a task holds no scores of a whole block."""
    import random

    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    found = [sorted(map(tuple, ret.vector_search(v, v.where("id % 3 = 0"), 5, step=n).select("query_id", "id", "score", "rank").collect())) for n in (3, 1024)]
    assert found[0] and found[0] == found[1]


def test_texts_are_read_once_and_postings_dealt_once(spark):
    """Scores come from the postings and lengths that were written, and the postings meet the lengths and add up in one exchange by document."""
    docs = spark.createDataFrame([(i, f"alpha w{i} beta w{i % 3} " * (1 + i % 4)) for i in range(40)], "id long, text string")
    q = spark.createDataFrame([(10, "alpha"), (10, "w1"), (20, "w2"), (20, "nowhere")], "query_id long, term string")
    out = ret.bm25(ret.postings(docs, terms=q), q, sizes=ret.lengths(docs))
    assert {f.split("/sieveline/")[1].split("-")[0] for f in out.inputFiles()} == {"sizes", "postings", "asked"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    assert len({(r.query_id, r.id) for r in out.collect()}) == out.count() >= 40


def test_lines_are_hashed_once(spark, sf):
    """The vectors of lines are written before the search, which counts and compares them: no text is hashed twice."""
    from sieveline.plans import QUERIES

    found = {f.split("/")[-2].split("-")[0] for f in QUERIES["passage_vectors"](spark, sf).inputFiles()}
    assert found == {"vectors"}
