"""The stored index against plain BM25: hits, what is read, what a replacement rewrites."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from sieveline.operators import index
from sieveline.operators import retrieval as ret

rnd = random.Random(6)
VOCABULARY = [f"w{i}" for i in range(400)]


def texts(a, b):
    out = []
    for i in range(a, b):
        n = rnd.choice([0, 1, 3, 8, 20, 20, 60])
        words = [VOCABULARY[min(399, int(rnd.expovariate(1 / 40)))] for _ in range(n)] + ["rare"] * (i % 97 == 0) + ["common"] * rnd.randrange(3)
        out.append((i, " ".join(words)))
    return out


def plain(docs, queries, k):
    hits = ret.ranked(ret.bm25(ret.postings(docs), queries), "query_id").where(F.col("rank") <= k)
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 4)) for r in hits.collect())


def found(hits):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 4)) for r in hits.collect())


def ask(spark):
    q = [(1, "rare"), (1, "w3"), (2, "common"), (3, "w1"), (3, "w5"), (3, "w60"), (3, "w200"), (4, "nowhere"), (5, "rare"), (6, "w1"), (6, "w1")]
    return spark.createDataFrame(q, "query_id long, term string")


def test_search_equals_bm25_and_reads_less(spark, tmp_path):
    docs = spark.createDataFrame([*texts(0, 3000), (5000, None), (5001, "")], "id long, text string").repartition(3)
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    ix.add(docs, block_docs=16)
    hits, counts = ix.searched(ask(spark), 7)
    assert found(hits) == plain(docs, ask(spark), 7)
    read = {r.query_id: (r.postings, r.read) for r in counts.collect()}
    assert set(read) == {1, 2, 3, 5, 6}
    df = {r.term: r.n for r in ret.postings(docs).groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert read[3][0] == sum(df[t] for t in ("w1", "w5", "w60", "w200"))
    assert all(b <= a for a, b in read.values()) and sum(b for _, b in read.values()) < sum(a for a, _ in read.values()) / 2, read
    # fewer hits than asked for: all is read
    assert found(ix.search(ask(spark), 5000)) == plain(docs, ask(spark), 5000)


def test_replacement(spark, tmp_path):
    root = f"{tmp_path}/ix"
    rows = dict(texts(0, 1200))
    df = lambda r: spark.createDataFrame(list(r.items()), "id long, text string")
    ix = index.Index(spark, f"file://{root}")
    ix.add(df(rows), block_docs=16)
    new = dict(texts(40, 44)) | {9000: "rare rare w3", 9001: "w3"}
    ix.replace(df(new), spark.createDataFrame([(7,), (77_777,)], "id long"), block_docs=16)
    rows |= new
    del rows[7]
    assert found(ix.search(ask(spark), 10)) == plain(df(rows), ask(spark), 10)
    # parts without a touched document were not written again
    again = [p for p in os.listdir(f"{root}/blocks") if p.startswith("part=") and os.path.exists(f"{root}/blocks/{p}/gen=1")]
    assert 0 < len(again) < index.PARTS / 2
    # a run that ends before its manifest is written leaves the index as it was
    before = found(ix.search(ask(spark), 10))
    os.rename(f"{root}/manifest", f"{root}/_manifest")
    os.makedirs(f"{root}/manifest")
    for f in os.listdir(f"{root}/_manifest"):
        os.link(f"{root}/_manifest/{f}", f"{root}/manifest/{f}")
    kept = set(os.listdir(f"{root}/manifest"))
    ix.replace(df({5: "rare " * 50}), block_docs=16)
    assert found(ix.search(ask(spark), 10)) != before
    for f in set(os.listdir(f"{root}/manifest")) - kept:
        os.remove(f"{root}/manifest/{f}")
    assert found(ix.search(ask(spark), 10)) == before


def test_empty_index(spark, tmp_path):
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    assert ix.search(ask(spark), 3).collect() == []
    ix.add(spark.createDataFrame([(None, "rare"), (1, None)], "id long, text string"))
    assert ix.search(ask(spark), 3).collect() == []
    ix.add(spark.createDataFrame([(2, "rare"), (2, "rare again"), (3, "w3")], "id long, text string"))
    assert [(r.query_id, r.id) for r in ix.search(ask(spark), 3).orderBy("query_id", "rank").collect()] == [(1, 2), (1, 3), (5, 2)]
    ix.replace(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(2,), (3,)], "id long"))
    assert ix.search(ask(spark), 3).collect() == []


def test_words_are_dealt_out_once(spark, tmp_path):
    """Between a text and its block's postings stands one exchange, of one row a document."""
    docs = spark.createDataFrame([(2, "a b a"), (1, "É b KK"), (3, None), (4, "...")], "id long, text string")
    packed = index.Index(spark, f"file://{tmp_path}/ix")._placed(docs, 128)
    plan = packed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    rows = {r.term: r for r in packed.collect()}
    assert set(rows) == {"", "a", "b", "kk"} and list(zip(rows[""].ids, rows[""].dls, strict=True)) == [(1, 2), (2, 3)]
    assert [(rows["a"].n, rows["a"].most_tf, rows["a"].least_dl), rows["a"].hits] == [(1, 2, 3), [1 | 2 << index.AT]]


def test_replacement_over_small_batches(spark, tmp_path):
    """Blocks whose rows come in several batches, blocks of which all documents leave, and a second replacement."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = dict(texts(0, 60))
        df = lambda r: spark.createDataFrame(list(r.items()), "id long, text string")
        ix = index.Index(spark, f"file://{tmp_path}/ix")
        ix.add(df(rows), block_docs=4)
        for new, gone in ((dict(texts(5, 20)), range(30, 45)), ({7: "rare", 8: None}, [0, 59])):
            ix.replace(df(new), spark.createDataFrame([(i,) for i in gone], "id long"), block_docs=4)
            rows = {i: t for i, t in (rows | new).items() if i not in gone}
            assert found(ix.search(ask(spark), 10)) == plain(df(rows), ask(spark), 10)
            assert sorted(r.id for r in ix.docs().collect()) == sorted(i for i, t in rows.items() if t)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
