"""Stems, field search and judged sets; a judged corpus elsewhere is named by GOLDEN_CORPUS_DIR (corpus.json, retrieval.json, independence.json)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sieveline.functions.stem import porter
from sieveline.operators import evaluation as ev
from sieveline.sources.corpus import load_corpus

GOLDEN = os.environ.get("GOLDEN_CORPUS_DIR")


def test_stems():
    cases = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
        "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustment": "adjust", "adoption": "adopt",
        "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "x1": "x1", "is": "is",
    }
    assert {w: porter(w) for w in cases} == cases


DOCS = [
    (0, "https://a.example/1", None, "Costs of small reactors", None, "The costs of small reactors rose again this year as builders met delays and higher prices than they had planned for", "academic"),
    (1, "https://b.example/2", None, "A day at the sea", None, "We walked along the shore and counted birds while the costly boats went by in the evening light", "web"),
    (2, "https://c.example/3", "10.1/x", "Reactor designs", None, "Designs differ in cooling and in size", "academic"),
]


def test_field_search_and_graph(spark):
    rest = [(10 + i, None, None, f"Note {i}", None, f"plain words number {i}", "web") for i in range(9)]
    docs = spark.createDataFrame([*DOCS, *rest], "id long, url string, doi string, title string, abstract string, text string, family string")
    queries = spark.createDataFrame([(0, "costing reactor")], "query_id long, text string")
    lex = ev.field_search(docs, queries, 15)
    order = [r.id for r in lex.orderBy("rank").collect()]
    assert order == [0, 2]  # by stem; titles count more
    cit = spark.createDataFrame([(0, 1), (0, 12)], "citing long, cited long")
    both = [r.id for r in ev.with_graph(lex, cit).orderBy("rank").collect()]
    assert both[0] == 0 and set(both[:2]) == {0, 2} and both[2:] == [1, 12]  # found by the graph only: after the others
    m = ev.averages(lex, spark.createDataFrame([(0, 0), (0, 2)], "query_id long, id long")).first()
    assert m.recall_at_5 == 1.0 and m.mrr == 1.0


def test_independence(spark):
    rows = [*DOCS, (3, "https://d.example/4", None, "Other head", None, DOCS[0][5].upper(), "news"), (4, "https://www.c.example/3/", "10.1/X", "Reactor designs", None, "fuller text", "academic")]
    docs = spark.createDataFrame(rows, "id long, url string, doi string, title string, abstract string, text string, family string")
    pairs = spark.createDataFrame([(0, 3, False), (2, 4, False), (0, 1, True), (0, 2, True)], "left long, right long, independent boolean")
    r = ev.independence(docs, pairs).first()
    assert (r.pairs, r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (4, 2, 0, 0, 2, 1.0, 1.0)


@pytest.mark.skipif(not GOLDEN, reason="no judged corpus named")
def test_golden_corpus(spark):
    c = load_corpus(spark, f"{GOLDEN}/corpus.json")
    labels = sorted((r.label for r in c.select("label").collect()), key=lambda x: ("AN P".find(x[0]) if x[0] == "A" else 1, x))
    ids = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, id long")
    docs = c.join(ids, "label").select("id", "label", "url", "doi", "title", "abstract", "text", "family", "references").cache()
    q = spark.read.option("multiLine", "true").json(f"{GOLDEN}/retrieval.json").select(F.posexplode("queries").alias("query_id", "q")).select(F.col("query_id").cast("long").alias("query_id"), "q.query", "q.relevant")
    relevant = q.select("query_id", F.explode("relevant").alias("label")).join(ids, "label").select("query_id", "id").distinct()
    lex = ev.field_search(docs, q.select("query_id", F.col("query").alias("text")), 30)
    cit = docs.select(F.col("id").alias("citing"), F.explode("references").alias("label")).join(ids.withColumnRenamed("id", "cited"), "label").select("citing", "cited")
    lexical, graph = ev.averages(lex, relevant).first(), ev.averages(ev.with_graph(lex, cit), relevant).first()
    pairs = spark.read.option("multiLine", "true").json(f"{GOLDEN}/independence.json").select(F.explode("pairs").alias("p")).select("p.left", "p.right", "p.independent")
    pairs = pairs.join(ids.toDF("left", "l"), "left").join(ids.toDF("right", "r"), "right").select(F.col("l").alias("left"), F.col("r").alias("right"), "independent")
    ind = ev.independence(docs, pairs).first()
    print("\nlexical", lexical.asDict(), "\nlexical+graph", graph.asDict(), "\nindependence", ind.asDict())
    assert lexical.recall_at_10 == 1.0 and lexical.mrr >= 0.9
    assert graph.mrr >= lexical.mrr and graph.ndcg_at_10 >= lexical.ndcg_at_10 and graph.recall_at_5 >= lexical.recall_at_5
    assert ind.pairs == 12 and ind.precision == 1.0 and ind.recall >= 0.6
