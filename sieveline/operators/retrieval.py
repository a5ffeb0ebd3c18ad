"""Ranked retrieval: BM25, graph, vectors, and their fusion."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..functions import text as tx
from ..session import ship_package
from ..shared import cut

#: How much a vote of each retriever, and each kind of edge, is worth.
RRF_WEIGHTS = {"lexical": 1.0, "graph": 0.8, "vector": 0.9}
EDGE_WEIGHTS = {"cites": 1.0, "cited_by": 1.0, "same_claim": 1.2, "same_entity": 0.6, "copy": 0.3}
RRF_K, TAIL, SEEDS = 60, 0.05, 5


def postings(docs: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """``id, term, tf``: the inverted index; of ``terms`` (``term``) only, where they are given: other words are not dealt out."""
    words = docs.select("id", F.explode(tx.tokens(F.col(text))).alias("term"))
    if terms is not None:
        words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``id, dl``: words of each document that has any, counted where it stands."""
    words = F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"))
    return docs.groupBy("id").agg(F.sum(words).alias("dl")).where("dl > 0")


def replace_documents(index: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """An index with the postings of ``new`` documents (``id, text``) in place of their old ones, and without the documents ``gone``."""
    out = index.join(new.select("id"), "id", "left_anti")
    if gone is not None:
        out = out.join(gone.select("id"), "id", "left_anti")
    return out.unionByName(postings(new))


def field_postings(docs: DataFrame, weights: Mapping[str, float], stem=None) -> DataFrame:
    """``id, term, tf, n``: the inverted index over several columns; ``tf`` counts a term by its column's weight, ``n`` plainly.

    ``stem``: a function on a frame ``term`` that adds ``stem``; it sees every
    distinct term once.
    """
    parts = F.flatten(F.array(*[_weighted(c, w) for c, w in weights.items()]))
    words = docs.select("id", F.explode(parts).alias("x")).select("id", "x.term", "x.weight")
    if stem is not None:
        words = words.join(stem(words.select("term").distinct()), "term").select("id", F.col("stem").alias("term"), "weight")
    return words.groupBy("id", "term").agg(F.sum("weight").alias("tf"), F.count("*").alias("n"))


def _weighted(column: str, weight: float) -> Column:
    return F.transform(tx.tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("weight")))


def bm25(index: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, floor: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """``query_id, id, score`` of documents that hold a query's terms; ``queries``: ``query_id, term``.

    Lengths and document frequencies come from the whole index (``id, term, tf``
    and, where ``tf`` is weighted, ``n``), or lengths from ``sizes`` (``id, dl``): then the
    index needs no other postings than the queries'. Only those are joined. Nothing but the corpus's two numbers is broadcast by hint. A term's
    weight is ``log(1 + (N - df + 0.5) / (df + 0.5))``, or with ``floor`` that
    without the one, 1e-6 at least.
    """
    plain = "n" if "n" in index.columns else "tf"
    # texts are read for one and the other once
    held = cut(index.groupBy("id").agg(F.sum(plain).alias("dl")) if sizes is None else sizes, "sizes")
    stats = held.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    terms = queries.distinct()
    hit = cut(index.join(terms.select("term").distinct(), "term", "left_semi").select("id", "term", "tf"), "postings")
    # a few rows a query, of known size: they go to the postings, which are dealt by document once for all that follows
    asked = cut(terms.join(hit.groupBy("term").agg(F.count("*").alias("df")), "term"), "asked")
    odds = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.greatest(F.log(odds), F.lit(1e-6)) if floor else F.log(odds + 1.0)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = hit.join(held, "id").join(asked, "term").join(F.broadcast(stats))
    return weighed.groupBy("query_id", "id").agg(F.round(F.sum(idf * tf), 6).alias("score"))


def ranked(scores: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """Adds the place of each row, best score first, ties to smaller ids."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def top_pool(scores: DataFrame, pool: int, tail: float = TAIL) -> DataFrame:
    """Each query's best ``pool`` rows, without those under ``tail`` of its best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked(scores, "query_id").where(F.col("rank") <= pool).withColumn("_best", best).where(F.col("score") >= tail * F.col("_best")).drop("_best")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, block_queries: int = 1024, block_vectors: int = 16_384, step: int = 64) -> DataFrame:
    """``query_id, id, score, rank``: cosine above zero, best ``k``, of a query set against all vectors, in blocks.

    A task multiplies one block of queries with one block of vectors, ``step``
    queries at a time, and keeps each query's best ``k``. Vectors of different lengths, or of length zero,
    are not compared; equal scores go to smaller ids.
    """
    ship_package(vectors.sparkSession)
    ways = max(1, -(-vectors.count() // block_vectors))
    asks = max(1, -(-queries.count() // block_queries))
    kind = vectors.schema["id"].dataType.simpleString()
    size = lambda c: F.size(c).alias("size")
    left = queries.select(F.col("id").alias("query_id"), "v", size("v"), F.pmod(F.xxhash64("id"), F.lit(asks)).alias("ask"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).alias("way"))
    right = vectors.select("id", "v", size("v"), F.pmod(F.xxhash64("id"), F.lit(ways)).alias("way"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long"))).alias("ask"))

    def unit(x: pd.DataFrame) -> np.ndarray:
        v = np.array(x["v"].tolist(), np.float64).reshape(len(x), -1)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [{"query_id": [], "id": [], "score": []}]
        if len(q) and len(x):
            x = x.sort_values("id")
            asked, ids, these, those = q["query_id"].to_numpy(), x["id"].to_numpy(), unit(q), unit(x).T
            for at in range(0, len(q), step):
                mine = asked[at : at + step]
                score = np.round(these[at : at + step] @ those, 6)
                score[mine[:, None] == ids[None, :]] = 0
                best = np.argsort(-score, 1, kind="stable")[:, :k]
                top = np.take_along_axis(score, best, 1)
                row, col = np.nonzero(top > 0)
                out.append({"query_id": mine[row], "id": ids[best[row, col]], "score": top[row, col]})
        return pd.concat([pd.DataFrame(o) for o in out[-max(1, len(out) - 1) :]])

    by = ("size", "ask", "way")
    # both sides are renamed, so that they share no attribute
    hits = left.toDF(*left.columns).groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInPandas(run, f"query_id {queries.schema['id'].dataType.simpleString()}, id {kind}, score double")
    return ranked(hits, "query_id").where(F.col("rank") <= k)


def top_up(docs: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """The first documents, by id, that ``held`` has not: at most ``limit``."""
    return docs.join(held.select("id"), "id", "left_anti").orderBy("id").limit(limit)


def hashing_embeddings(docs: DataFrame, dim: int = 64) -> DataFrame:
    """``id, counts, norm``: hashed bag of words of each ``id, text``, sparse, with its Euclidean norm."""
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    words = docs.select("id", F.explode_outer(tx.tokens(F.col("text"))).alias("w"))
    counts = words.groupBy("id", bucket(F.col("w")).alias("k")).agg(F.count("w").alias("n"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))
    return counts.groupBy("id").agg(F.map_from_entries(entries).alias("counts"), F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))


def quoted(docs: DataFrame, items: DataFrame, inner: int = 5) -> DataFrame:
    """``query_id, id``: which texts (``id, hay``) hold which items (``query_id, needle``) verbatim.

    Words inside an item, all but its first and last, stand in a text that holds
    it as whole words in line. So items and texts are joined on the hash of
    ``inner`` such words (of all, where there are fewer), and only those pairs
    are compared; no text is compared with every item. Items of fewer than three
    words, which have none inside, are compared with all texts one by one.
    """
    words = lambda c: tx.tokens(F.col(c))
    mine = items.where("needle <> ''").withColumn("_w", words("needle"))
    mine = mine.withColumn("_n", F.least(F.size("_w") - 2, F.lit(inner)))
    keyed = mine.where("_n > 0").select("query_id", "needle", "_n", F.xxhash64(F.slice("_w", F.lit(2), F.col("_n"))).alias("_h"))
    widths = [r[0] for r in keyed.select("_n").distinct().collect()]  # at most ``inner`` numbers
    # null, not filtered, where too short: a filter on the words would have them worked out once more
    texts = docs.select("id", words("hay").alias("_w"))

    def windows(n: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.xxhash64(F.slice("_w", i, n)))
        return texts.select("id", F.lit(n).alias("_n"), F.explode(F.when(F.size("_w") >= n, F.array_distinct(each))).alias("_h"))

    pairs = None
    for n in sorted(widths):
        p = windows(n).join(keyed.where(F.col("_n") == n).select("query_id", "_n", "_h"), ["_n", "_h"]).select("query_id", "id").distinct()
        pairs = p if pairs is None else pairs.union(p)
    brief = mine.where("_n <= 0").select("query_id", "needle")
    out = docs.join(brief, F.col("hay").contains(F.col("needle"))).select("query_id", "id")
    if pairs is None:
        return out
    held = pairs.join(items, "query_id").join(docs, "id").where(F.col("hay").contains(F.col("needle"))).select("query_id", "id")
    return held.union(out)


def rrf(rankings: DataFrame, weight: Column, k: int = RRF_K) -> DataFrame:
    """``query_id, id, score``: reciprocal rank fusion of ``query_id, retriever, id, rank``."""
    return rankings.groupBy("query_id", "id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 8).alias("score"), F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("via"))


def retriever_weight(column: str = "retriever") -> Column:
    out = F.lit(0.0)
    for name, w in RRF_WEIGHTS.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out


def graph_expand(seeds: DataFrame, citations: DataFrame, copies: DataFrame | None = None, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """``query_id, id, score, reasons`` of documents next to ranked seeds (``query_id, id, rank``).

    Citations count by the seed's place (1, 1/2, 1/3 ...); what shares a claim
    or an entity with a seed counts in full (``shared``: by kind of edge,
    ``id, node``), and so do copies of its source, where they are asked for: in
    a ranking a copy is the same story again. Sums over edges; seeds themselves
    are left out. One equi-join for each kind of edge.
    """
    s = seeds.select("query_id", F.col("id").alias("seed"), (1.0 / F.col("rank")).alias("w"))
    edges = citations.where("cited is not null")
    out = s.join(edges, F.col("seed") == F.col("citing")).select("query_id", F.col("cited").alias("id"), (F.col("w") * EDGE_WEIGHTS["cites"]).alias("x"), F.lit("cites").alias("kind"))
    back = s.join(edges, F.col("seed") == F.col("cited")).select("query_id", F.col("citing").alias("id"), (F.col("w") * EDGE_WEIGHTS["cited_by"]).alias("x"), F.lit("cited_by").alias("kind"))
    every = out.union(back)
    for kind, links in (shared or {}).items():
        # each link of a seed to a node counts, with each link of others to it
        ours = s.join(links.toDF("seed", "node"), "seed").groupBy("query_id", "node").agg(F.count("*").alias("n"))
        every = every.union(ours.join(links, "node").select("query_id", "id", (F.col("n") * EDGE_WEIGHTS[kind]).alias("x"), F.lit(kind).alias("kind")))
    if copies is not None:
        mine = s.join(copies.toDF("seed", "independence_key"), "seed").select("query_id", "independence_key").distinct()
        every = every.union(mine.join(copies, "independence_key").select("query_id", "id", F.lit(EDGE_WEIGHTS["copy"]).alias("x"), F.lit("copy").alias("kind")))
    every = every.join(s.select("query_id", F.col("seed").alias("id")), ["query_id", "id"], "left_anti")
    return every.groupBy("query_id", "id").agg(F.round(F.sum("x"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))


def collapse_copies(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per query and source: its best place and score; an original stands for it where one was found.

    ``copies, copy_ids``: how many others were found, and which, the best placed first.
    """
    j = hits.join(sources, "id")
    pick = F.min_by("id", F.struct((F.col("id") != F.col("independence_key")).alias("copy"), F.col("rank")))
    found = F.sort_array(F.collect_list(F.struct("rank", "id")))
    out = j.groupBy("query_id", "independence_key").agg(pick.alias("id"), F.max("score").alias("score"), F.min("rank").alias("first_rank"), (F.count("*") - 1).alias("copies"), found.alias("found"))
    return out.select("query_id", "independence_key", "id", "score", "first_rank", "copies", F.filter(F.col("found.id"), lambda x: x != F.col("id")).alias("copy_ids"))


def ranking_metrics(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall, precision, rr, ndcg`` at k of ``query_id, id, rank`` against ``query_id, id``.

    Precision divides by what was returned; the ideal gain counts the relevant, k at most.
    """
    r = ranking.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query_id", "id"], "left")
    got = r.groupBy("query_id").agg(F.sum("rel").alias("found"), F.count("*").alias("returned"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))
    z = lambda c: F.coalesce(c, F.lit(0))
    return total.join(got, "query_id", "left").select(
        "query_id", F.round(z(F.col("found")) / F.col("total"), 6).alias("recall"), F.round(z(F.col("found") / F.col("returned")), 6).alias("precision"),
        F.round(z(1 / F.col("first")), 6).alias("rr"), F.round(z(F.col("dcg")) / ideal, 6).alias("ndcg"),
    )
