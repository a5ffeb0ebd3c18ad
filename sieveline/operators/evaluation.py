"""Judged sets against what the engine finds: rankings by combination of retrievers, and independence of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as tx
from ..functions import urls as ur
from . import dedup
from . import retrieval as ret

#: What a word in the title, the abstract and the body counts.
FIELDS = {"title": 8.0, "abstract": 4.0, "text": 1.0}


def field_search(docs: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """``query_id, id, score, rank``: stemmed BM25 over title, abstract and text (``docs``), best ``pool`` above the tail.

    ``queries``: ``query_id, text``; their words of two letters or more count, once each.
    """
    index = ret.field_postings(docs, FIELDS, stem.stems)
    words = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).where(F.length("term") > 1)
    terms = words.join(stem.stems(words.select("term").distinct()), "term").select("query_id", F.col("stem").alias("term"))
    return ret.top_pool(ret.bm25(index, terms, floor=True), pool)


def with_graph(lexical: DataFrame, citations: DataFrame) -> DataFrame:
    """``query_id, id, rank``: a lexical ranking fused with its neighbours in the graph.

    Neighbours that were found by words too rank them higher; the others follow after all of those.
    """
    graph = ret.graph_expand(lexical.where(F.col("rank") <= ret.SEEDS), citations)
    held = ret.ranked(graph.join(lexical.select("query_id", "id"), ["query_id", "id"], "left_semi"), "query_id")
    ranks = lexical.select("query_id", "id", "rank", F.lit("lexical").alias("retriever")).unionByName(held.select("query_id", "id", "rank", F.lit("graph").alias("retriever")))
    fused = ret.rrf(ranks, ret.retriever_weight()).select("query_id", "id", "score", F.lit(0).alias("tier"))
    extra = graph.join(fused, ["query_id", "id"], "left_anti").select("query_id", "id", "score", F.lit(1).alias("tier"))
    # what only the graph found has scores below any fused one
    both = fused.unionByName(extra.withColumn("score", F.col("score") - 1e6))
    return ret.ranked(both, "query_id").select("query_id", "id", "rank")


def averages(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """``recall_at_5, recall_at_10, mrr, ndcg_at_10`` of a ranking against judgements, averaged over the judged queries."""
    at = {k: ret.ranking_metrics(ranking, relevant, k) for k in (5, 10)}
    five = at[5].agg(F.round(F.avg("recall"), 4).alias("recall_at_5"))
    ten = at[10].agg(F.round(F.avg("recall"), 4).alias("recall_at_10"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg_at_10"))
    return five.join(F.broadcast(ten))  # one row each


def copies_of(corpus: DataFrame) -> DataFrame:
    """``id, matched_id`` of a corpus's documents (``id, url, doi, title, abstract, text, family``) that are not independent.

    The same DOI, url or text as an earlier document comes first, then likeness,
    then a link of attribution where the corpus has ``links``.
    """
    docs = corpus.withColumn("outlet", F.coalesce(ur.registrable_domain(ur.host_of(F.col("url"))), F.lit("")))
    docs = docs.withColumn("text", tx.best_text(tx.clean_text(F.col("text")), F.col("abstract"), F.col("title")))
    keys = F.array(F.col("doi"), ur.identity_key(F.col("url")), F.md5(F.lower(F.regexp_replace("text", r"\s+", " "))))
    each = docs.select("id", F.posexplode(keys).alias("scheme", "value")).where("value is not null")
    exact = dedup.first_seen(each).where("first_id < id").groupBy("id").agg(F.min_by("first_id", "scheme").alias("matched_id"))
    near = dedup.verdicts(dedup.scored_candidates(docs), docs).where("relation <> 'independent'").select("id", "matched_id")
    out = exact.unionByName(near.join(exact, "id", "left_anti"))
    if "links" in corpus.columns:
        out = out.unionByName(dedup.attributions(docs, corpus.where("links is not null").select("id", "links")).join(out, "id", "left_anti"))
    return out


def independence(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs, tp, fp, fn, tn, precision, recall`` of judged pairs (``left, right, independent``: ids); not independent is positive."""
    parents = copies_of(corpus)
    keys = dedup.independence(corpus, parents)
    j = pairs.join(keys.toDF("left", "lk"), "left").join(keys.toDF("right", "rk"), "right")
    found, real = F.col("lk") == F.col("rk"), ~F.col("independent")
    c = j.agg(F.count("*").alias("pairs"), F.count_if(found & real).alias("tp"), F.count_if(found & ~real).alias("fp"), F.count_if(~found & real).alias("fn"), F.count_if(~found & ~real).alias("tn"))
    share = lambda a, n: F.round(F.coalesce(F.try_divide(a, n), F.lit(0.0)), 4)
    return c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
