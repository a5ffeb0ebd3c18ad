"""Distributed connected components as iterated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table.

    Alternates large-star and small-star steps: each round hooks every node's
    larger neighbours on the smallest node it knows, which halves paths, so the
    number of rounds grows with the logarithm of a component's diameter. Every
    round's edges are written to the shared folder. Groups are reduced with
    partially aggregated ``min``; no neighbour list is ever collected. The join
    that brings a node's smallest neighbour back to its edges shuffles a hub's
    edges to the hub, as rows: adaptive execution splits that join where it is
    skewed, or broadcasts the other side where that is small.

    Nulls and self loops are ignored, repeated edges count once, an empty table
    gives an empty result. Returns ``node, component`` for nodes with an edge.
    """
    cur = cut(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    sign = None
    while True:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u hooks on the smallest node around u
        large = (
            both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its smaller neighbours hook on the smallest of them
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(base, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(base.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = cut(small, "cc")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(cur)
        cur = nxt
        if sign == tuple(now):
            break
        sign = tuple(now)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
