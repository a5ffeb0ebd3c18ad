"""Citation edges: resolution, bounded chases, folded views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(citations: DataFrame, held: DataFrame) -> DataFrame:
    """Edges with a missing end filled in from the documents held, by DOI (``held``: ``held, cited_doi``)."""
    return citations.join(held, "cited_doi", "left").withColumn("cited", F.coalesce("cited", "held")).drop("held")


def chase(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``seed, id, hop``: what each seed reaches over ``src, dst`` in at most ``depth`` hops, with the fewest.

    One join a hop; only nodes that a hop reaches for the first time go on.
    """
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(edges, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def represented(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """``source, target``: edges ``citing, cited`` between the documents that stand for copies; no loops, each once."""
    a, z = heads.toDF("citing", "source"), heads.toDF("cited", "target")
    return edges.join(a, "citing").join(z, "cited").where("source <> target").select("source", "target").distinct()
