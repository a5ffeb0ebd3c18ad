"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

WORD = r"[^\x20\x09-\x0D]+"


def global_ranks(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, its rows' number from 0 in an order that ties nothing.

    Rows are dealt by range and numbered in their partitions, so that one task
    never holds all of them; what passes between is one count a partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row a partition of the table above
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("place", F.col("_before") + row).drop("_part", "_at", "_before")


def water_fill(sources: DataFrame, share: tuple[int, int], epochs: int) -> DataFrame:
    """``source, source_size, target``: weights share ``share`` (a fraction) of all sizes, no source above ``epochs`` times its own.

    ``sources`` has ``source, source_size, weight``. Each round clamps the
    sources whose share would be above their cap, and deals what they leave to
    the others by weight; it ends when none is above. Rounds pass two sums to
    the driver. Where every source is at its cap, that is the mix. Amounts are
    whole numbers (of ``1 / share[1]`` words) up to the last division.
    """
    num, den = share
    known = cut(sources.withColumn("cap", F.col("source_size") * epochs), "sources")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    rest, weights, level = total * num, None, None

    def over(rest: int, weights: int) -> Column:
        """Whether weight * rest / weights is above the cap, in whole numbers."""
        wide = lambda c: c.cast("decimal(38,0)")
        return wide(F.col("weight")) * F.lit(rest).cast("decimal(38,0)") > wide(F.col("cap")) * F.lit(weights * den).cast("decimal(38,0)")

    clamped: Column = F.lit(False)
    while True:
        free = known.where(~clamped).agg(F.sum("weight")).first()[0] or 0
        held = known.where(clamped).agg(F.sum("cap")).first()[0] or 0
        if (rest, weights) == (total * num - held * den, free) or not free:
            break
        rest, weights = total * num - held * den, free
        # the level only rises, so that the last test holds for all clamped before
        clamped = over(rest, weights)
        level = (rest, weights)
    fair = F.lit(0.0) if level is None else (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1] * den))
    return known.select("source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(fair).alias("target"))


def _ends(sums: DataFrame, plan: DataFrame, digit: str) -> DataFrame:
    """Of each source with a budget, the bucket in which it ends, and how much of it is left there: ``source, <digit>, left``.

    ``sums`` has at most 256 rows a source.
    """
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(digit))
    known = plan.select(F.col("source").alias("s"), F.col("left").alias("budget"))
    ends = sums.withColumn("upto", upto).join(known, F.col("source").eqNullSafe(F.col("s")))
    return ends.where("upto - size < budget and budget <= upto").select("source", digit, (F.col("budget") - F.col("upto") + F.col("size")).alias("left"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 11, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words a mix takes of every document: ``doc_id, source, size, source_size, target, taken, repeats``.

    A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``; null:
    0). Sources by code point, null last, weigh ``weights``, repeating; together
    they share ``share`` of all sizes, by :func:`water_fill`. A source of target
    t and size s takes every document floor(t / s) times whole. What is left of
    t goes to its documents in a seeded order, each one once more as a whole,
    until less is left than the next document: that one is taken up to there.
    So a source's words are its target, to the nearest word.

    The order is that of a hash of seed, id and text. It is never sorted as a
    whole: sums over the hash's first byte, then over the second within the
    bucket so found, tell in which of 65,536 buckets the budget ends, and only
    that bucket's documents are put in order. A source with a third of all rows
    costs partial sums and one small window.

    Null sources are one source, the last; of empty texts nothing is taken.
    Rows that repeat an id are documents of their own; rows equal in id, source
    and text are interchangeable (they share a bucket). An empty table gives an
    empty result. ``repeats`` is taken / size (0 for empty texts).
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    salt = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), salt.alias("salt")), "sizes")
    slim = slim.withColumns({"first": F.shiftright("salt", 40), "last": F.shiftright("salt", 32)})
    sums = cut(slim.groupBy("source", "first").agg(F.sum("size").alias("size")), "bucket-sums")
    ranked = global_ranks(sums.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")).cast("long")
    targets = water_fill(ranked.select("source", "source_size", weight.alias("weight")), share, epochs)
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(targets.withColumns({"whole": whole, "left": goal - whole * F.col("source_size")}), "targets")
    ends = cut(_ends(sums, plan, "first"), "ends")
    near = slim.join(ends.select(F.col("source").alias("s"), F.col("first").alias("f")), F.col("source").eqNullSafe(F.col("s")) & (F.col("first") == F.col("f")))
    ends = _ends(near.groupBy("source", "last").agg(F.sum("size").alias("size")), ends, "last")
    ends = ends.select(F.col("source").alias("s"), F.col("last").alias("end"), F.col("left").alias("rest"))
    plan = cut(plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"), "plan")
    rows = slim.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    here = F.coalesce((F.col("last") == F.col("end")) & (F.col("size") > 0), F.lit(False))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("salt", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    edge = rows.where(here).withColumn("before", before).withColumn("extra", inside).drop("before")
    out = rows.where(~here).withColumn("extra", F.when(F.col("last") < F.col("end"), F.col("size")).otherwise(0)).union(edge)
    taken = F.col("whole") * F.col("size") + F.col("extra")
    result = out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    return result.withColumn("repeats", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))


#: Targets by the closed form: sources in order of cap a weight, each clamped while its share of what the earlier ones leave is
#: above its cap. The last repetition by one running sum a source.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS salt FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
      FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
free AS (SELECT arg_min(rest, source_size / weight) AS rest, arg_min(weights, source_size / weight) AS weights
         FROM r WHERE weight * rest <= 4 * source_size * weights),
t AS (SELECT source, source_size, CASE WHEN weight * rest > 4 * source_size * weights THEN 2.0::DOUBLE * source_size
        ELSE (weight * rest)::DOUBLE / (2 * weights)::DOUBLE END AS target
      FROM (SELECT w.*, free.rest, free.weights FROM w, free)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.whole, round(g.target)::BIGINT - g.whole * g.source_size
        - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY salt, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest)))::BIGINT AS taken FROM o
"""
