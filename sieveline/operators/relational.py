"""Small relational operators: lookups, upserts, ranked picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_many(df: DataFrame, ids: Sequence, key: str) -> DataFrame:
    """Rows of the listed ids, with ``pos``, their place in the list (the caller bounds the list)."""
    wanted = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, pos int")
    return df.join(wanted, key)  # a small list is broadcast by its size


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1 (WindowGroupLimit applies)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows whose key it does not hold; null keys equal one another."""
    cond = [base[k].eqNullSafe(rows[k]) for k in keys]
    return base.unionByName(rows.dropDuplicates(list(keys)).join(base, cond, "left_anti"))


def upsert(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with ``rows`` in place of the rows of equal key, and the others added."""
    return base.join(rows, list(keys), "left_anti").unionByName(rows)


def missing(df: DataFrame, held: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows without a counterpart, the smallest keys first if limited."""
    out = df.join(held.select(key).distinct(), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def edges_touching(edges: DataFrame, seeds: DataFrame, src: str, dst: str, seed: str) -> DataFrame:
    """Edges with either end among the seeds: two equi-joins, not a join on OR."""
    s = seeds.select(F.col(seed)).distinct()
    out = edges.join(s.withColumnRenamed(seed, src), src, "left_semi")
    return out.unionByName(edges.join(s.withColumnRenamed(seed, dst), dst, "left_semi")).distinct()


def fill_gaps(df: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per record: of each column the first value that is not null, in order of arrival."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(by).agg(*first, F.min(order).alias("first_seen"), F.count("*").alias("records"))
