"""Exact cosine search over vectors dealt into cells: blocks whose bound is below the kth score are left out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..shared import cut

#: Cells, at most, and vectors of a block. Centres are vectors of a sample of as many; every vector is dealt out.
CELLS, BLOCK = 64, 512
#: Blocks of each query that are compared before any is left out.
FIRST = 3
#: What double precision and rounding to six digits may move a cosine by.
SLACK = 2e-6


def _unit(values: np.ndarray) -> np.ndarray:
    norm = np.sqrt((values * values).sum(1, keepdims=True))
    return values / norm


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _usable(vectors: DataFrame) -> DataFrame:
    """``id, size, v`` in double precision: vectors without nulls or endless components, and not of length zero."""
    x = F.transform("v", lambda c: c.cast("double"))
    ok = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e150)) & F.exists(x, lambda c: F.abs(c) > 1e-150)
    return vectors.where(F.coalesce(ok, F.lit(False))).select("id", F.size("v").alias("size"), x.alias("v"))


def cell_search(vectors: DataFrame, queries: DataFrame, k: int, *, cells: int = CELLS, block: int = BLOCK, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """``query_id, id, score, rank``: the best ``k`` by cosine above zero, and ``query_id, vectors, read``: how many there are, and were compared.

    ``vectors`` and ``queries``: ``id, v``. Each vector goes to the nearest of
    at most ``cells`` centres of its length, which are vectors of smallest
    hashes, and there to one of the cell's blocks, with those of like distance.
    A block keeps its largest and smallest cosine to the centre. A query at
    angle a to a centre is within a - b of a vector at angle b, at least: that
    bounds the block's cosines. The blocks of largest bound come first; those
    whose bound is below the kth score so found hold no hit and are not
    compared. Equal scores go to smaller ids; a query does not find its own id.
    Null ids, and vectors that are null, empty, of length zero or not finite,
    take no part; lengths are not mixed. Rows that repeat an id are vectors of
    their own.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    held = cut(_usable(vectors), "vectors")
    asked = _usable(queries).withColumnRenamed("id", "query_id")
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("id"), "id"))
    chosen = held.withColumn("r", rank).where(F.col("r") <= cells).select("size", "v").collect()  # at most `cells` vectors a length
    by_size: dict[int, np.ndarray] = {}
    for n in sorted({r["size"] for r in chosen}):
        by_size[n] = _unit(np.array([r["v"] for r in chosen if r["size"] == n]))
    kind, ask = held.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell of each vector, and its cosine to the centre."""
        for batch in batches:
            size, cell, cosine = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                c = _unit(_matrix(batch.column("v").take(pa.array(rows)))) @ by_size[n].T
                cell[rows], cosine[rows] = c.argmax(1), c.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cosine)], names=[*batch.schema.names, "cell", "cosine"])

    def angles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's cosine to every centre."""
        for batch in batches:
            size = batch.column("size").to_numpy()
            for n in np.unique(size).tolist():
                if n in by_size:
                    rows = np.flatnonzero(size == n)
                    c = _unit(_matrix(batch.column("v").take(pa.array(rows)))) @ by_size[n].T
                    row, cell = np.divmod(np.arange(c.size), c.shape[1])
                    ids = batch.column("query_id").take(pa.array(rows[row]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(c.size, n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(c.ravel())], names=["query_id", "size", "cell", "to_centre"])

    dealt = held.mapInArrow(near, f"id {kind}, size int, v array<double>, cell int, cosine double")
    # neighbours in distance share a block: a cell is put in order by range, never in one task
    order = [F.col("size"), F.col("cell"), F.col("cosine"), F.col("id")]
    dealt = cut(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "cells")
    number = (F.shiftright("at", 33) * F.lit(1 << 33) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / block)).alias("block")
    placed = dealt.select("id", "size", "v", "cell", "cosine", number)
    heads = placed.groupBy("size", "cell", "block").agg(F.count("*").alias("n"), F.min("cosine").alias("low"), F.max("cosine").alias("high"))
    asked = cut(asked, "queries")
    met = asked.mapInArrow(angles, f"query_id {ask}, size int, cell int, to_centre double").join(heads, ["size", "cell"])
    bounds = cut(met.select("query_id", "size", "cell", "block", "n", _bound(F.col("to_centre"), F.col("low"), F.col("high")).alias("bound")), "bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    keys = ["query_id", "size", "cell", "block"]
    before = cut(bounds.withColumn("r", place).where(F.col("r") <= first).select(*keys, "n"), "first")
    best = cut(_compared(before, asked, placed, k, ask, kind), "best")
    floor = _top(best, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(before.select(*keys), keys, "left_anti").join(floor, "query_id", "left")
    rest = cut(rest.where((F.col("bound") > 0) & (F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))).select(*keys, "n"), "rest")
    hits = _top(best.unionByName(_compared(rest, asked, placed, k, ask, kind)), k)
    read = before.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("read"))
    return hits, bounds.groupBy("query_id").agg(F.sum("n").alias("vectors")).join(read, "query_id")


def _bound(to_centre: Column, low: Column, high: Column) -> Column:
    """The largest cosine that a query can have with vectors at cosines ``low`` to ``high`` to a centre."""
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    a, far, close = F.acos(clip(to_centre)), F.acos(clip(low)), F.acos(clip(high))
    apart = F.greatest(F.lit(0.0), a - far, close - a)
    return F.cos(apart) + F.lit(SLACK)


def _top(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _compared(pairs: DataFrame, asked: DataFrame, placed: DataFrame, k: int, ask: str, kind: str) -> DataFrame:
    """Best ``k`` of each query in each block that it is sent to. Blocks and queries stream through sorted partitions."""
    by = ["size", "cell", "block"]
    left = pairs.join(asked.select("query_id", "v"), "query_id").select(*by, F.lit(1).alias("side"), F.col("query_id").cast("string").alias("key"), "v")
    right = placed.join(pairs.select(*by).distinct(), by, "left_semi").select(*by, F.lit(0).alias("side"), F.col("id").cast("string").alias("key"), "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held_ids, held = None, [], []
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in range(4)], 1)
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(at, axis=0) != 0).any(1)])) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                a, b = int(a), int(b)
                if tuple(at[a, :3]) != own:
                    own, held_ids, held = tuple(at[a, :3]), [], []
                ids, values = batch.column(4).slice(a, b - a), _unit(_matrix(batch.column(5).slice(a, b - a)))
                if at[a, 3] == 0:  # a block's vectors come before its queries
                    held_ids.append(ids)
                    held.append(values)
                    continue
                vectors, names = np.concatenate(held), pa.concat_arrays(held_ids)
                for q in range(0, len(values), 1024):
                    score = np.round(values[q : q + 1024] @ vectors.T, 6)
                    asked_ids, own_ids = np.array(ids.slice(q, 1024).to_pylist()), np.array(names.to_pylist())
                    score[asked_ids[:, None] == own_ids[None, :]] = 0
                    # all that reach a query's kth score here: ties are settled by id later
                    kth = -np.partition(-score, min(k, score.shape[1]) - 1, 1)[:, min(k, score.shape[1]) - 1]
                    row, col = np.nonzero((score > 0) & (score >= kth[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[row].tolist(), pa.string()), pa.array(own_ids[col].tolist(), pa.string()), pa.array(score[row, col])], names=["query_id", "id", "score"])

    both = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "side")
    found = both.mapInArrow(run, "query_id string, id string, score double")
    return found.select(F.col("query_id").cast(ask).alias("query_id"), F.col("id").cast(kind).alias("id"), "score")
