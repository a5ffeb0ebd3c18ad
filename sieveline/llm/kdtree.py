"""Exact top-k inner-product search with KD-trees over shards dealt by space."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF = 128
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53
#: Scores are clamped to this; scaled components to ``FAR``.
MOST = 2**63 - 1
FAR = 1e300
#: Vectors on which the split into shards is fitted at most: a bounded sample, by hash of the id. Every vector is dealt out.
SAMPLE_ROWS = 20_000
#: Sampled vectors that a cell of that split holds at least.
CELL = 32
#: Queries, and shards' boxes, that one task compares at a time.
QUERIES, BOXES = 2048, 1024


class KDTree:
    """Median splits on the widest side; every node, inner or leaf, has its tight bounding box.

    Points that are all equal are split at the median id. Children of an inner
    node stand next to each other.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        low, high, self.least, self.child, self.rows = [], [], [], [], []

        def node(rows: np.ndarray) -> None:
            low.append(points[rows].min(0))
            high.append(points[rows].max(0))
            self.least.append(ids[rows].min())
            self.child.append(-1)
            self.rows.append(rows)

        node(np.arange(len(ids)))
        at = 0
        while at < len(self.rows):
            rows = self.rows[at]
            if len(rows) > leaf:
                width = high[at] - low[at]
                side = int(np.argmax(width)) if points.shape[1] else 0
                split = points[rows, side] if points.shape[1] and width[side] else ids[rows]
                order = np.argpartition(split, len(rows) // 2)
                self.child[at], self.rows[at] = len(self.rows), None
                node(rows[order[: len(rows) // 2]])
                node(rows[order[len(rows) // 2 :]])
            else:
                rows = self.rows[at] = rows[np.argsort(ids[rows], kind="stable")]
            at += 1
        self.low, self.high, self.least, self.child = np.array(low), np.array(high), np.array(self.least), np.array(self.child)
        self.ids, self.points = ids, points

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Top k (scores, ids) of each query, by best-first traversal, all queries in step.

        Each query opens the node of largest bound among those it has met: an
        inner node gives way to its children, a leaf's points are scored.
        ``kth`` and ``kth_id`` are the worst score, and its id, among k
        neighbours that each query has elsewhere: a node whose bound is below
        them is skipped, and what is found raises them. A query ends when its
        largest bound is below its kth score. Missing places have id -1; a
        query's own id is left out.
        """
        n = len(query_ids)
        scores, ids = np.full((n, k), -np.inf, queries.dtype), np.full((n, k), -1, np.int64)
        above, below = np.maximum(queries, 0), np.minimum(queries, 0)

        def bound(q: np.ndarray, node: int) -> np.ndarray:
            return above[q] @ self.high[node] + below[q] @ self.low[node]

        live = np.arange(n)
        met = np.full((n, len(self.child)), -np.inf, queries.dtype)
        met[:, 0] = bound(live, 0)
        while len(live):
            each = np.arange(len(live))
            node = met.argmax(1)
            top = met[each, node]
            met[each, node] = -np.inf
            go = (top > kth[live]) | ((top == kth[live]) & (self.least[node] < kth_id[live]))
            # bounds only shrink: below the kth score nothing further can help
            stay = (top >= kth[live]) & (top > -np.inf)
            todo = np.flatnonzero(go & stay)
            todo = todo[np.argsort(node[todo], kind="stable")]
            edges = np.flatnonzero(np.diff(node[todo], prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(todo)], strict=False):
                some, at = todo[a:b], int(node[todo[a]])
                child = int(self.child[at])
                if child >= 0:
                    met[some, child], met[some, child + 1] = bound(live[some], child), bound(live[some], child + 1)
                else:
                    self._scan(live[some], self.rows[at], query_ids, queries, k, scores, ids, kth, kth_id)
            live, met = (live, met) if stay.all() else (live[stay], met[stay])
        return scores, ids

    def _scan(self, q: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray, kth: np.ndarray, kth_id: np.ndarray) -> None:
        """Score a leaf's points for some queries and keep each one's best k."""
        own = self.ids[rows]
        got = queries[q] @ self.points[rows].T
        if got.dtype == object:
            got = np.maximum(np.minimum(got, MOST), -MOST)
        all_ids = np.concatenate([ids[q], np.broadcast_to(own, got.shape)], 1)
        mine = own[None, :] == query_ids[q][:, None]
        if mine.any():
            got[mine] = -np.inf
            all_ids[:, k:][mine] = -1
        all_scores = np.concatenate([scores[q], got], 1)
        rank = np.where(all_ids < 0, np.iinfo(np.int64).max, all_ids)
        best = np.argsort(rank, 1, kind="stable")
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_scores, best, 1), 1, kind="stable"), 1)[:, :k]
        scores[q] = np.take_along_axis(all_scores, best, 1)
        ids[q] = np.take_along_axis(all_ids, best, 1)
        s, i = scores[q, k - 1], ids[q, k - 1]
        better = (i >= 0) & ((s > kth[q]) | ((s == kth[q]) & (i < kth_id[q])))
        kth[q[better]], kth_id[q[better]] = s[better], i[better]


class Cells:
    """The upper part of a KD-tree, fitted on a sample: which cell of space a vector lies in."""

    def __init__(self, points: np.ndarray, cells: int):
        self.side, self.at, self.child = [-1], [0.0], [-1]
        open_ = [(0, np.arange(len(points)))]
        for k in range(max(0, cells - 1)):
            if k >= len(open_):
                break
            node, rows = open_[k]  # breadth first: cells of a level are split before those of the next
            x = points[rows]
            width = x.max(0) - x.min(0) if len(x) and x.shape[1] else np.zeros(1)
            side = int(np.argmax(width))
            if len(rows) < 2 * CELL or not width[side]:
                continue
            self.side[node], self.at[node], self.child[node] = side, float(np.median(x[:, side])), len(self.side)
            right = x[:, side] >= self.at[node]
            for part in (rows[~right], rows[right]):
                open_.append((len(self.side), part))
                self.side.append(-1)
                self.at.append(0.0)
                self.child.append(-1)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        side, at, child = map(np.array, (self.side, self.at, self.child))
        node = np.zeros(len(points), np.int64)
        rows = np.flatnonzero(side[node] >= 0)
        while len(rows):
            here = node[rows]
            node[rows] = child[here] + (points[rows, side[here]] >= at[here])
            rows = rows[side[node[rows]] >= 0]
        return node


def quantised(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of each component, as doubles without a fraction; unusable vectors left out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # beyond 2**53 a double has no fraction, and Spark's floor is a 64-bit integer
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(F.greatest(F.least(v, F.lit(FAR)), F.lit(-FAR)))
    q = F.transform(x, lambda v: whole(v * F.lit(float(scale))))
    return vectors.where(ok).select(F.col(key).cast("long").alias("vec_id"), q.alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def _stacked(column: pd.Series, size: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), size)


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Queries (with what they know of their kth score) against one shard; vectors of one length."""
    if not len(left) or not len(right):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
    size = len(right["q"].iloc[0])
    a, b = _stacked(left["q"], size), _stacked(right["q"], size)
    # beyond this, Python's own integers
    kind = np.float64 if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, size) < EXACT else object
    if kind is object:
        a, b = (np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b))
    kth = np.array([-np.inf if pd.isna(x) else int(x) for x in left["kth"]], kind)
    kth_id = left["kth_id"].fillna(np.iinfo(np.int64).max).astype(np.int64).to_numpy(copy=True)
    scores, found = KDTree(right["vec_id"].to_numpy(np.int64), b).search(left["vec_id"].to_numpy(np.int64), a, k, kth, kth_id)
    row, col = np.nonzero(found >= 0)
    return pd.DataFrame({"query_id": left["vec_id"].to_numpy(np.int64)[row], "vec_id": found[row, col], "score": scores[row, col].astype(np.int64)})


def _placed(vecs: DataFrame, shards: int, shard_rows: int) -> DataFrame:
    """``vec_id, q, size, shard``: vectors of one length and one cell of space, at most about ``shard_rows`` together."""
    sample = vecs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    sizes = sample["q"].map(len)
    cells = {int(n): Cells(_stacked(sample["q"][sizes == n], n), max(1, round(shards * float((sizes == n).mean())))) for n in sizes.unique()}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1)
            size = np.diff(np.asarray(q.offsets, np.int64))
            start = np.asarray(q.offsets, np.int64)[:-1]
            values, cell = q.values.to_numpy(), np.zeros(len(q), np.int64)
            for n in np.unique(size).tolist():
                if n in cells and n:
                    rows = np.flatnonzero(size == n)
                    cell[rows] = cells[n](values[start[rows][:, None] + np.arange(n)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell)], names=["vec_id", "q", "size", "cell"])

    dealt = cut(vecs.mapInArrow(deal, "vec_id long, q array<double>, size long, cell long"), "cells")
    parts = dealt.groupBy("size", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    shard = F.xxhash64("size", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return cut(dealt.join(parts, ["size", "cell"]).select("vec_id", "q", "size", shard.alias("shard")), "shards")


def _boxes(placed: DataFrame) -> DataFrame:
    """``shard, size, low, high, least``: each shard's tight box and smallest id; pre-aggregated in each task."""
    schema = "shard long, size long, low array<double>, high array<double>, least long"

    def merged(shard: np.ndarray, size: np.ndarray, low: list, high: list, least: np.ndarray) -> dict[str, list]:
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=shard[order[0]] - 1))
        out: dict[str, list] = {c: [] for c in ("shard", "size", "low", "high", "least")}
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            values = (int(shard[rows[0]]), int(size[rows[0]]), np.min([low[r] for r in rows], 0), np.max([high[r] for r in rows], 0), int(least[rows].min()))
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        return out

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                q = x["q"].tolist()
                yield pd.DataFrame(merged(x["shard"].to_numpy(), x["size"].to_numpy(), q, q, x["vec_id"].to_numpy()))

    def whole(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merged(x["shard"].to_numpy(), x["size"].to_numpy(), x["low"].tolist(), x["high"].tolist(), x["least"].to_numpy()))

    return placed.mapInPandas(partial, schema).groupBy("shard").applyInPandas(whole, schema)


def _worthwhile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of a block of queries and a block of boxes, the pairs that could hold a neighbour."""
    out: list[pd.DataFrame] = []
    if len(left) and len(right):
        size = int(left["size"].iloc[0])
        low, high, shard, least = _stacked(right["low"], size), _stacked(right["high"], size), right["shard"].to_numpy(), right["least"].to_numpy()
        for k in range(0, len(left), 256):
            part = left.iloc[k : k + 256]
            q = _stacked(part["q"], size)
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            bound += np.abs(bound) * 1e-9  # what double precision may have lost
            bound[np.isnan(bound)] = np.inf
            kth = part["kth"].fillna(-np.inf).to_numpy(np.float64)[:, None]
            kth_id = part["kth_id"].fillna(np.iinfo(np.int64).max).astype(np.int64).to_numpy()[:, None]
            row, col = np.nonzero(((bound > kth) | ((bound == kth) & (least[None, :] < kth_id)) | (bound >= MOST)) & (shard[None, :] != part["home"].to_numpy()[:, None]))
            out.append(part.iloc[row][["vec_id", "q", "kth", "kth_id"]].assign(shard=shard[col]))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, object) for c in ("vec_id", "q", "kth", "kth_id", "shard")})


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, query_modulus: int = 20, *, shard_rows: int = 16_384, block_rows: int = 16_384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``query_modulus``; candidates
    all rows but the query's own; ties go to smaller ids. Vectors are dealt by
    space into shards of about ``shard_rows``. A query first searches the shard
    it lies in. The kth score found there, against the boxes of all other
    shards, decides which of them the query is sent to; there it prunes from
    the root on. A task searches one shard's KD-tree for at most about
    ``block_rows`` queries.

    Null ids, and vectors that are null or have null or non-finite components,
    take no part. Rows with one id count as one (the smallest vector of them).
    Vectors of different lengths are not compared. An empty table gives an
    empty result; with fewer than k candidates all are returned. Scores beyond
    2**53 are summed as exact integers; scores beyond 64 bits count as the
    nearest number of 64 bits (ties by id), scaled components beyond 1e300 as
    that.
    """
    vecs = cut(quantised(vectors, scale, key, vector), "vectors")
    shards = max(1, math.ceil(vecs.count() / shard_rows))
    placed = _placed(vecs, shards, shard_rows)
    none = F.lit(None).cast("long")
    # both sides of a cogroup are renamed, so that they share no attribute
    renamed = lambda df: df.toDF(*df.columns)
    queries = placed.where(F.col("vec_id") % query_modulus == 0)
    home = queries.select("vec_id", "q", "shard", none.alias("kth"), none.alias("kth_id"))
    schema = "query_id long, vec_id long, score long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k)

    hits = cut(renamed(home).groupBy("shard").cogroup(renamed(placed).groupBy("shard")).applyInPandas(run, schema), "home-hits")
    boxes = cut(_boxes(placed), "boxes")
    n = boxes.count()
    if n > 1:
        worst = hits.groupBy("query_id").agg(F.count("*").alias("c"), F.min(F.struct(F.col("score"), (-F.col("vec_id")).alias("i"))).alias("w")).where(F.col("c") >= k)
        worst = worst.select(F.col("query_id").alias("vec_id"), F.col("w.score").alias("kth"), (-F.col("w.i")).alias("kth_id"))
        known = queries.withColumnRenamed("shard", "home").join(worst, "vec_id", "left")

        def dealt(df: DataFrame, mine: str, of: Column, own: int, other_name: str, other: int) -> DataFrame:
            """``df`` in ``own`` blocks, each once for every block of the other side."""
            return df.withColumn(mine, F.pmod(of, F.lit(own))).withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))

        asks, ways = max(1, math.ceil(queries.count() / QUERIES)), math.ceil(n / BOXES)
        left = dealt(known, "ask", F.xxhash64("vec_id"), asks, "way", ways)
        right = dealt(boxes, "way", F.col("shard"), ways, "ask", asks)
        by = ("size", "ask", "way")
        pairs = renamed(left).groupBy(*by).cogroup(renamed(right).groupBy(*by)).applyInPandas(_worthwhile, "vec_id long, q array<double>, kth long, kth_id long, shard long")
        pairs = cut(pairs, "away")
        parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
        away = pairs.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
        there = placed.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        hits = hits.union(renamed(away).groupBy("shard", "part").cogroup(renamed(there).groupBy("shard", "part")).applyInPandas(run, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
