"""Centroid clustering by filtering through ball trees, exact on integer vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import cut

#: Vectors of one tree, and of one leaf.
TREE_ROWS, LEAF = 8192, 32
#: Scaled components are clamped to this, so that 64 squared differences fit 64 bits.
MOST = 1 << 27
#: Components below this in size keep sums of products under 2**53, exact in double precision.
SMALL = 1 << 22


class BallTree:
    """Balls over one block of integer vectors: pivot, radius, number and exact sum; children of a ball stand next to each other.

    Rows are put in order so that each ball is a range. Radii are rounded up.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        pivot, radius, total = [], [], []
        self.start, self.end, self.child = [], [], []

        def ball(a: int, b: int) -> None:
            some = points[self.order[a:b]]
            s = some.sum(0)
            centre = s / (b - a)
            pivot.append(centre)
            radius.append(np.sqrt(((some - centre) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-6)
            total.append(s)
            self.start.append(a)
            self.end.append(b)
            self.child.append(-1)

        if len(points):
            ball(0, len(points))
        at = 0
        while at < len(self.child):
            a, b = self.start[at], self.end[at]
            if b - a > leaf and radius[at] > 1e-3:
                rows = self.order[a:b]
                some = points[rows].astype(np.float64)
                far = some[((some - pivot[at]) ** 2).sum(1).argmax()]
                other = some[((some - far) ** 2).sum(1).argmax()]
                # halves along the line between two far points, so that no side is empty
                side = np.argsort(some @ (other - far), kind="stable")
                self.order[a:b] = rows[side]
                middle = a + (b - a) // 2
                self.child[at] = len(self.child)
                ball(a, middle)
                ball(middle, b)
            at += 1
        n = len(self.child)
        self.pivot, self.radius = np.array(pivot).reshape(n, points.shape[1]), np.array(radius)
        self.total = np.array(total, np.int64).reshape(n, points.shape[1])
        self.start, self.end, self.child = (np.array(x, np.int64) for x in (self.start, self.end, self.child))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as int64."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < SMALL:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def descend(tree: BallTree, points: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Which centroid each ball or row goes to: whether whole balls, their numbers (or rows', in the tree's order), clusters.

    A ball's rows lie within its radius of the pivot. By the triangle
    inequality a centroid farther from the pivot than the nearest by more than
    two radii is nobody's: it is dropped for the ball and all below it. A ball
    with one centroid left goes whole; the rows of a leaf with more are compared
    one by one. Balls of one level are filtered together.
    """
    n = min(1, len(tree.child))
    balls, live = np.zeros(n, np.int64), np.ones((n, len(centroids)), bool)
    c = centroids.astype(np.float64)
    square = (c * c).sum(1)
    while len(balls):
        pivot = tree.pivot[balls]
        d = np.sqrt(np.maximum((pivot * pivot).sum(1)[:, None] + square[None, :] - 2 * (pivot @ c.T), 0))
        # what double precision may have lost: squares of at most `size` lose 1e-13 of it, a distance the root of that
        lost = 1e-6 * np.sqrt((pivot * pivot).sum(1) + square.max())
        d[~live] = np.inf
        live &= d <= (d.min(1) + 2 * tree.radius[balls] + 2 * lost)[:, None]
        one = live.sum(1) == 1
        yield True, balls[one], live[one].argmax(1)
        leaf = ~one & (tree.child[balls] < 0)
        length = tree.end[balls[leaf]] - tree.start[balls[leaf]]
        rows = np.repeat(tree.start[balls[leaf]] - np.concatenate([[0], length.cumsum()[:-1]]).astype(np.int64)[: len(length)], length) + np.arange(length.sum())
        if len(rows):
            exact = distances(points[rows], centroids)
            exact[~np.repeat(live[leaf], length, 0)] = np.iinfo(np.int64).max
            yield False, rows, exact.argmin(1)  # of ties the first, and numbers ascend
        inner = ~one & ~leaf
        child = tree.child[balls[inner]]
        balls, live = np.concatenate([child, child + 1]), np.concatenate([live[inner], live[inner]])


def whole_components(vectors: DataFrame, scale: int, size: int, key: str, vector: str) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of each component, of vectors with exactly ``size`` finite ones."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = (F.size(vector) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(F.greatest(F.least(v * F.lit(float(scale)), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, whole).alias("q"))


def _grown(batches: Iterable[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Vectors in blocks of at most ``rows``, each with its tree's arrays; one row a tree."""

    def tree_row(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        q, key = np.concatenate(points), pa.concat_arrays(ids)
        t = BallTree(q)
        binary = [np.ascontiguousarray(a).tobytes() for a in (q[t.order].astype("<i4"), t.pivot, t.radius, t.total, t.start, t.end, t.child)]
        return pa.RecordBatch.from_arrays([pa.array([key.take(pa.array(t.order)).to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in binary)], names=["ids", *TREE_COLUMNS])

    ids, points, have = [], [], 0
    for batch in batches:
        q = batch.column(1)
        values = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), size)
        at = 0
        while at < len(q):
            take = min(rows - have, len(q) - at)
            ids.append(batch.column(0).slice(at, take))
            points.append(values[at : at + take])
            at, have = at + take, have + take
            if have == rows:
                yield tree_row(ids, points)
                ids, points, have = [], [], 0
    if have:
        yield tree_row(ids, points)


TREE_COLUMNS = ("points", "pivot", "radius", "total", "start", "end", "child")
TREES = "ids array<long>, " + ", ".join(f"`{c}` binary" for c in TREE_COLUMNS)


def _read_trees(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, BallTree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            get = {c: np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in zip(TREE_COLUMNS, ("<i4", "<f8", "<f8", "<i8", "<i8", "<i8", "<i8"), strict=True)}
            t = BallTree.__new__(BallTree)
            t.__dict__ |= get
            points = get["points"].astype(np.int64).reshape(-1, size)
            t.order, t.pivot, t.total = np.arange(len(points)), get["pivot"].reshape(-1, size), get["total"].reshape(-1, size)
            yield batch.column("ids")[r].values, points, t


def _sums(trees: DataFrame, centroids: np.ndarray) -> list:
    """``cluster, n, total`` of one assignment: whole balls give their stored number and sum. One row a cluster."""
    k, size = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, points, tree in _read_trees(batches, size):
            for whole, which, cluster in descend(tree, points, centroids):
                np.add.at(n, cluster, (tree.end - tree.start)[which] if whole else 1)
                np.add.at(total, cluster, (tree.total if whole else points)[which])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster long, n long, total array<long>")
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(size))).alias("total"))
    return wide.collect()  # at most k rows of fixed width


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    size = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, tree in _read_trees(batches, size):
            cluster = np.zeros(len(points), np.int64)
            for whole, which, c in descend(tree, points, centroids):
                if whole:
                    for a, e, j in zip(tree.start[which].tolist(), tree.end[which].tolist(), c.tolist(), strict=True):
                        cluster[a:e] = j
                else:
                    cluster[which] = c
            d = np.zeros(len(points), np.int64)
            for a in range(0, len(points), 4096):
                d[a : a + 4096] = ((points[a : a + 4096] - centroids[cluster[a : a + 4096]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, *, size: int = 64, scale: int = 256, key: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS) -> DataFrame:
    """Lloyd's rounds on whole numbers: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``size`` finite components become floor(scale * x); the
    others take no part. The first centroids are the ``k`` vectors whose
    sha256 of ``seed:vec_id`` is smallest (all, if fewer); each round assigns
    every vector to the nearest centroid (ties: the smaller number) and moves
    each centroid that has vectors to floor(sum / count) of each component.
    Then all are assigned once more.

    Each task builds ball trees over blocks of the rows it reads, once; they
    are written to the shared folder, and every round filters the centroids
    down through them. Only k sums a round pass through the driver. Equal
    vectors, however many, are balls of radius 0.

    Null ids are clustered, but never start as centroids unless too few others
    are there. Rows that repeat an id are vectors of their own (the smaller
    vector starts first). Scaled components beyond 2**27 count as that, so
    that distances fit 64 bits; inertia beyond 64 bits counts as 2**63 - 1. An
    empty table gives an empty result.
    """
    ship_package(vectors.sparkSession)
    whole = whole_components(vectors, scale, size, key, vector)
    trees = cut(whole.mapInArrow(lambda batches: _grown(batches, size, tree_rows), TREES), "trees")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], out)
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        for r in _sums(trees, centroids):
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["total"]]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = cut(_assigned(trees, centroids), "assigned")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    fits = lambda c: F.least(c, most).cast("long")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    # k rows
    whole_inertia = inertia.agg(F.sum("d").alias("all"))
    per = inertia.crossJoin(F.broadcast(whole_inertia)).select("cluster", fits(F.col("d")).alias("cluster_inertia"), fits(F.col("all")).alias("inertia"))
    sha: Column = F.get(F.array(*map(F.lit, digest)), F.col("cluster"))
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))


def _sql(k: int, rounds: int, seed: int, size: int, scale: int) -> str:
    """The rounds written out, one pair of common tables each."""
    near = "row_number() OVER (PARTITION BY v.rid ORDER BY list_sum(list_transform(range(1, {n}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))), c.cluster)".format(n=size + 1)
    dist = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    parts = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1)::INTEGER AS cluster, q FROM v
  QUALIFY cluster < {k})"""]
    for r in range(rounds):
        mean = ", ".join(f"floor(sum(q[{i}]) / count(*))::BIGINT" for i in range(1, size + 1))
        parts.append(f"""a{r} AS MATERIALIZED (SELECT v.q, c.cluster FROM v, c{r} c QUALIFY {near} = 1),
m{r} AS MATERIALIZED (SELECT cluster, [{mean}] AS q FROM a{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    parts.append(f"""f AS (SELECT v.vec_id, c.cluster, {dist} AS distance, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM v, c{rounds} c QUALIFY {near} = 1)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM f""")
    return ",\n".join(parts[:-1]) + ",\n" + parts[-1]


SQL = _sql(40, 5, 2, 64, 256)
