"""Exact similarity join of sets by prefix filtering: overlap against the smaller set."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..shared import cut

#: Sets and members of one block; a larger set is a block of its own.
BLOCK_SETS, BLOCK_MEMBERS = 1024, 1 << 18
#: Members compared at a time.
STEP = 1 << 22
#: Parts that members are dealt into, sets packed at a time, and members looked through at a time.
PARTS, PACK, LOOK = 1024, 1 << 14, 1 << 21


def shared_members(sets: DataFrame) -> DataFrame:
    """``id, t`` of sets ``id, s`` (one row an id): structs ``df, g, w`` of members that another set has too.

    Members that stand in the same sets are one entry: the number of those sets,
    a hash of them, and how many members they are. Every holder of such a group
    holds all of it, so two sets share the sum of ``w`` over the ``g`` that both
    have. Sets without a shared member are left out; the rarest entries come first.
    """
    by = Window.partitionBy("h")
    each = sets.select("id", F.explode("s").alias("h")).select("id", F.count("*").over(by).alias("df"), F.bit_xor(F.xxhash64("id")).over(by).alias("g")).where("df > 1")
    # dealt by set at once: both groupings below go by it
    counted = each.repartition("id").groupBy("id", "df", "g").agg(F.count("*").alias("w"))
    return counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g", "w"))).alias("t"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets ``id, s`` to rows ``p, base, owner, h``: members of one part of the hashes and, as 16 bits each, the places of their sets behind ``base``.

    A negative part has the sizes and ids of all sets instead.
    """
    task, base = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 36
    for whole in batches:
        for at in range(0, whole.num_rows, PACK):
            batch = whole.slice(at, PACK)
            offsets = np.asarray(batch.column(1).offsets, np.int64)
            sizes = np.diff(offsets)
            h = batch.column(1).values.to_numpy()[offsets[0] : offsets[-1]]
            part = ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            owner, h = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order], h[order]
            ends = np.bincount(part, minlength=PARTS).cumsum()
            used = np.flatnonzero(np.diff(ends, prepend=0)).tolist()
            cuts = [(int(ends[p - 1]) if p else 0, int(ends[p])) for p in used]
            owners = [sizes.astype(np.int32).tobytes(), *(owner[x:y].tobytes() for x, y in cuts)]
            members = [batch.column(0).to_numpy().tobytes(), *(h[x:y].tobytes() for x, y in cuts)]
            parts = pa.array([-1 - task, *used], pa.int32())
            yield pa.RecordBatch.from_arrays([parts, pa.array([base] * len(parts), pa.int64()), pa.array(owners, pa.binary()), pa.array(members, pa.binary())], names=["p", "base", "owner", "h"])
            base += batch.num_rows


def _entries(k: np.ndarray, df: np.ndarray, g: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(df.astype(np.int32)), pa.array(g), pa.array(w.astype(np.int32))], names=["k", "df", "g", "w"])


def _sharing(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Of sets and members, all holders of each member among them: ``k, df, g, w`` of what more than one set has."""
    k, h = (np.concatenate([x[c] for x in held]) for c in (0, 1))
    order = np.argsort(h)
    k, h = k[order], h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(starts, append=len(h))
    group = np.bitwise_xor.reduceat(_mixed(k), starts).view(np.int64)
    shared = np.repeat(count > 1, count)
    k, df, g = k[shared], np.repeat(count, count)[shared], np.repeat(group, count)[shared]
    order = np.lexsort((g, k))
    k, df, g = k[order], df[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])) if len(k) else np.zeros(0, np.int64)
    return _entries(k[first], df[first], g[first], np.diff(first, append=len(k)))


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_packed`, a part's together, to :func:`_sharing`; a set's own row has ``df`` 0, its id as ``g`` and its size as ``w``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, last = 0, None
    for batch in batches:
        for p, base, owner, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = np.frombuffer(h, np.int64)
            if p < 0:
                yield _entries(base + np.arange(len(h)), np.zeros(len(h)), h, np.frombuffer(owner, np.int32))
                continue
            if p != last and n >= LOOK:
                yield _sharing(held)
                held, n = [], 0
            held.append((base + np.frombuffer(owner, np.uint16).astype(np.int64), h))
            n, last = n + len(h), p
    if held:
        yield _sharing(held)


def sized_members(sets: DataFrame) -> DataFrame:
    """``id, n, t`` of every set ``id, s`` (whole numbers): its size, and ``t`` of :func:`shared_members`, empty where it shares none.

    Members are dealt out once, by parts of their hashes, and packed: a member is
    ten bytes of a row, not a row. What sets share is found part by part.
    """
    ship_package(sets.sparkSession)
    kind = sets.schema["id"].dataType
    packed = sets.select(F.col("id").cast("long").alias("id"), F.coalesce("s", F.array().cast("array<long>")).alias("s")).mapInArrow(_packed, "p int, base long, owner binary, h binary")
    found = packed.repartition("p").sortWithinPartitions("p").mapInArrow(_shared, "k long, df int, g long, w int")
    # dealt by set at once: both groupings below go by it
    entries = found.repartition("k").groupBy("k", "df", "g").agg(F.sum("w").alias("w"))
    own = F.col("df") == 0
    each = entries.groupBy("k").agg(F.max(F.when(own, F.col("g"))).alias("id"), F.max(F.when(own, F.col("w"))).cast("int").alias("n"), F.sort_array(F.collect_list(F.when(~own, F.struct(F.col("df").cast("long").alias("df"), "g", "w")))).alias("t"))
    return each.select(F.col("id").cast(kind).alias("id"), "n", "t")


def _prefixes(offsets: np.ndarray, weights: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """How many entries of each list a smaller set needs, so that what is behind them is less than it has to share."""
    ends = np.concatenate([[0], weights.cumsum()])
    row = np.repeat(np.arange(len(sizes)), np.diff(offsets))
    behind = ends[offsets[1:]][row] - ends[:-1]
    return np.bincount(row[behind >= np.ceil(sizes * least - 1e-9)[row]], minlength=len(sizes))


def _blocked(batches: Iterable[pa.RecordBatch], least: float, most_sets: int, most_members: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order they come, numbered into blocks of a bounded number of sets and members, with their prefixes."""
    first, number, sets, members = TaskContext.get().partitionId() << 32, 0, 0, 0
    for batch in batches:
        blocks = np.zeros(batch.num_rows, np.int64)
        offsets = np.asarray(batch.column("w").offsets, np.int64)
        sizes = np.diff(offsets)
        weights = batch.column("w").values.to_numpy()[offsets[0] : offsets[-1]]
        prefixes = _prefixes(offsets - offsets[0], weights, batch.column("n").to_numpy(), least)
        for r, size in enumerate(sizes.tolist()):
            if sets and (sets >= most_sets or members + size > most_members):
                number, sets, members = number + 1, 0, 0
            sets, members, blocks[r] = sets + 1, members + size, first + number
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), pa.array(prefixes.astype(np.int32))], names=[*batch.schema.names, "block", "prefix"])


def overlaps(xt: np.ndarray, xo: np.ndarray, yt: np.ndarray, yo: np.ndarray, nx: int, ny: int, xw: np.ndarray | None = None) -> np.ndarray:
    """Members that each of nx sets shares with each of ny: members with the numbers of their sets, on both sides; ``xw``: how much each counts."""
    order = np.argsort(yt, kind="stable")
    yt, yo = yt[order], yo[order]
    low = np.searchsorted(yt, xt, "left")
    count = np.searchsorted(yt, xt, "right") - low
    out = np.zeros(nx * ny, np.int64)
    ends = count.cumsum()
    at = 0
    while at < len(xt):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
        c = count[at:upto]
        start = np.repeat(low[at:upto] - (c.cumsum() - c), c)
        pair = np.repeat(xo[at:upto], c) * ny + yo[start + np.arange(c.sum())]
        out += np.bincount(pair, None if xw is None else np.repeat(xw[at:upto], c), minlength=nx * ny).astype(np.int64)
        at = upto
    return out.reshape(nx, ny)


def _compared(groups: Iterable[tuple[np.ndarray, ...]], least: float) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: each set's number of links, and its most similar earlier one (ties: the earliest)."""
    for side, ids, sizes, length, members, weights in groups:
        owner = np.repeat(np.arange(len(ids)), length)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            continue
        split = side[owner] == 0
        both = overlaps(members[split], owner[split] - left[0], members[~split], owner[~split] - right[0], len(left), len(right), weights[split])
        nx, ny, x, y = sizes[left][:, None], sizes[right][None, :], ids[left][:, None], ids[right][None, :]
        ok = (both >= np.maximum(1, np.ceil(nx * least - 1e-9))) & ((nx < ny) | ((nx == ny) & (x < y)))
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        score, a, b = both[i, j] / sizes[left][i], ids[left][i], ids[right][j]
        early, late = np.minimum(a, b), np.maximum(a, b)
        named, links = np.unique(np.concatenate([a, b]), return_counts=True)
        order = np.lexsort((early, -score, late))
        late, early, score = late[order], early[order], score[order]
        best = np.flatnonzero(np.diff(late, prepend=late[0] - 1))
        at = np.searchsorted(late[best], named)
        has = (at < len(best)) & (late[best[np.minimum(at, len(best) - 1)]] == named)
        pick = best[np.minimum(at, len(best) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(links), pa.array(early[pick], mask=~has), pa.array(score[pick], mask=~has)], names=["id", "links", "matched_id", "score"])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of a pair of blocks, which stand together: sides, ids, sizes, lengths, members and weights. Columns: bx, by, side, id, n, t, w."""
    held: list[tuple[np.ndarray, ...]] = []
    own: tuple[int, int] | None = None

    def merged() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([h[k] for h in held]) for k in range(6))

    for batch in batches:
        if not batch.num_rows:
            continue
        bx, by, side, ids, n = (batch.column(k).to_numpy() for k in range(5))
        offsets = np.asarray(batch.column(5).offsets, np.int64)
        values, weights = batch.column(5).values.to_numpy(), batch.column(6).values.to_numpy()
        ahead = int(np.asarray(batch.column(6).offsets, np.int64)[0]) - int(offsets[0])
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(bx) != 0) | (np.diff(by) != 0)]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
            key = (int(bx[a]), int(by[a]))
            if held and key != own:
                yield merged()
                held = []
            own = key
            held.append((side[a:b], ids[a:b], n[a:b], np.diff(offsets[a : b + 1]), values[offsets[a] : offsets[b]], weights[offsets[a] + ahead : offsets[b] + ahead]))
    if held:
        yield merged()


def overlap_join(sets: DataFrame, least: float, *, block_sets: int = BLOCK_SETS, block_members: int = BLOCK_MEMBERS, members: DataFrame | None = None) -> DataFrame:
    """``id, first_id, links, matched_id, score`` of sets that share ``least`` of the smaller one, exactly.

    ``sets``: ``id`` (whole numbers, one row each), ``s`` (distinct 64-bit
    members). Equal sets are one class, named by its smallest id ``first_id``;
    ``links`` counts the other classes linked with it. ``matched_id, score`` is
    the most similar earlier set (ties: the earliest); null where there is none.
    Rows without a link or an equal are left out; empty and null sets link with
    nothing. An empty table gives an empty result.

    The overlap against the smaller set is the larger of Jaccard similarity and
    containment either way, so it decides for all three. Members that one set
    has alone are left out, but for the sets' sizes; members that stand in the
    same sets go as one entry with their number (:func:`shared_members`). Entries
    stand by ascending frequency: a smaller set of n members has to have one of
    its first in any set it links with, up to where fewer than ``ceil(least * n)``
    members are left, and sets with fewer in all link with no larger one. Sets are dealt into blocks,
    copies of one text next to each other; pairs of blocks meet where they
    share such a member, with those of their sets that do, and count overlaps
    there. So no group of copies becomes rows of pairs, and none is capped.
    ``members``: :func:`sized_members` of the sets, where they are at hand.
    """
    ship_package(sets.sparkSession)
    if members is None:
        members = cut(sized_members(sets.select(F.col("id").cast("long").alias("id"), "s").where("id is not null")), "members")
    # sets that share all they have, with the same sets, are equal
    weight = F.aggregate("t", F.lit(0).cast("long"), lambda s, e: s + e["w"])
    digest = F.md5(F.array_join(F.transform("t", lambda e: e["g"].cast("string")), ","))
    keyed = members.where("id is not null and n > 0").select(F.col("id").cast("long").alias("id"), "n", "t", F.when(weight == F.col("n"), digest).otherwise(F.col("id").cast("string")).alias("d"))
    classes = cut(keyed.groupBy("d").agg(F.min("id").alias("first_id"), F.count("*").alias("members")), "classes")
    members = keyed.select("id", "d").join(classes, "d").select("id", "first_id", "members")
    # of a class its first goes on, without what no other class has
    lists = keyed.select("id", "n", "t").join(classes.select(F.col("first_id").alias("id"), "members"), "id").select("id", "n", F.filter("t", lambda e: e["df"] > F.col("members")).alias("t")).where("size(t) > 0")
    # copies of one text have their largest common part in common
    heaviest = F.array_max(F.transform("t", lambda e: F.struct(e["w"].alias("w"), e["g"].alias("g"))))["g"]
    lists = lists.select("id", "n", F.col("t.g").alias("t"), F.col("t.w").alias("w"), heaviest.alias("k"))
    dealt = lists.repartitionByRange("k", "id").sortWithinPartitions("k", "id").drop("k")

    def blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocked(batches, least, block_sets, block_members)

    docs = cut(dealt.mapInArrow(blocked, "id long, n int, t array<long>, w array<long>, block long, prefix int"), "blocks")
    left = docs.where("prefix > 0").select(F.explode(F.slice("t", F.lit(1), F.col("prefix"))).alias("h"), F.col("block").alias("bx"), "id")
    at_left = cut(left.select("h", "bx").distinct(), "prefixes")
    right = docs.select(F.explode("t").alias("h"), F.col("block").alias("by"), "id").join(at_left.select("h").distinct(), "h", "left_semi")
    meet = cut(at_left.join(right.select("h", "by").distinct(), "h"), "meetings")
    x = meet.join(left, ["h", "bx"]).select("bx", "by", F.lit(0).alias("side"), "id").distinct()
    y = meet.join(right, ["h", "by"]).select("bx", "by", F.lit(1).alias("side"), "id").distinct()
    rows = x.union(y).join(docs.select("id", "n", "t", "w"), "id").select("bx", "by", "side", "id", "n", "t", "w")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(_groups(batches), least)

    found = rows.repartition("bx", "by").sortWithinPartitions("bx", "by", "side").mapInArrow(run, "id long, links long, matched_id long, score double")
    best = found.groupBy("id").agg(F.sum("links").alias("links"), F.max(F.struct("score", (-F.col("matched_id")).alias("m"))).alias("b"))
    best = cut(best.select(F.col("id").alias("first_id"), "links", F.col("b.score").alias("score"), (-F.col("b.m")).alias("matched_id")), "links")
    # a later member of a class equals its first; an earlier set that holds them all comes before that
    out = members.join(best, "first_id", "left").where("members > 1 or links is not null")
    equal = (F.col("id") > F.col("first_id")) & ~F.coalesce(F.col("score") == 1.0, F.lit(False))
    return out.select(
        "id", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.when(equal, F.col("first_id")).otherwise(F.col("matched_id")).alias("matched_id"), F.when(equal, 1.0).otherwise(F.col("score")).alias("score")
    )
