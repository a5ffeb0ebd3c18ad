"""N-gram Jaccard join with PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .components import connected_components
from .textbytes import IdentityHash, chunks, mix, runs

#: Class representatives, and shingles of theirs, of a block; a verification task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 8192, 4_000_000
#: Members that a signature needs, or it is left out where a set can spare it.
FEW = 2
#: Signatures that a task gathers before it deals them out, and that are merged at a time.
GATHER = 1_000_000
#: Sets that a task remembers to have signed, so that copies are signed once.
SIGNED = 1_000_000

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit hashes, by row: (hashes, where each row's begin).

    Words are maximal runs of bytes other than ASCII white space, A-Z folded; a
    text of fewer than ``width`` words has one shingle, all its words.
    """
    n = len(offsets) - 1
    data = _FOLD[data]
    starts, ends, rows = runs(_WORD[data], offsets)
    h = IdentityHash(data)(starts, ends)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        full = max(0, len(h) - width + 1)
        g = np.full(full, np.uint64(width))
        for k in range(width):
            g = mix(g) + h[k : k + full]
        ok = rows[:full] == rows[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
        g, owner = mix(g[ok]), rows[:full][ok]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            s = count[short].astype(np.uint64)
            for k in range(width - 1):
                has = count[short] > k
                s[has] = mix(s[has]) + h[first[short[has]] + k]
            g, owner = np.concatenate([g, mix(s)]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[keep], owner[keep]
    return g, np.searchsorted(owner, np.arange(n + 1))


def set_keys(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets), dtype=np.uint64)])
        b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return mix(a[cuts[1:]] - a[cuts[:-1]]), mix(b[cuts[1:]] - b[cuts[:-1]])


class PartEnum:
    """Signature schemes for Jaccard similarity of at least num/den, by band of set sizes.

    Sizes fall into bands whose ends are den/num apart, so that similar sets
    lie in one band or in neighbours; a set signs the scheme of its own band and
    of the next. In the scheme of a band up to size r, similar sets differ in at
    most k = 2r(den-num)/(den+num) members. The domain is cut into n1 parts and
    each part into n2 pieces; every choice of n2 - 1 pieces of a part is a
    signature. Two similar sets share one for each part in which they differ in
    at most one member, and there are at least n1 - k/2 of those.

    Signatures of fewer than ``FEW`` members would bring unrelated sets
    together. So there are ``spare`` parts more than needed, and a set with such
    signatures in at most that many parts leaves them out: one part at least
    stays in which it shares a signature with any similar set. A set with more
    of them keeps them all. A band with k = 0 holds equal sets only and signs
    nothing.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        ends = [0]
        while ends[-1] < largest:
            ends.append((ends[-1] + 1) * den // num)
        self.ends = np.array(ends[1:])

    def scheme(self, band: int) -> tuple[int, int, int]:
        """n1, n2 and the spare parts of a band; n1 is 0 where only equal sets are similar."""
        r = int(self.ends[band])
        k = 2 * r * (self.den - self.num) // (self.den + self.num)
        if not k:
            return 0, 0, 0
        need = k // 2 + 1
        spare = (need + 4) // 5
        return need + spare, 2 if r >= 12 * (need + spare) else 3, spare

    def signatures(self, sets: np.ndarray, cuts: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All signatures of all sets: (signature, row of its set).

        ``size``: the sets' sizes, where members that no other set has are left
        out of ``sets``. Differences only shrink by that, so schemes by the true
        sizes still hold.
        """
        held = np.diff(cuts)
        size = held if size is None else size
        band = np.searchsorted(self.ends, size)
        out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        with np.errstate(over="ignore"):
            place, value = mix(sets ^ np.uint64(0x9E3779B97F4A7C15)), mix(sets + np.uint64(0x2545F4914F6CDD1D))
            for b in np.unique(band[size > 0]):
                mine = np.flatnonzero((band == b) & (size > 0))
                n = held[mine]
                at = np.repeat(cuts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
                who = np.repeat(np.arange(len(mine)), n)
                for scheme in (b, b + 1):
                    n1, n2, spare = self.scheme(scheme)
                    if not n1:
                        continue
                    pieces = n1 * n2
                    piece = ((place[at] >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)
                    # 64-bit sums in two halves, exact in doubles below 2**21 members a piece
                    slot = who * pieces + piece
                    low = np.bincount(slot, (value[at] & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(mine) * pieces)
                    high = np.bincount(slot, (value[at] >> np.uint64(32)).astype(np.float64), minlength=len(mine) * pieces)
                    each = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(len(mine), n1, n2)
                    sums = each.sum(2, keepdims=True, dtype=np.uint64) - each  # all pieces but one
                    name = (np.arange(pieces, dtype=np.uint64) + np.uint64((int(scheme) + 1) << 40)).reshape(1, n1, n2)
                    count = np.bincount(slot, minlength=len(mine) * pieces).reshape(len(mine), n1, n2)
                    few = count.sum(2, keepdims=True) - count < FEW
                    few &= (few.any(2).sum(1) <= spare)[:, None, None]
                    keep = ~few.ravel()
                    out.append(mix(sums + mix(name)).ravel()[keep])
                    rows.append(np.repeat(mine, pieces)[keep])
        return np.concatenate(out), np.concatenate(rows)


def link_groups(sets: np.ndarray, cuts: np.ndarray, num: int, den: int, side: np.ndarray | None = None, size: np.ndarray | None = None) -> np.ndarray:
    """Number of the component of each set, where sets of similarity num/den or more are linked.

    A set is compared with all others at once, by counting its members'
    occurrences in them. Sets of the largest component found so far need no
    comparison with one another, so after one set of it only those outside it
    are compared; no pair is listed. ``side``: only sets of different sides
    need to be compared (those of one side are compared elsewhere). ``size``:
    the sets' sizes, where members that no other set has are left out.
    """
    m = len(cuts) - 1
    owner = np.repeat(np.arange(m), np.diff(cuts))
    size = np.diff(cuts) if size is None else size
    _, inverse, count = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(count)])
    label = np.arange(m)
    todo = np.ones(m, bool)
    while True:
        big = np.bincount(label, minlength=m).argmax()
        open_ = np.flatnonzero(todo & (label != big))
        if not len(open_) or m == 1:
            return label
        x = int(open_[0])
        todo[x] = False
        ids = inverse[cuts[x] : cuts[x + 1]]
        n = count[ids]
        at = np.repeat(start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=m)
        linked = den * both >= num * (size + size[x] - both)
        linked[x] = False
        if side is not None:
            linked &= side != side[x]
        for other in np.unique(label[linked]).tolist():
            if other != label[x]:
                label[label == other] = label[x]


def _fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, rid, n, a, b``: a row's key, number of distinct shingles and the set's two hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(2)):
                sets, cuts = shingle_sets(data, offsets, width)
                a, b = set_keys(sets, cuts)
                own = [batch.column(k).slice(first, last - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(cuts).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["doc_id", "rid", "n", "a", "b"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id {kind}, rid bigint, n bigint, a bigint, b bigint")


def _packed(s: np.ndarray, a: np.ndarray, buckets: int) -> tuple[list, list, list]:
    """Pairs of a hash (ascending) and a set, dealt out by hash: bucket numbers, entries, ids.

    An entry is the hash's upper 48 bits and, below them, the place of the set
    in ``ids``; the bucket carries what the lower bits decided.
    """
    bucket = (s % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    numbers, entries, ids = [], [], []
    for x, y in zip(edges.tolist(), np.append(edges[1:], len(by)).tolist(), strict=True):
        for z in range(x, y, 1 << 16):
            part = by[z : min(y, z + (1 << 16))]
            who, place = np.unique(a[part], return_inverse=True)
            numbers.append(int(bucket[part[0]]))
            entries.append(((s[part] & ~np.uint64(0xFFFF)) | place.astype(np.uint64)).tobytes())
            ids.append(who.tobytes())
    return numbers, entries, ids


def _unpacked(entries: pa.Scalar, ids: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(entries.as_py(), np.uint64)
    return e >> np.uint64(16), np.frombuffer(ids.as_py(), np.uint64)[(e & np.uint64(0xFFFF)).astype(np.int64)]


def _new_sets(docs: DataFrame, width: int, work, schema: str) -> DataFrame:
    """``work`` on an iterator of (sets, cuts, sizes, ids), in which a task has each set of its texts once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets_of() -> Iterator[tuple]:
            signed: set[int] = set()
            for batch in batches:
                for _, _, data, offsets in chunks(batch.column(0)):
                    sets, cuts = shingle_sets(data, offsets, width)
                    a, _ = set_keys(sets, cuts)
                    new = np.zeros(len(a), bool)
                    for i, key in enumerate(a.tolist()):
                        if key not in signed:
                            signed.add(key)
                            new[i] = True
                    if len(signed) > SIGNED:
                        signed.clear()
                    size = np.diff(cuts)
                    yield sets[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])]), size[new], a[new]

        yield from work(sets_of())

    return docs.select("text").mapInArrow(run, schema)


def _sign(sets_of: Iterator[tuple], num: int, den: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, entries, ids, links``: signatures, packed.

    A signature that sets of one gathering share is sent once: the others are
    linked to its smallest set at once (``links``).
    """
    scheme, held = PartEnum(num, den), []

    def deal() -> pa.RecordBatch:
        s, a = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((a, s))  # the smallest set leads, so that a group's signatures name the same links
        s, a = s[order], a[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        lead = a[np.flatnonzero(new)[np.cumsum(new) - 1]]
        other = lead != a
        links = np.unique(np.stack([np.minimum(lead, a)[other], np.maximum(lead, a)[other]], 1), axis=0)
        numbers, entries, ids = _packed(s[new], a[new], buckets)
        joined = [links.tobytes(), *[b""] * (len(numbers) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(x, pa.binary()) for x in (entries, ids, joined))], names=["bucket", "entries", "ids", "links"])

    for sets, cuts, size, a in sets_of:
        s, rows = scheme.signatures(sets, cuts, size)
        if len(s):
            held.append((s, a[rows]))
        if sum(len(x) for x, _ in held) > GATHER:
            yield deal()
    if held:
        yield deal()


_SIGNED = "bucket int, entries binary, ids binary, links binary"


def _members(sets_of: Iterator[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, entries, ids``: every member of every set, packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def deal() -> pa.RecordBatch:
        s, a = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(s)
        numbers, entries, ids = _packed(s[order], a[order], buckets)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(entries, pa.binary()), pa.array(ids, pa.binary())], names=["bucket", "entries", "ids"])

    for sets, _, size, a in sets_of:
        if len(sets):
            held.append((sets, np.repeat(a, size)))
        if sum(len(x) for x, _ in held) > GATHER:
            yield deal()
    if held:
        yield deal()


def _recurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_members` sorted by bucket, to ``a, x``: the members that at least two sets have.

    Streams: held are one gathering and, for each member of the bucket, the
    first set that has it. A member of any number of sets gives one row a set.
    """
    bucket, held, count = None, [], 0
    known, firsts, shown = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def merge() -> pa.RecordBatch:
        nonlocal held, count, known, firsts, shown
        s, a = (np.concatenate(x) for x in zip((known, firsts), *held, strict=True))
        old = np.concatenate([shown, np.zeros(len(s) - len(shown), bool)])
        held, count = [], 0
        order = np.argsort(s, kind="stable")
        s, a, old = s[order], a[order], old[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        other = a != a[first][group]
        more = np.zeros(len(first), bool)
        more[group[other]] = True
        lead = first[more & ~old[first]]
        known, firsts, shown = s[first], a[first], old[first] | more
        pick = np.concatenate([lead, np.flatnonzero(other)])
        with np.errstate(over="ignore"):
            x = mix((s[pick] << np.uint64(16)) + np.uint64(bucket))
        return pa.RecordBatch.from_arrays([pa.array(a[pick].view(np.int64)), pa.array(x.view(np.int64))], names=["a", "x"])

    for batch in batches:
        for number, entries, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if number != bucket:
                if held:
                    yield merge()
                bucket = number
                known, firsts, shown = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
            held.append(_unpacked(entries, ids))
            count += len(held[-1][0])
            if count > GATHER:
                yield merge()
    if held:
        yield merge()


def _by_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, x`` sorted by ``a``, to ``a, x``: each set's distinct members as one array (bounded by its text)."""
    rest_a, rest_x = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(a: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((x, a))
        a, x = a[order], x[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
        a, x = a[keep], x[keep]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(a)).astype(np.int32)), pa.array(x))
        return pa.RecordBatch.from_arrays([pa.array(a[start]), lists], names=["a", "x"])

    for batch in batches:
        if batch.num_rows:
            a, x = np.concatenate([rest_a, batch.column(0).to_numpy()]), np.concatenate([rest_x, batch.column(1).to_numpy()])
            cut_ = int(np.searchsorted(a, a[-1])) if a[0] <= a[-1] else 0
            if cut_:
                yield out(a[:cut_], x[:cut_])
            rest_a, rest_x = a[cut_:], x[cut_:]
    if len(rest_a):
        yield out(rest_a, rest_x)


def _same_signature(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_sign` sorted by bucket, to edges: each set to the smallest that signed alike.

    Streams: held are one gathering and, for each signature of the bucket, its
    smallest set. A signature's sets are strung to that one, never paired.
    """
    bucket, held, count = None, [], 0
    sigs, firsts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def merge() -> np.ndarray:
        nonlocal held, count, sigs, firsts
        s, a = (np.concatenate(x) for x in zip(*held, strict=True))
        held, count = [], 0
        # what led so far is linked to a smaller set that comes later
        s, a = np.concatenate([sigs, s]), np.concatenate([firsts, a])
        order = np.lexsort((a, s))
        s, a = s[order], a[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        lead = a[np.flatnonzero(new)[np.cumsum(new) - 1]]
        sigs, firsts = s[new], a[new]
        other = lead != a
        return np.stack([np.minimum(lead, a)[other], np.maximum(lead, a)[other]], 1)

    def edges(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(pairs, axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        for number, entries, ids, links in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
            if number != bucket:
                if held:
                    yield edges(merge())
                bucket, sigs, firsts = number, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            if len(links.as_py()):
                yield edges(np.frombuffer(links.as_py(), np.uint64).reshape(-1, 2))
            held.append(_unpacked(entries, ids))
            count += len(held[-1][0])
            if count > GATHER:
                yield edges(merge())
    if held:
        yield edges(merge())


def _verified(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows ``task, side, a, n, held``, sorted by task, to ``task, a, root``: links within each task.

    ``held`` is a text, or an array of the members that other sets have too.
    """

    def solve(task: int, sides: list, ids: list, true: list, held: list) -> pa.RecordBatch:
        if isinstance(held[0], str):
            parts, sizes = [], []
            for _, _, data, offsets in chunks(pa.array(held, pa.large_string())):
                sets, cuts = shingle_sets(data, offsets, width)
                parts.append(sets)
                sizes.append(np.diff(cuts))
            sets, sizes = np.concatenate(parts), np.concatenate(sizes)
        else:
            sets, sizes = np.concatenate(held), np.array([len(x) for x in held])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        side = np.array(sides)
        label = link_groups(sets, cuts, num, den, None if side.min() == side.max() else side, np.array(true, np.int64))
        root: dict[int, int] = {}
        for l, i in zip(label.tolist(), ids, strict=True):
            root[l] = min(root.get(l, i), i)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([task] * len(ids), ids, [root[l] for l in label.tolist()])], names=["task", "a", "root"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides, ids, true, held = None, [], [], [], []
        for batch in batches:
            arrays = pa.types.is_list(batch.schema.field(4).type)
            for t, s, i, n, x in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if t != task and ids:
                    yield solve(task, sides, ids, true, held)
                    sides, ids, true, held = [], [], [], []
                task = t
                sides.append(s)
                ids.append(i)
                true.append(n)
                held.append(x.values.to_numpy() if arrays else x.as_py())
        if ids:
            yield solve(task, sides, ids, true, held)

    return rows.mapInArrow(run, "task bigint, a bigint, root bigint")


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, *, key: str = "doc_id", text: str = "text", block: int = BLOCK, thin: bool = False, rows: bool = False) -> DataFrame:
    """Connected components of the exact Jaccard join: ``doc_id, n_shingles, component_id``.

    Two texts link when den * |intersection| >= num * |union| of their sets of
    distinct ``width``-word shingles (as 64-bit hashes of their words' hashes, which
    are polynomials modulo the prime 2**61 - 1). A component is
    named by its smallest id.

    Texts with equal sets are one class, signed once. Sets that share a PartEnum
    signature are candidates, strung together in chains; the chains' components
    hold every link. Each component's representatives are compared exactly:
    up to ``block``, and ``BLOCK_SHINGLES`` shingles, in one task, more in tasks
    of two blocks each, so that no task holds an unbounded group, be it of many
    or of long texts; their results join in another components run. With ``thin``, for lower thresholds, members that only one set has are
    left out first, counted by a packed exchange of all members; a set of which
    less than num / den is left links with nothing, and the others sign and are
    compared without texts (members then are 48 bits of hash and a bucket).
    A larger group is first cut by size, into windows of two neighbouring
    bands, as sets further apart in size cannot be similar. Texts without words, and null texts, have empty sets and link with
    nothing. Null ids share links but never name a component (unless all ids of
    it are null). Repeated rows are each returned, and rows of one id with
    different texts are documents of their own; other columns are not read. With
    ``rows``, also ``rid``, a row's key (the hash of its id and text, a null text
    as an empty one), and ``root``, which names its component whatever the ids
    (null for an empty set).
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    prints = cut(_fingerprints(docs, width), "fingerprints")
    # about a million shingles a bucket, whatever the input's size
    total = prints.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000 + 1)
    # a class is known by ``a``; ``rep`` is its smallest id, ``rid`` a row that has its text
    classes = prints.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"))
    if thin:
        members = _new_sets(docs, width, lambda sets: _members(sets, buckets), "bucket int, entries binary, ids binary")
        pairs = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_recurring, "a bigint, x bigint")
        left = pairs.repartition("a").sortWithinPartitions("a").mapInArrow(_by_set, "a bigint, x array<bigint>")
        left = cut(left.join(classes.select("n", "a"), "a").where(F.size("x") * den >= F.col("n") * num).select("a", "n", "x"), "thinned")

        def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                x = batch.column(2)
                cuts = np.asarray(x.offsets, np.int64)
                yield x.values.to_numpy().view(np.uint64)[cuts[0] : cuts[-1]], cuts - cuts[0], batch.column(1).to_numpy(), batch.column(0).to_numpy().view(np.uint64)

        kept = left.agg(F.sum(F.size("x"))).first()[0] or 0
        spread = left.select("a", "n", "x").mapInArrow(lambda batches: _sign(sets_of(batches), num, den, kept // 1_000_000 + 1), _SIGNED)
    else:
        spread = _new_sets(docs, width, lambda sets: _sign(sets, num, den, buckets), _SIGNED)
    spread = spread.repartition("bucket").sortWithinPartitions("bucket")
    edges = cut(spread.mapInArrow(_same_signature, "u bigint, v bigint").distinct(), "candidates")
    groups = cut(connected_components(edges), "candidate-groups")
    named = cut(classes.join(groups.withColumnRenamed("node", "a"), "a").select("rid", "n", "a", "component"), "candidate-classes")
    # similar sets lie in one band of sizes or in neighbours: a group falls into windows of two bands
    ends = F.array(*[F.lit(int(e)) for e in PartEnum(num, den).ends])
    band = F.size(F.filter(ends, lambda e: e < F.col("n")))
    sized = named.join(named.groupBy("component").agg(F.count("*").alias("all"), F.sum("n").alias("members")), "component").where(F.col("all") > 1)
    small = (F.col("all") <= block) & (F.col("members") <= BLOCK_SHINGLES)  # one task, without windows
    placed = sized.withColumn("window", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.array(band, band + 1)))).select("rid", "n", "a", "component", "window")
    sizes = placed.groupBy("component", "window").agg(F.count("*").alias("size"), F.sum("n").alias("members")).where("size > 1")
    blocks = F.least(F.col("size"), F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("members") / BLOCK_SHINGLES))).cast("int")
    placed = placed.join(sizes, ["component", "window"]).withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rid", "n", "a", "side", (F.col("window") >= 0).alias("many"),
        F.xxhash64("component", "window", F.least("side", "other"), F.greatest("side", "other")).alias("task"),
    )
    tasks = cut(tasks, "candidate-tasks")
    if thin:
        compared = tasks.hint("merge").join(left.select("a", "x").hint("merge"), "a").select("task", "side", "a", "n", F.col("x").alias("held"))
    else:
        # texts are shuffled once by row, at every size alike: the rows grow with the input, so neither side is broadcast
        reps = tasks.select("rid").distinct().hint("merge")
        once = docs.join(reps, "rid", "left_semi").dropDuplicates(["rid"])
        compared = once.join(tasks.hint("merge"), "rid").select("task", "side", "a", "n", F.col("text").alias("held"))
    links = cut(_verified(compared.repartition("task").sortWithinPartitions("task", "a"), width, num, den), "links")
    many = tasks.where("many").select("task").distinct()
    single = links.join(many, "task", "left_anti").select("a", "root")
    wide = cut(links.join(many, "task", "left_semi").where("a <> root").select(F.col("a").alias("u"), F.col("root").alias("v")).distinct(), "wide-links")
    roots = single if wide.isEmpty() else single.union(connected_components(wide).select(F.col("node").alias("a"), F.col("component").alias("root")))
    linked = classes.join(roots, "a").select("n", "a", "b", "rep", "root")
    names = linked.groupBy("root").agg(F.min("rep").alias("name"))
    final = classes.join(linked.join(names, "root").select("n", "a", "b", "name", "root"), ["n", "a", "b"], "left").select("n", "a", "b", F.coalesce("name", "rep").alias("class_root"), F.coalesce("root", "a").alias("root"))
    out = prints.join(final, ["n", "a", "b"], "left")
    drop_cut(edges)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_root", "doc_id").alias("component_id"), *(["rid", "root"] if rows else []))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.u, p.v FROM p JOIN n a ON a.doc_id = p.u JOIN n b ON b.doc_id = p.v WHERE 100 * p.i >= 90 * (a.n + b.n - p.i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
