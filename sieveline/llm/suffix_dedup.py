"""Removal of repeated substrings with two-stage suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textbytes import IdentityHash, RangeHash, chunks

#: Bytes of the grams among which a window's anchor is the smallest.
GRAM = 32
#: A longer text is scanned in pieces of this size, overlapping by one byte less than a window.
PIECE = 1 << 19
#: Suffixes sorted together, unless one group has more.
BATCH = 60_000


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of ``length`` bytes, gathered into runs that equal windows share.

    A window's anchor is its gram of smallest hash, leftmost on ties: equal
    windows have equal anchors at equal places. Consecutive windows with one
    anchor form a run, cut in two where the anchor lies in the left or in the
    right part, so that all of a run's windows have more than half of a window
    in common; the hash of that part is the run's key. Returns key, hash of all
    bytes that the run's windows cover, row, first window, number of windows.
    """
    empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    gram = min(GRAM, length)
    n = len(data) - gram + 1
    width = length - gram + 1  # grams in a window
    if len(data) < length:
        return empty
    h = RangeHash(data)
    at = np.arange(n)
    bits = max(1, int(n).bit_length())
    low = (h(at, at + gram) >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    ok = start + length <= offsets[row + 1]
    start, anchor, row = start[ok], anchor[ok], row[ok]
    if not len(start):
        return empty
    reach = (length - gram) // 2
    left = anchor - start >= reach
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, s, is_left = anchor[first], start[first], left[first]
    # what all windows of the run share, around the anchor
    begin = np.where(is_left, a - reach, a)
    end = np.where(is_left, a + gram, a + gram + (length - gram - reach))
    same = IdentityHash(data)
    key = same(begin, end)
    key ^= is_left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return key, same(s, s + count + length - 1), row[first], s, count


_RUN = "key bigint, span bigint, rid bigint, start bigint, windows int, step int, times int"


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes and offsets of texts, with each one's row and place in it; long texts in overlapping pieces."""
    for first, last, data, offsets in chunks(column):
        if last - first == 1 and len(data) > PIECE:
            for k in range(0, len(data), PIECE):
                part = data[k : k + PIECE + length - 1]
                yield part, np.array([0, len(part)]), np.array([first]), np.array([k])
        else:
            yield data, offsets, np.arange(first, last), np.zeros(last - first, np.int64)


def folded(row: np.ndarray, key: np.ndarray, span: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal runs at equal distances in one text, as one: which to keep, their distance and number.

    A text that repeats a short string over and over has a run for every
    period; folded before the shuffle, they are one row.
    """
    order = np.lexsort((start, span, key, row))
    r, k, s, at = row[order], key[order], span[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return order, at, at
    size = np.diff(np.append(first, len(order)))
    step = np.diff(at, prepend=0)
    low = np.minimum.reduceat(np.where(new, np.iinfo(np.int64).max, step), first)
    high = np.maximum.reduceat(np.where(new, 0, step), first)
    even = np.repeat((size > 2) & (low == high), size)
    keep = new | ~even
    return order[keep], np.where(even, np.repeat(high, size), 0)[keep], np.where(even, np.repeat(size, size), 1)[keep]


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """``key, span, rid, start, windows, step, times``: every run of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for data, offsets, rows, base in _pieces(batch.column(1), length):
                key, span, row, start, count = anchored_runs(data, offsets, length)
                o, step, times = folded(row, key, span, start)
                key, span, row, start, count = key[o], span[o], row[o], start[o], count[o]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array(rid[rows[row]]), pa.array(start - offsets[row] + base[row])]
                    + [pa.array(x.astype(np.int32)) for x in (count, step, times)],
                    names=["key", "span", "rid", "start", "windows", "step", "times"],
                )

    return docs.select("rid", "text").mapInArrow(run, _RUN)


def _repeated_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and span, those whose key occurs again (in another row, or several times in this one).

    Adds ``lead`` (first row of its span) and ``many`` (a lead whose span
    occurs again). Streams: only one row is held back between batches.
    """
    held, before = None, None

    def work(rows: pa.RecordBatch, final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, before
        key, span = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        n = len(key)
        often = rows.column(6).to_numpy() > 1
        up = np.empty(n, bool)  # same key as the row before
        up[0] = before is not None and before[0] == key[0]
        up[1:] = key[1:] == key[:-1]
        same = np.empty(n, bool)
        same[0] = up[0] and before[1] == span[0]
        same[1:] = up[1:] & (span[1:] == span[:-1])
        down, again = np.append(up[1:], False), np.append(same[1:], False)
        stop = n if final else n - 1
        pick = np.flatnonzero((up | down | often)[:stop])
        if stop:
            before = (key[stop - 1], span[stop - 1])
        held = None if final else rows.slice(n - 1, 1)
        if len(pick):
            out = rows.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(~same[pick]), pa.array((~same & (again | often))[pick])], names=[*out.schema.names, "lead", "many"])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from work(batch, False)
    if held is not None:
        yield from work(held, True)


def suffix_order(spans: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of the first ``windows`` suffixes of each span.

    A suffix smaller than its successor is sorted directly, by its first
    ``length`` bytes; the others are induced: buckets of the first byte are
    scanned in ascending order, and each suffix met puts its predecessor, if
    that is larger than its successor, at the end of the predecessor's bucket.
    Of what follows a span's windows only one suffix is sorted along, the next
    one smaller than its successor, or the empty one at the span's end, from
    which the last windows are induced.

    Returns the sorted positions in the joined bytes (one more byte after each
    span), the joined bytes, and which positions are windows.
    """
    sizes = np.array([len(s) for s in spans], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    raw = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8)
    text = raw.astype(np.int16)
    text[base + sizes] = -1
    step = np.sign(np.diff(text, append=np.int16(-1)))
    step[base + sizes] = 1  # the end is smaller than whatever follows; no order is derived from it
    turn = np.flatnonzero(step)
    smaller = step[turn[np.searchsorted(turn, np.arange(len(text)))]] > 0
    window = np.zeros(len(text) + 1, np.int8)
    window[base] += 1
    window[base + windows] -= 1
    window = np.cumsum(window[:-1]).astype(bool)
    # the first suffix at or after the windows' end that is smaller than its successor
    ups = np.flatnonzero(smaller)
    last = ups[np.searchsorted(ups, base + windows)]
    direct = np.union1d(np.flatnonzero(window & smaller), last)
    owner = np.searchsorted(base, direct, "right") - 1
    keys = [spans[o][p : p + length] for o, p in zip(owner.tolist(), (direct - base[owner]).tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    alive = window.copy()
    for b, e in zip((base + windows).tolist(), last.tolist(), strict=True):
        alive[b:e] = True  # on the way from the sorted suffix back to the windows
    induced = alive & ~smaller
    heads = text[direct]
    cuts = np.searchsorted(heads, np.arange(-1, 257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(-1, 256):
        level = np.concatenate(waiting[c]) if c >= 0 and waiting[c] else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):  # predecessors with the same byte belong to this bucket too
            level = level - 1
            level = level[(level >= 0)]
            level = level[induced[level] & (text[level] == c)]
            bucket.append(level)
        bucket.append(direct[cuts[c + 1] : cuts[c + 2]])
        found = np.concatenate(bucket)
        if not len(found):
            continue
        order.append(found)
        before = found - 1
        before = before[before >= 0]
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            edges = np.flatnonzero(np.diff(byte, prepend=-1))
            for x, y in zip(edges, np.append(edges[1:], len(byte)), strict=True):
                waiting[int(byte[x])].append(before[x:y])
    return np.concatenate(order), raw, window


def common_prefixes(order: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix has in common with the next in order, ``length`` at most."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(length, np.uint8)]), length)
    out = np.empty(max(0, len(order) - 1), np.int64)
    for k in range(0, len(out), 8192):
        differ = rows[order[k : k + 8192][: len(out) - k]] != rows[order[k + 1 : k + 8193]]
        out[k : k + 8192] = np.where(differ.any(1), differ.argmax(1), length)
    return out


def repeated_windows(spans: list[bytes], windows: np.ndarray, length: int) -> list[np.ndarray]:
    """Which of each span's windows also start elsewhere in the spans."""
    order, raw, window = suffix_order(spans, windows, length)
    order = order[window[order]]
    same = common_prefixes(order, raw, length) >= length
    hit = np.zeros(len(raw), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    base = np.concatenate([[0], np.cumsum([len(s) + 1 for s in spans])])[:-1]
    return [hit[b : b + w] for b, w in zip(base.tolist(), windows.tolist(), strict=True)]


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges, as maximal runs (ranges that touch are one run)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def _sorted_groups(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows ``key, span, many, windows, bytes`` sorted by key, to ``key, span, from, to``: covered ranges in the span."""

    def solve(keys: list, ids: list, many: list, windows: list, spans: list) -> pa.RecordBatch:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for k, s, m, w, hit in zip(keys, ids, many, windows, repeated_windows(spans, np.array(windows, np.int64), length), strict=True):
            at = np.arange(w) if m else np.flatnonzero(hit)
            if len(at):
                a, b = covered(at, at + length)
                out[0].extend([k] * len(a))
                out[1].extend([s] * len(a))
                out[2].extend(a.tolist())
                out[3].extend(b.tolist())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "span", "from", "to"])

    held: tuple[list, ...] = ([], [], [], [], [])
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if size >= BATCH and row[0] != held[0][-1]:
                yield solve(*held)
                held, size = ([], [], [], [], []), 0
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += row[3]
    if held[0]:
        yield solve(*held)


def find_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``rid, ranges``: for each text (``rid, text``) the byte ranges ``a, b`` that repeated strings of ``length`` bytes cover, each ``times`` times, ``step`` apart."""
    occ = _occurrences(docs, length)
    occ = occ.repartition("key").sortWithinPartitions("key", "span", "rid", "start")
    occ = cut(occ.mapInArrow(_repeated_keys, _RUN + ", lead boolean, many boolean"), "repeat-candidates")
    leads = occ.where("lead").groupBy("rid").agg(F.collect_list(F.struct("start", "windows", "key", "span", "many")).alias("spans"))

    def slice_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                v = spans.values
                start, windows = (v.field(i).to_numpy() for i in (0, 1))
                parts = [raw[a : a + w + length - 1] for a, w in zip(start.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([v.field(2), v.field(3), v.field(4), v.field(1), pa.array(parts, pa.binary())], names=["key", "span", "many", "windows", "bytes"])

    texts = docs.hint("merge").join(leads, "rid").select(F.col("text").cast("binary").alias("text"), "spans")
    spans = texts.mapInArrow(slice_out, "key bigint, span bigint, many boolean, windows int, bytes binary")
    spans = spans.repartition("key").sortWithinPartitions("key", "span")
    found = cut(spans.mapInArrow(lambda b: _sorted_groups(b, length), "key bigint, span bigint, `from` bigint, `to` bigint"), "repeats")
    ranges = occ.join(found, ["key", "span"]).select("rid", F.struct((F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to")).alias("b"), "step", "times").alias("r"))
    return ranges.groupBy("rid").agg(F.collect_set("r").alias("ranges"))


def kept_parts(raw: bytes, ranges: pa.Scalar) -> tuple[bytes, int, int]:
    """What is left of a text without the ranges, the bytes removed, and in how many runs."""
    if not ranges.is_valid or not len(ranges):
        return raw, 0, 0
    a, b, step, times = (ranges.values.field(i).to_numpy().astype(np.int64) for i in range(4))
    shift = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * np.repeat(step, times)
    a, b = covered(np.repeat(a, times) + shift, np.repeat(b, times) + shift)
    left, right = np.concatenate([[0], b]).tolist(), np.append(a, len(raw)).tolist()
    return b"".join(raw[x:y] for x, y in zip(left, right, strict=True)), int((b - a).sum()), len(a)


def _with_ranges(docs: DataFrame, key: str, text: str, length: int, *columns: str) -> DataFrame:
    """``columns`` (of ``docs``, or ``_row``, all of them as a struct), the text as ``_text`` and its repeated ``_ranges``."""
    src = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(key, F.coalesce(F.col(text), F.lit(""))).alias("rid"))
    ranges = find_repeats(src.select("rid", "text"), length)
    picked = [F.col("_row") if c == "_row" else F.col("_row").getField(c).alias("doc_id") for c in columns]
    # every text is shuffled by rid, at every size alike
    return src.hint("merge").join(ranges, "rid", "left").select(*picked, F.col("text").cast("binary").alias("_text"), F.col("ranges").alias("_ranges"))


def remove_repeats(docs: DataFrame, length: int = 400, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. Texts are taken as UTF-8 bytes, null as empty;
    strings do not cross texts, and are judged on the input, so every copy goes,
    overlapping ones too. Texts shorter than ``length`` lose nothing. Repeated
    rows are copies of one another.

    Windows that could be equal are brought together by the key of their run
    (see :func:`anchored_runs`); keys that occur once are dropped, equal spans
    are sorted once. Each group of spans is put in order by two-stage suffix
    sorting, and neighbours' common prefixes tell which windows repeat. A key's
    rows stream through sorted partitions. Equal spans are recognised within a
    key by a hash modulo the prime 2**61 - 1, on top of the key's own; windows
    of different spans are compared by all their bytes.
    """
    rows = _with_ranges(docs, key, text, length, key)
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, sha = [], [], [], []
            for value, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw = value.as_py()
                kept, removed, runs = kept_parts(raw, ranges)
                n.append(len(raw))
                gone.append(removed)
                spans.append(runs)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, length: int = 400, *, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with repeated strings cut out of the texts.

    Where a cut falls inside a character, the character's other bytes go as
    well. A column ``chars`` gets the new number of characters. A row goes when
    cutting left nothing but white space; null and empty texts stay as they are.
    """
    rows = _with_ranges(docs, key, text, length, "_row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for value, ranges in zip(batch.column(1), batch.column(2), strict=True):
                raw, gone, _ = kept_parts(value.as_py(), ranges)
                kept.append(raw.decode(errors="ignore") if gone else None)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["_row", "_kept", "_removed"])

    out = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, _kept string, _removed bigint")
    out = out.where("_removed = 0 or trim(both from regexp_replace(_kept, '\\\\s+', ' ')) <> ''")
    new = F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("_row").getField(text))
    put = {text: new} | ({chars: F.when(F.col("_removed") > 0, F.length("_kept")).otherwise(F.col("_row").getField(chars)).cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return out.select(*(put.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
