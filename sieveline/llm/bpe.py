"""Byte-level BPE encoding and decoding with padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship_package

NONE = np.int32(2**31 - 1)
#: Pieces remembered by a Python worker before it starts afresh.
REMEMBERED = 200_000
#: Up to this many bytes, rows share a matrix; a longer stretch is a matrix of one row.
WIDEST = 256


class PairTable:
    """Open-addressed hash table from two adjacent ids to the id they merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        self.bits = max(4, int(max(1, len(keys)) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE)
        slot, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            free = rest[self.keys[slot[rest]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]  # of several, the last one written stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the pair does not merge, or an id is negative."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        key = key.ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        mask = len(self.keys) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        out = out.reshape(a.shape)
        out[(a < 0) | (b < 0)] = NONE
        return out


class BpeCodec:
    """Ranks of a byte-level vocabulary and the pattern that cuts texts into pieces.

    Ids equal those of the public library for rank files: a piece that is a
    token is that token, any other piece merges its lowest-ranked adjacent
    pair, leftmost first, until none is left.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        # pairs of bytes that stand together in some token; no merge joins any other two
        self.together = np.zeros((256, 256), bool)
        for token in self.ranks:
            row = np.frombuffer(token, np.uint8)
            self.together[row[:-1], row[1:]] = True
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rows, parts = list(pieces), {}
        buckets: dict[int, list[int]] = {}

        def deal(i: int) -> None:
            buckets.setdefault(max(4, 1 << (len(rows[i]) - 1).bit_length()), []).append(i)

        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) <= WIDEST:
                deal(i)
            else:  # cut where no merge can reach across; the parts are rows of their own
                byte = np.frombuffer(piece, np.uint8)
                edges = [0, *(np.flatnonzero(~self.together[byte[:-1], byte[1:]]) + 1).tolist(), len(piece)]
                parts[i] = range(len(rows), len(rows) + len(edges) - 1)
                rows += [piece[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                out += [b""] * len(parts[i])
                for k in parts[i]:
                    deal(k)
        for width, some in buckets.items():
            if width > WIDEST:
                for i in some:
                    out[i] = self._long(rows[i])
                continue
            step = max(1, (1 << 20) // width)
            for k in range(0, len(some), step):
                self._matrix(width, some[k : k + step], rows, out)
        for i, those in parts.items():
            out[i] = b"".join(out[k] for k in those)
        return out[: len(pieces)]

    def _matrix(self, width: int, rows: list[int], pieces: list[bytes], out: list[bytes]) -> None:
        """Merge the leftmost minimum-rank pair of every row, round by round; finished rows leave."""
        sizes = np.array([len(pieces[i]) for i in rows])
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        cols = np.arange(width + 1)
        ids = np.full((len(rows), width + 1), -1, np.int32)
        ids[:, :width] = np.where(cols[:width] < sizes[:, None], self.byte_ids[flat], -1)
        at = np.array(rows)
        ranks = np.full((len(rows), width + 1), NONE)
        ranks[:, :width] = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(at):
            pos = ranks[:, :width].argmin(1)
            each = np.arange(len(at))
            low = ranks[each, pos]
            done = low == NONE
            if done.any():
                for i, row, n in zip(at[done].tolist(), ids[done], sizes[done].tolist(), strict=True):
                    out[i] = row[:n].astype("<u4").tobytes()
                keep = ~done
                at, ids, ranks, sizes, pos, low = at[keep], ids[keep], ranks[keep], sizes[keep], pos[keep], low[keep]
                each = np.arange(len(at))
                if not len(at):
                    return
            tail = cols[:-1] > pos[:, None]
            ids[:, :-1] = np.where(tail, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(tail, ranks[:, 1:], ranks[:, :-1])
            ids[each, pos] = low
            sizes = sizes - 1
            ranks[each, pos] = self.pairs(low, ids[each, pos + 1])
            left = pos > 0
            ranks[each[left], pos[left] - 1] = self.pairs(ids[each[left], pos[left] - 1], low[left])

    def _long(self, piece: bytes) -> bytes:
        """A matrix of one row, whose rounds merge more than the leftmost minimum-rank pair: also the equal ones that would follow.

        They follow until a merge opens a better pair, with which the next round begins.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while True:
            ranks = self.pairs(ids[:-1], ids[1:])
            low = ranks.min() if len(ranks) else NONE
            if low == NONE:
                return ids.astype("<u4").tobytes()
            occ = np.flatnonzero(ranks == low)
            first = np.concatenate([[True], np.diff(occ) > 1])
            start = occ[first][np.cumsum(first) - 1]
            occ = occ[(occ - start) % 2 == 0]  # leftmost first, without overlap
            left = np.where(np.isin(occ - 2, occ), low, ids[np.maximum(occ - 1, 0)])
            left[occ == 0] = -1
            right = np.where(occ + 2 < len(ids), ids[np.minimum(occ + 2, len(ids) - 1)], -1)
            merged = np.full(len(occ), low)
            opens = np.flatnonzero(np.minimum(self.pairs(left, merged), self.pairs(merged, right)) < low)
            if len(opens):
                occ = occ[: opens[0] + 1]
            ids[occ] = low
            keep = np.ones(len(ids), bool)
            keep[occ + 1] = False
            ids = ids[keep]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        fresh = list({p for pieces in cut for p in pieces if p not in self.known})
        self.known.update(zip(fresh, self.encode_pieces([p.encode() for p in fresh]), strict=True))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], BpeCodec] = {}


def codec(path: str, pattern: str) -> BpeCodec:
    """One codec for a Python worker, kept between its tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BpeCodec(path, pattern)
    return _codecs[path, pattern]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch's column in runs of about ``limit`` bytes; nulls are empty."""
    col = batch.column(column)
    first, size, texts = 0, 0, []
    for k in range(len(col)):
        text = col[k].as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield first, texts
            first, size, texts = k + 1, 0, []
    if texts:
        yield first, texts


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, then decode its ids.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with
    ``with_ids`` also ``ids`` (array of int) and ``decoded`` (binary). Null and
    empty texts have no tokens. Rows are independent: no shuffle, memory is
    bounded by a batch, repeated rows and other columns do not matter.
    """
    ship_package(docs.sparkSession)
    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, 1):
                ids = c.encode_all(texts)
                raw = [c.decode(x) for x in ids]
                cols = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(raw, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
