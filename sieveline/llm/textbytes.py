"""Vectorised hashing of words and byte ranges over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling polynomial hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_pows = np.ones(1, np.uint64)
_invs = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    global _pows, _invs
    if len(_pows) <= n:
        size = 1 << int(n + 1).bit_length()
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _pows = np.concatenate([np.ones(1, np.uint64), np.full(size, BASE)]).cumprod(dtype=np.uint64)
            _invs = np.concatenate([np.ones(1, np.uint64), np.full(size, inv)]).cumprod(dtype=np.uint64)
    return _pows, _invs


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hash of any byte range of ``data`` in constant time; equal bytes give equal hashes.

    For features and anchors only: modulo a power of two, texts made for it
    collide. Where equal hashes are taken for equal bytes, see :class:`IdentityHash`.
    """

    def __init__(self, data: np.ndarray):
        self.pows, self.invs = _powers(len(data))
        with np.errstate(over="ignore"):
            self.acc = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * self.pows[: len(data)]).cumsum(dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.acc[end] - self.acc[start]) * self.invs[start] + (end - start).astype(np.uint64))


_PRIME = np.uint64((1 << 61) - 1)
_POINT = 0x0B7F3A5D9C61E482 % ((1 << 61) - 1)
_BLOCK = 1 << 18
_tables = {k: np.ones(1, np.uint64) for k in (1, -1)}


def _folded(x: np.ndarray) -> np.ndarray:
    """The same modulo 2**61 - 1, at most seven above it."""
    return (x & _PRIME) + (x >> np.uint64(61))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, in halves of 31 and 30 bits."""
    half, rest = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    al, ah, bl, bh = a & half, a >> np.uint64(31), b & half, b >> np.uint64(31)
    cross = al * bh + ah * bl
    return _reduced((ah * bh << np.uint64(1)) + (cross >> np.uint64(30)) + ((cross & rest) << np.uint64(31)) + al * bl)


def _point_powers(n: int, sign: int) -> np.ndarray:
    """_POINT**(sign * i) modulo 2**61 - 1, for i up to n."""
    table = _tables[sign]
    while len(table) <= n:
        step = np.uint64(pow(_POINT, sign * len(table), int(_PRIME)))
        table = _tables[sign] = np.concatenate([table, _times(table, step)])
    return table


class IdentityHash:
    """Hash of any byte range of ``data``, by which equal bytes are recognised.

    The bytes are the coefficients of a polynomial, taken modulo the prime
    2**61 - 1 at one point: two ranges of n bytes agree for at most n of 2**61
    points, whatever the bytes. The range's size enters the hash as well.
    """

    def __init__(self, data: np.ndarray):
        power = _point_powers(len(data), 1)
        self.inverse = _point_powers(len(data), -1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        half = np.uint64((1 << 31) - 1)
        for k in range(0, len(data), _BLOCK):  # sums of up to 2**22 products of 9 and 31 bits fit 64 bits
            byte = data[k : k + _BLOCK].astype(np.uint64) + np.uint64(1)
            each = power[k : k + len(byte)]
            low, high = (byte * (each & half)).cumsum(dtype=np.uint64), _folded((byte * (each >> np.uint64(31))).cumsum(dtype=np.uint64))
            # times 2**31 is a rotation of 61 bits
            high = ((high << np.uint64(31)) & _PRIME) + (high >> np.uint64(30))
            self.sums[k + 1 : k + 1 + len(byte)] = _reduced(_folded(low) + high + self.sums[k])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = _times(_reduced(self.sums[end] + (_PRIME - self.sums[start])), self.inverse[start])
        with np.errstate(over="ignore"):
            return mix(h + mix((end - start).astype(np.uint64)))


def chunks(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of about ``limit`` bytes.

    Yields first row, row after the last, the run's UTF-8 bytes and the rows'
    offsets in them. Nulls are empty. A row is never split; a longer one is a
    run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes that do not cross rows: starts, ends, row numbers."""
    n = len(keep)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], keep[:-1]])
    starts = np.flatnonzero(keep & (~before | edge[:-1]))
    after = np.concatenate([keep[1:], [False]])
    ends = np.flatnonzero(keep & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
