"""Quality classifier: hashed word n-grams, FTRL-trained logistic regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .textbytes import RangeHash, chunks, mix, runs

#: Labelled rows that a model is fitted on at most: a bounded sample, by hash of the id.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 18

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 punctuation
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def in_split(key: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled texts: those whose ids hash lowest.

    A document with several labels has the largest. The chosen ids are at most
    ``rows``, whatever the input, so they may be broadcast.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
        .groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    return docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "y", "text")


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram, by family.

    Tokens are runs of letters and digits, or of punctuation. Families: word
    unigrams, word bigrams, and trigrams of token shapes (case, digits, length,
    the punctuation itself, and whether a token repeats the one or two before
    it), which carry over to words never seen.
    """
    kind = _KIND[data]
    starts, ends, rows = (np.concatenate(x) for x in zip(*(runs(kind == k, offsets) for k in (1, 2)), strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, rows = starts[order], ends[order], rows[order]
    word = kind[starts] == 1 if len(starts) else np.zeros(0, bool)
    h = RangeHash(data)(starts, ends)
    size = ends - starts
    upper, lower, digit = (_sums(t[data]) for t in (_UPPER, _LOWER, _DIGIT))
    up, low, dig = (s[ends] - s[starts] for s in (upper, lower, digit))
    first_up = _UPPER[data[starts]] if len(starts) else up
    case = np.where(dig == size, 4, np.where((up == 0), 0, np.where((low == 0) & (up > 1), 3, np.where(first_up & (up == 1), 1, 2))))
    long_ = np.minimum(np.maximum(size.astype(np.int64), 1).astype(float), 256.0)
    shape = np.where(word, (8 + case * 16 + np.log2(long_).astype(np.int64)).astype(np.uint64), h | np.uint64(1 << 63))
    same = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        same[1:] |= ((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])).astype(np.uint64)
    if len(h) > 2:
        same[2:] |= ((h[2:] == h[:-2]) & (rows[2:] == rows[:-2]) & word[2:]).astype(np.uint64) << np.uint64(1)
    with np.errstate(over="ignore"):
        shape = mix(shape * np.uint64(4) + same)
        out = [(mix(h + np.uint64(1)), rows)]
        two = rows[1:] == rows[:-1]
        out.append((mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5) + np.uint64(2))[two], rows[1:][two]))
        three = rows[2:] == rows[:-2]
        out.append((mix(shape[:-2] * np.uint64(3) + shape[1:-1] * np.uint64(5) + shape[2:] * np.uint64(7) + np.uint64(3))[three], rows[2:][three]))
        out.append((mix(shape + np.uint64(4)), rows))
    return [((x % np.uint64(buckets)).astype(np.int64), r) for x, r in out]


#: Each family's n-gram frequencies sum to this in a text.
MASS = 8.0


def vectors(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vector (distinct buckets, values) of each text: relative n-gram frequencies."""
    n = len(offsets) - 1
    parts = []
    for idx, rows in features(data, offsets, buckets):
        count = np.bincount(rows, minlength=n)
        parts.append((rows * buckets + idx, MASS / count[rows]))
    key, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, inverse = np.unique(key, return_inverse=True)
    value = np.bincount(inverse, weight, minlength=len(distinct))
    cut = np.searchsorted(distinct, np.arange(n + 1) * buckets)
    return [(distinct[a:b] % buckets, value[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class LogisticModel:
    """Weights by bucket and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1: the dot product of weights and n-gram frequencies."""
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        for idx, rows in features(data, offsets, len(self.weights)):
            count = np.bincount(rows, minlength=n)
            total += MASS * np.bincount(rows, self.weights[idx], minlength=n) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, buckets: int = BUCKETS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 0.2, seed: int = 7) -> LogisticModel:
    """Follow-the-regularised-leader updates, one example at a time.

    Coordinate i keeps the sum z of adjusted gradients and n of their squares;
    its weight is the minimiser of the regularised sum of all losses so far.
    """
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order.tolist():
            idx, val = rows[k]
            idx, val = np.append(idx.astype(np.int64), buckets), np.append(val.astype(np.float64), 1.0)
            zi, ni = z[idx], n[idx]
            w = solve(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ val, -500, 500)))
            g = (p - labels[k]) * val
            root = np.sqrt(ni + g * g)
            z[idx] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
    w = solve(z, n)
    return LogisticModel(w[:-1].astype(np.float32), float(w[-1]))


def fit(train: DataFrame, *, buckets: int = BUCKETS) -> LogisticModel:
    """A model from a bounded frame ``_id, y, text``: vectors are made on the executors, updates run on the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(2)):
                vecs = vectors(data, offsets, buckets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).cast(pa.string()), batch.column(1).slice(first, last - first), pa.array([v[0].astype(np.int32) for v in vecs], pa.list_(pa.int32())), pa.array([v[1].astype(np.float32) for v in vecs], pa.list_(pa.float32()))],
                    names=["id", "y", "idx", "val"],
                )

    ship_package(train.sparkSession)
    got = train.mapInArrow(run, "id string, y int, idx array<int>, val array<float>").toArrow().sort_by("id")
    # views of what was collected, widened one example at a time; given back to the system when fitted
    rows = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(got["idx"], got["val"], strict=True)]
    model = ftrl(rows, got["y"].to_numpy().astype(float), buckets=buckets)
    del rows, got
    pa.default_memory_pool().release_unused()
    return model


def score_quality(docs: DataFrame, model: LogisticModel, threshold: float = 0.7, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; a null or empty text scores the bias. No shuffle."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                s = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_quality(docs: DataFrame, model: LogisticModel, threshold: float, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores ``threshold`` or more. No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            keep = np.concatenate([model.score(data, offsets) >= threshold for _, _, data, offsets in chunks(column)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, *, modulus: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labels outside the held-out fold, score every text: ``doc_id, held_out, score, predicted``.

    The model is fitted on at most ``sample_rows`` labelled texts (``SAMPLE_ROWS``
    by default), chosen by hash of the id; the texts scored are all. Without any
    usable label every score is 0.5. Null labels and ids teach nothing; a null
    id is scored and not held out; repeated rows are scored alike. Columns other
    than id and text never enter a score.
    """
    model = fit(training_rows(docs, labels, "quality", ~in_split(F.col("doc_id"), modulus, held_out), sample_rows))
    out = score_quality(docs, model, threshold)
    return out.select("doc_id", in_split(F.col("doc_id"), modulus, held_out).alias("held_out"), "score", "predicted")
