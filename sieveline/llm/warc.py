"""WARC archives: writing, and reading back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package

MAGIC = "WARC/1.1\r\n"
_MAGIC = MAGIC.encode()
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A header block longer than this belongs to no record.
MAX_HEADER = 1 << 16


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):  # five hex digits are four base32 digits
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_B32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def as_records(pages: DataFrame, min_bytes: int = 0, *, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``record``: each row's WARC record without the two line ends after it.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with
    the largest key is a response and the others are revisits of it; every row
    that ties for the largest key is a response. Digests are pre-aggregated per
    task, and only those that occur again are joined back.
    """
    src = pages.select(F.col(key).alias("_k"), F.col(url).alias("_u"), F.coalesce(F.col(html), F.lit("")).alias("_h"))
    src = src.withColumns({"_d": sha1_base32(F.encode("_h", "UTF-8")), "_n": F.octet_length("_h").cast("long")})
    again = src.where(F.col("_n") >= min_bytes).groupBy("_d").agg(F.max("_k").alias("_keep"), F.count("*").alias("_c")).where("_c > 1 and _keep is not null")
    src = src.join(again.select("_d", "_keep"), "_d", "left")
    revisit = F.col("_keep").isNotNull() & (F.col("_n") >= min_bytes) & ~F.col("_k").eqNullSafe(F.col("_keep"))
    uri = F.regexp_replace(F.regexp_replace(F.col("_u"), r"[\x00-\x20\x7F]", "%20"), r"[<>]", "%3C")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("_h"))
    head = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("_k").cast("string"), F.lit("")), F.lit(">\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("_d"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("_keep").cast("string"), F.lit(">\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return src.select(F.concat(head, http, body).alias("record"))


def write_archives(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write gzip-compressed archives with Spark's text writer, to whatever store ``path`` names.

    The writer ends each record with the two line ends the format asks for. A
    lost task is written again by Spark's commit protocol.
    """
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Open:
    """A candidate record whose bytes are still arriving; keeps the header, and a digest in place of the payload.

    ``whole`` is false for one that no earlier candidate ends at: nothing can
    reach it, so only its successor is wanted and its payload is not read.
    """

    def __init__(self, offset: int, whole: bool = True):
        self.offset, self.whole, self.head, self.fields = offset, whole, b"", None
        self.left, self.http, self.sha, self.size, self.ended = 0, b"", None, 0, False

    def feed(self, data: bytes) -> bool:
        """Take the bytes that follow; true once the record needs no more."""
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return len(self.head) > MAX_HEADER
            data, self.head = self.head[at + 4 :], self.head[:at]
            try:
                pairs = [x.split(": ", 1) for x in self.head.decode().split("\r\n")]
                self.fields = {a.lower(): b for a, b in pairs}
                self.left = int(self.fields["content-length"])
            except (ValueError, KeyError):
                self.fields = None
                return True
            if self.left < 0:
                self.fields = None
                return True
            self.next = self.offset + len(_MAGIC) + at + 4 + self.left + 4
            if not self.whole:
                return True
        data = data[: self.left]
        self.left -= len(data)
        if self.sha is None:
            self.http += data
            at = self.http.find(b"\r\n\r\n")
            if at >= 0:
                self.sha = hashlib.sha1(self.http[at + 4 :])
                self.size = len(self.http) - at - 4
                self.http = self.http[:at]
        else:
            self.sha.update(data)
            self.size += len(data)
        self.ended = self.left == 0
        return self.ended

    def row(self) -> tuple | None:
        if self.fields is None:
            return None
        if not self.whole:
            return (self.offset, self.next, *[None] * 6, False)
        if not self.ended or self.sha is None:
            return None
        f = self.fields
        digest = base64.b32encode(self.sha.digest()).decode()
        said = f.get("warc-payload-digest", "").removeprefix("sha1:")
        urn = lambda s: s[len("<urn:page:") : -1] or None if s.startswith("<urn:page:") else None
        kind = f.get("warc-type", "")
        size = self.size
        if kind == "revisit":  # the payload is the response's; its HTTP head is kept
            sizes = [x.split(":", 1)[1] for x in self.http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
            size = int(sizes[0]) if sizes and sizes[0].strip().isdigit() else None
        return (self.offset, self.next, urn(f.get("warc-record-id", "")), size, said if kind == "revisit" else digest, kind, urn(f.get("warc-refers-to", "")), f.get("warc-target-uri"), kind == "revisit" or digest == said)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Pointer jumping from offset 0: which candidates the chain of record ends visits.

    ``offsets`` ascend. Each round doubles the length of every jump, so the
    rounds grow with the logarithm of the number of candidates. A candidate
    inside a payload is where no real record ends, and stays unreached.
    """
    n = len(offsets)
    seen = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        at = np.searchsorted(offsets, successors)
        jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n), n)
        seen[0] = True
        for _ in range(int(n).bit_length()):
            seen[jump[np.flatnonzero(seen)]] = True
            jump = jump[jump]
    return seen[:n]


FIELDS = "offset bigint, successor bigint, page_id {key}, payload_bytes bigint, payload_digest string, record_type string, refers_to {key}, url string, verified boolean"


def read_archives(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """The records of the gzip archives under ``path``.

    Spark's text reader cuts each archive at every occurrence of the magic
    line; gzip files are not split, so a task streams whole archives. It turns
    each occurrence into a candidate with the offset of its successor (where
    its declared length ends), and keeps what :func:`reachable` reaches from
    the start of the file. Memory: one segment, the headers of candidates, and
    a running digest for each record still open that a candidate before it ends
    at, so that magic lines in a payload cost their headers only. Occurrences without a sound
    header or cut short by the end of the file are no candidates; an empty
    archive has no records. ``verified`` says that a response's payload has the
    digest that its header names.
    """
    ship_package(spark)
    rows = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = FIELDS.format(key="string")
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def flush(found: list[tuple]) -> pa.RecordBatch:
        found.sort()
        seen = reachable(np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64))
        kept = [x for x, ok in zip(found, seen, strict=True) if ok]
        columns = list(zip(*kept, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, found, open_, ends = None, 0, [], [], {0}

        def feed(data: bytes) -> None:
            nonlocal open_
            left = []
            for c in open_:
                done = c.feed(data)
                if c.fields is not None:
                    ends.add(c.next)
                if not done:
                    left.append(c)
                elif (row := c.row()) is not None:
                    found.append(row)
            open_ = left

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = value.as_py()
                if name != file:
                    if found:
                        yield flush(found)
                    file, at, found, open_, ends = name, len(segment), [], [], {0}  # what stands before the first magic line
                    continue
                if open_:
                    feed(_MAGIC)
                open_.append(_Open(at, at in ends))
                at += len(_MAGIC) + len(segment)
                feed(segment)
        if found:
            yield flush(found)

    out = rows.mapInArrow(run, schema)
    return out.withColumns({"page_id": F.col("page_id").cast(key), "refers_to": F.col("refers_to").cast(key)})


def warc_round_trip(pages: DataFrame, path: str, min_bytes: int = 0, *, key: str = "page_id") -> DataFrame:
    """Write a record for every row under ``path``, then read the archives back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    verified``, a row for each row of ``pages``. A null html has an empty
    payload, a null url no target, a null page_id an empty record id that reads
    back as null (and is never what a revisit refers to). Other columns are not
    read.
    """
    spark = pages.sparkSession
    write_archives(as_records(pages, min_bytes, key=key), path)
    out = read_archives(spark, path, pages.schema[key].dataType.simpleString())
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
e AS (SELECT page_id, n, array_to_string([substr('{_B32}', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)
                                          for i in range(32)], '') AS b,
             max(page_id) OVER (PARTITION BY x) AS keep FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, b AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to, true AS verified
FROM e
"""
