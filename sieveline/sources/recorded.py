"""Recorded provider responses as a table: a Python data source that takes filters where a provider's request would."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

from ..session import ship_package

SCHEMA = "provider string, year int, external_id string, title string, published string, lang string, url string, text string"
_ARROW = pa.schema([("provider", pa.string()), ("year", pa.int32()), *((c, pa.string()) for c in ("external_id", "title", "published", "lang", "url", "text"))])
BATCH = 1024


class Shape(NamedTuple):
    """Where a provider's responses hold records, and what a record says under our names."""

    records: tuple[str, ...]
    fields: dict[str, Callable[[dict], Any]]


def _crossref_day(r: dict) -> str | None:
    parts = ((r.get("issued") or {}).get("date-parts") or [[]])[0]
    return "-".join(f"{p:0{4 if not i else 2}d}" for i, p in enumerate((*parts, 1, 1)[:3])) if parts else None


SHAPES = {
    "openalex": Shape(("results",), {"external_id": lambda r: (r.get("id") or "").rsplit("/", 1)[-1], "title": lambda r: r.get("display_name"), "published": lambda r: r.get("publication_date"), "lang": lambda r: r.get("language"), "url": lambda r: r.get("id"), "text": lambda r: r.get("abstract")}),
    "crossref": Shape(("message", "items"), {"external_id": lambda r: r.get("DOI"), "title": lambda r: next(iter(r.get("title") or []), None), "published": _crossref_day, "lang": lambda r: r.get("language"), "url": lambda r: r.get("URL"), "text": lambda r: r.get("abstract")}),
    "gdelt": Shape(("articles",), {"external_id": lambda r: r.get("url"), "title": lambda r: r.get("title"), "published": lambda r: re.sub(r"^(\d{4})(\d\d)(\d\d).*", r"\1-\2-\3", r.get("seendate") or "") or None, "lang": lambda r: r.get("language"), "url": lambda r: r.get("url"), "text": lambda r: r.get("body")}),
}

_TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringContains: lambda x, v: v in x,
}


class _File(InputPartition):
    def __init__(self, path: str, provider: str, year: int):
        super().__init__((path, provider, year))


class RecordedReader(DataSourceReader):
    """Files of one provider and year each; a filter on either, or on the day, leaves files unread, the others leave records."""

    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"], int(options.get("limit", 0))
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) is IsNotNull and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], IsNotNull, None))
            elif type(f) in _TESTS and len(f.attribute) == 1:
                value = f.value.isoformat() if isinstance(f.value, date) else f.value
                self.tests.append((f.attribute[0], type(f), value))
            else:
                yield f

    def _passes(self, row: dict[str, Any], columns: Iterable[str]) -> bool:
        for column, kind, value in self.tests:
            if column in columns:
                x = row[column]
                # as in SQL, a comparison with null holds for nothing
                if x is None or value is None and kind is not IsNotNull or (kind is not IsNotNull and not _TESTS[kind](x, value)):
                    return False
        return True

    def _year_may_pass(self, year: int) -> bool:
        """Whether some day of a year passes the tests on days."""
        first, last = f"{year:04d}-01-01", f"{year:04d}-~"  # whatever stands behind the year
        for column, kind, value in self.tests:
            if column == "published" and isinstance(value, str):
                if kind in (GreaterThan, GreaterThanOrEqual) and last < value or kind is LessThanOrEqual and first > value or kind is LessThan and first >= value or kind is EqualTo and not first <= value <= last:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            m = re.search(r"/provider=([^/]+)/year=(\d+)/([^/]+)$", info.path)
            if info.type == fs.FileType.File and m and not m.group(3).startswith(("_", ".")) and m.group(1) in SHAPES:
                row = {"provider": m.group(1), "year": int(m.group(2))}
                if self._passes(row, ("provider", "year")) and self._year_may_pass(row["year"]):
                    out.append(_File(info.path, row["provider"], row["year"]))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there is no file
            return
        path, provider, year = partition.value
        store, _ = fs.FileSystem.from_uri(self.path)
        shape, held, n = SHAPES[provider], [], 0
        with store.open_input_stream(path) as lines:
            for record in _records(lines, shape.records):
                row = {"provider": provider, "year": year} | {k: get(record) for k, get in shape.fields.items()}
                if self._passes(row, _ARROW.names):
                    held.append(row)
                    n += 1
                if len(held) == BATCH or self.limit and n >= self.limit:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held = []
                if self.limit and n >= self.limit:
                    return
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _records(stream: Any, at: tuple[str, ...]) -> Iterator[dict]:
    """Records of the responses, one a line; lines that are no such response are passed over."""
    rest = b""
    while True:
        block = stream.read(1 << 20)
        *lines, rest = (rest + block).split(b"\n") if block else [rest, b""]
        for line in lines:
            try:
                x: Any = json.loads(line) if line.strip() else None
            except ValueError:
                continue
            for key in at:
                x = x.get(key) if isinstance(x, dict) else None
            yield from (r for r in x or [] if isinstance(r, dict))
        if not block:
            return


class RecordedSource(DataSource):
    """``spark.read.format("recorded").option("path", folder)``: see :func:`recorded`."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return RecordedReader({k.lower(): v for k, v in self.options.items()})


def recorded(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Records of recorded responses under ``path`` (``provider=<name>/year=<year>/``, a response a line): ``SCHEMA``.

    Comparisons with constants, ``isin`` and ``contains`` go down to the
    reader, which chooses files by provider, year and day and records by the
    rest; Spark applies what is left. ``limit`` is what a request for one file
    returns at most (0: all). Providers that are not in ``SHAPES``, hidden files
    and broken lines are passed over; no folder gives no rows.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSource)
    reader = spark.read.format("recorded").option("path", path if "://" in path or path.startswith("file:") else posixpath.abspath(path))
    return reader.option("limit", limit).load()
