"""Dates of uncertain form and precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms besides ISO; anything else is null, not a guess.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd", "yyyy-MM", "yyyy")


def parse_date(raw: Column) -> Column:
    """First form that fits, as a timestamp without zone (UTC)."""
    iso = F.try_to_timestamp(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), F.replace(raw, F.lit("T"), F.lit(" "))))
    tries = [F.try_to_timestamp(raw, F.lit(f)) for f in FORMATS]
    return F.coalesce(iso, *tries).cast("timestamp_ntz")


def truncate_to(at: Column, precision: Column) -> Column:
    """A date cut to its precision: exact, day, month, quarter or year."""
    out = at
    for p in ("day", "month", "quarter", "year"):
        out = F.when(precision == p, F.date_trunc(p, at).cast("timestamp_ntz")).otherwise(out)
    return out
