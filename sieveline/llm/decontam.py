"""Benchmark decontamination by template windows (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Template tokens in a window; a shorter item is one window of its own size.
WINDOW = 8
#: A window with fewer ordinary words than this (or than a quarter of it less than all) says too little.
LITERALS = 4
#: Windows in line that make a document contaminated, or all of an item's.
HITS = 6
#: Rows (benchmark windows, or ids of texts that were hit) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000

#: Unit words, which count as units right after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "ton", "tons", "tonnes",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "degree", "degrees", "celsius", "fahrenheit", "kelvin",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "gbp",
    "mph", "kmh", "w", "kw", "kwh", "v", "a", "hz", "khz", "mhz", "ghz", "j", "kj", "n", "pa", "kb", "mb", "gb", "tb",
)

_TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[.!?\n]"
NUM, UNIT, NAME = "0", "1", "2"


def tokens(text: Column) -> Column:
    """Numbers, words, and the marks that end sentences."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _digit(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def _mark(x: Column) -> Column:
    return (x < "0") | (x == "?")


def templates(toks: Column) -> Column:
    """Each token's template: a placeholder, or the word in lower case; null for marks.

    Numbers are ``0``, units right after a number ``1``, names ``2``: words of
    an upper-case letter and lower-case ones that do not begin a sentence.
    """

    def one(x: Column, i: Column) -> Column:
        before = F.get(toks, i - 1)
        low = F.lower(x)
        name = (low != x) & (i > 0) & ~_mark(before) & (F.length(x) > 1) & (F.substring(x, 2, 1 << 30) == F.substring(low, 2, 1 << 30))
        return F.when(_mark(x), None).when(_digit(x), NUM).when(_digit(before) & low.isin(*UNITS), UNIT).when(name, NAME).otherwise(low)

    return F.transform(toks, one)


def _words(toks: Column) -> Column:
    """Each token in lower case; null for marks."""
    return F.transform(toks, lambda x: F.when(~_mark(x), F.lower(x)))


#: How a text is read: as templates, or word by word. The place in this tuple is a window's ``kind``.
READINGS: tuple[Callable[[Column], Column], ...] = (templates, _words)


def _read(src: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """``keys, _w``: tokens and templates. Each step is a column of its own, so that none is worked out again for every token."""
    toks = src.select(*keys, tokens(F.col("text")).alias("_k"))
    both = toks.select(*keys, F.arrays_zip(F.col("_k").alias("v"), READINGS[kind](F.col("_k")).alias("t")).alias("_z"))
    return both.select(*keys, F.filter("_z", lambda x: x["t"].isNotNull()).alias("_w"))


def _each(size: Column, width: int, of: Callable[[Column], Column]) -> Column:
    """``of`` every window's first place, counted from 1; null where there is none."""
    return F.when(size >= width, F.transform(F.sequence(F.lit(1), size - (width - 1)), of))


def _hash(t: Column) -> Column:
    return F.xxhash64(F.transform(t, lambda x: F.xxhash64(x)))


def _probes(src: DataFrame, kind: int, widths: list[int]) -> DataFrame:
    """``rid, kind, width, h``: the hash of every window of every width, in one pass over the texts."""
    words = _read(src, ["rid"], kind).select("rid", F.transform("_w", lambda x: F.xxhash64(x["t"])).alias("_w"))

    def one(w: int) -> Column:
        return F.coalesce(_each(F.size("_w"), w, lambda i: F.xxhash64(F.slice("_w", i, w))), F.array().cast("array<bigint>"))

    def tagged(w: int) -> Column:
        return F.transform(one(w), lambda h: F.struct(F.lit(w).alias("width"), h.alias("h")))

    if len(widths) == 1:
        return words.select("rid", F.lit(kind).alias("kind"), F.lit(widths[0]).alias("width"), F.explode(one(widths[0])).alias("h"))
    return words.select("rid", F.explode(F.concat(*map(tagged, widths))).alias("_x")).select("rid", F.lit(kind).alias("kind"), "_x.width", "_x.h")


def _windows(src: DataFrame, keys: list[str], kind: int, widths: list[int]) -> DataFrame:
    """``keys, kind, width, at, t, v``: templates and raw values of every window, from frames ``keys, text``."""
    both = _read(src, keys, kind)
    # (transform, not a field of the array: that would be extracted again for every window)
    both = both.select(*keys, F.transform("_w", lambda x: x["t"]).alias("_t"), F.transform("_w", lambda x: x["v"]).alias("_v"))

    def every(w: int) -> Column:
        return _each(F.size("_t"), w, lambda i: F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("width"), i.alias("at"), F.slice("_t", i, w).alias("t"), F.slice("_v", i, w).alias("v")))

    some = F.flatten(F.filter(F.array(*map(every, widths)), lambda x: x.isNotNull()))
    return both.select(*keys, F.explode(some).alias("_x")).select(*keys, "_x.kind", "_x.width", "_x.at", "_x.t", "_x.v")


def _telling(t: Column, width: Column) -> Column:
    return F.size(F.filter(t, lambda x: ~x.isin(NUM, UNIT, NAME))) >= F.greatest(F.lit(1), F.least(F.lit(LITERALS), width - F.floor(width / 4)))


def _forms(windows: DataFrame, hits: int) -> DataFrame:
    """``f`` added: the window's templates, also with an item's first word as a name or a unit, which it may be inside a document.

    Only for items all of whose windows have to match: of others, enough match without the first.
    """
    few = windows.groupBy("item_id", "text").agg((F.countDistinct("at") <= hits).alias("_few"))
    windows = windows.join(few, ["item_id", "text"])
    x, t, rest = F.get("v", F.lit(0)), F.get("t", F.lit(0)), F.slice("t", 2, 1 << 30)
    low = F.lower(x)
    first = F.col("_few") & (F.col("at") == 1) & ~t.isin(NUM, UNIT, NAME)
    name = first & (low != x) & (F.length(x) > 1) & (F.substring(x, 2, 1 << 30) == F.substring(low, 2, 1 << 30))
    forms = F.array(F.col("t"), F.when(name, F.concat(F.array(F.lit(NAME)), rest)), F.when(first & low.isin(*UNITS), F.concat(F.array(F.lit(UNIT)), rest)))
    return windows.withColumn("f", F.explode(F.filter(forms, lambda y: y.isNotNull())))


def _index(benchmark: DataFrame, item: str, item_text: str, width: int, hits: int) -> DataFrame:
    """``item_id, kind, width, at, t, v, f, h``: the benchmark's windows, written to the shared folder.

    An item's windows are ``width`` long, or as long as the item. Items whose
    windows say too little as templates have theirs word by word.
    """
    items = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct()
    keys = ["item_id", "text"]
    size = _read(items, keys, 0).select(*keys, F.least(F.size("_w"), F.lit(width)).alias("_n")).where("_n > 0")
    widths = sorted(r[0] for r in size.select("_n").distinct().collect())  # at most ``width`` numbers
    if not widths:
        widths = [width]
    mine = lambda kind: _windows(items, keys, kind, widths).join(size, keys).where("width = _n").drop("_n")
    told = mine(0).where(_telling(F.col("t"), F.col("width")))
    plain = mine(1).join(told.select(*keys).distinct(), keys, "left_anti")
    named = _forms(told, hits).unionByName(plain.withColumn("f", F.col("t")), allowMissingColumns=True)
    return cut(named.select("item_id", "kind", "width", "at", "t", "v", "f", _hash(F.col("f")).alias("h")), "benchmark-windows")


def _held(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, width: int, hits: int) -> DataFrame:
    """``rid, doc_id, item_id, n, n_windows``: the texts that hold items; ``rid`` is the hash of id and text."""
    src = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    src = src.withColumn("rid", F.xxhash64("doc_id", "text"))
    index = _index(benchmark, item, item_text, width, hits)
    sorts: dict[int, list[int]] = {}
    rows = 0
    for kind, w, n in sorted(index.groupBy("kind", "width").count().collect()):  # at most 2 * ``width`` rows
        sorts.setdefault(kind, []).append(w)
        rows += n
    if not rows:
        kinds = f"rid bigint, doc_id {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema[item].dataType.simpleString()}, n bigint, n_windows bigint"
        return docs.sparkSession.createDataFrame([], kinds)
    hint = F.broadcast if rows <= BROADCAST_ROWS else (lambda x: x)
    join = ["kind", "width", "h"]
    # first pass: hashes only
    known = hint(index.select(*join).distinct())
    found = reduce(DataFrame.union, [_probes(src, kind, widths).join(known, join).select("rid") for kind, widths in sorts.items()])
    found = cut(found.distinct(), "decontam-hits")
    # second pass: windows with their values, of the texts that were hit; no text is
    # shuffled while the hits' ids are few enough to be broadcast
    few = found.count() <= BROADCAST_ROWS
    texts = src.join(F.broadcast(found) if few else found.hint("merge"), "rid", "left_semi").dropDuplicates(["rid"])
    mine = reduce(DataFrame.union, [_windows(texts, ["rid", "doc_id"], kind, widths) for kind, widths in sorts.items()]).withColumn("h", _hash(F.col("t")))
    pairs = mine.join(hint(index.select("item_id", *join, F.col("at").alias("item_at"), "f", F.col("t").alias("item_t"), F.col("v").alias("item_v"))), join).where("t = f")
    # an item's first word stays that word where the document takes it for a name or a unit
    pairs = pairs.where((F.get("t", F.lit(0)) == F.get("item_t", F.lit(0))) | (F.lower(F.get("v", F.lit(0))) == F.get("item_t", F.lit(0))))
    line = ["rid", "item_id", "kind", "width", "line"]
    pairs = cut(pairs.select("rid", "doc_id", "item_id", "kind", "width", (F.col("at") - F.col("item_at")).alias("line"), "item_at", F.col("item_t").alias("t"), "v", "item_v"), "decontam-pairs")
    slots = pairs.select(*line, F.explode(F.arrays_zip("t", "v", "item_v")).alias("s")).where(F.col("s.t").isin(NUM, UNIT, NAME))
    odd = slots.groupBy(*line, "s.t", "s.item_v").agg(F.min("s.v").alias("a"), F.max("s.v").alias("b")).where("a <> b").select(*line).distinct()
    total = index.groupBy("item_id", "kind", "width").agg(F.countDistinct("at").alias("n_windows"))
    lines = pairs.join(odd, line, "left_anti").groupBy("doc_id", *line).agg(F.countDistinct("item_at").alias("n"))
    good = lines.join(hint(total), ["item_id", "kind", "width"]).where(F.col("n") >= F.least(F.col("n_windows"), F.lit(hits)))
    return good.select("rid", "doc_id", "item_id", "n", "n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, hits: int = HITS) -> DataFrame:
    """Documents that hold benchmark items: ``doc_id, item_id, n_matched, n_windows``.

    Texts become template tokens (numbers, units and names replaced by typed
    placeholders) and windows of ``width`` of them. A document holds an item
    when, in line with each other, at least ``hits`` of the item's windows (all,
    if it has fewer) match, and the slots agree: wherever the item repeats a
    number, unit or name, the document repeats whatever stands for it. So a
    question with other numbers is caught, and a chance likeness of
    placeholders is not. Windows with fewer than ``LITERALS`` ordinary words do
    not count; an item that has no others is sought word by word. Where all of
    an item's windows have to match, its first word also counts where its place
    in the document makes it a name or a unit. ``n_matched`` is the largest
    number of windows in line.

    Every window of every document is probed, in one pass for each reading that
    the benchmark needs, without a shuffle while its windows are at most
    ``BROADCAST_ROWS``. The table is then read again for the texts that were
    hit, filtered by their ids: broadcast while they are at most
    ``BROADCAST_ROWS``, joined by a shuffle beyond. Null texts and items match nothing, an
    empty table gives an empty result, repeated rows count once, other columns
    are not read.
    """
    held = _held(docs, benchmark, key, text, item, item_text, width, hits)
    return held.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_matched"), F.max("n_windows").alias("n_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; each row is judged by its own text, whatever its id."""
    bad = _held(docs, benchmark, key, text, "item_id", "text", WINDOW, HITS).select(F.col("rid").alias("_bad")).distinct()
    rid = F.when(F.col(text).isNotNull(), F.xxhash64(key, text))
    return docs.join(bad.hint("merge"), rid == F.col("_bad"), "left_anti")


SQL = r"""
WITH src AS (SELECT 0 AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
             UNION SELECT 1, item_id, text FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT side, id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+|[.!?\n]') AS k FROM src),
c AS (SELECT side, id, list_filter([{'v': x, 't': CASE
        WHEN x IN ('.', '!', '?', chr(10)) THEN NULL
        WHEN regexp_matches(x, '^[0-9]') THEN '0'
        WHEN i > 1 AND regexp_matches(k[i - 1], '^[0-9]') AND lower(x) IN (UNITS) THEN '1'
        WHEN i > 1 AND k[i - 1] NOT IN ('.', '!', '?', chr(10)) AND lower(x) <> x AND length(x) > 1 AND substr(x, 2) = lower(substr(x, 2)) THEN '2'
        ELSE lower(x) END} for x, i in k], lambda s: s.t IS NOT NULL) AS w FROM k),
z AS (SELECT id, least(len(w), 8) AS n FROM c WHERE side = 1 AND len(w) > 0),
p AS (SELECT c.side, c.id, s.n, unnest(range(1, len(w) - s.n + 2)) AS pos, w
      FROM c JOIN (SELECT DISTINCT n FROM z) s ON len(w) >= s.n AND (c.side = 0 OR s.n = least(len(w), 8))),
g AS (SELECT side, id, n, pos, list_transform(w[pos : pos + n - 1], lambda s: s.t) AS t, list_transform(w[pos : pos + n - 1], lambda s: s.v) AS v FROM p),
b AS (SELECT * FROM g WHERE side = 1 AND len(list_filter(t, lambda x: x NOT IN ('0', '1', '2'))) >= greatest(1, least(4, n - n // 4))),
m AS (SELECT g.id AS doc_id, b.id AS item_id, g.pos - b.pos AS line, b.pos AS item_at, g.t, g.v, b.v AS item_v
      FROM g JOIN b ON g.side = 0 AND g.t = b.t AND g.n = b.n),
o AS (SELECT DISTINCT doc_id, item_id, line FROM (
        SELECT doc_id, item_id, line, s.t AS st, s.i AS si, count(DISTINCT s.v) AS c
        FROM (SELECT doc_id, item_id, line, unnest([{'t': t[j], 'v': v[j], 'i': item_v[j]} for j in range(1, len(t) + 1)]) AS s FROM m)
        WHERE s.t IN ('0', '1', '2') GROUP BY ALL HAVING c > 1)),
l AS (SELECT doc_id, item_id, line, count(DISTINCT item_at) AS n FROM m ANTI JOIN o USING (doc_id, item_id, line) GROUP BY ALL),
t AS (SELECT id AS item_id, count(DISTINCT pos) AS n_windows FROM b GROUP BY 1)
SELECT doc_id, item_id, max(n) AS n_matched, max(n_windows) AS n_windows FROM l JOIN t USING (item_id) WHERE n >= least(n_windows, 6) GROUP BY 1, 2
""".replace("UNITS", ", ".join(f"'{u}'" for u in UNITS))
