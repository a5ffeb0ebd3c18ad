"""Answers of tool servers to search hits: JSON or event streams, lists or objects, or prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Names under which servers list results, and name a result's url, title and text.
LISTS = ("results", "items", "documents", "hits", "data")
URL, TITLE, TEXT = ("url", "link", "href"), ("title", "name", "headline"), ("snippet", "summary", "description", "content", "text")

_ENTRY = "map<string,string>"


def payload(body: Column) -> Column:
    """The JSON of a reply: the body, or the last ``data:`` line of a stream that is JSON; null without one."""
    plain = F.trim(F.coalesce(body, F.lit("")))
    lines = F.transform(F.filter(F.split(plain, "\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    sound = F.filter(lines, lambda x: F.try_parse_json(x).isNotNull())
    return F.when(plain.rlike(r"^[{\[]"), F.when(F.try_parse_json(plain).isNotNull(), plain)).otherwise(F.try_element_at(sound, F.lit(-1)))


def entries(text: Column) -> Column:
    """The results in a block's text as an array of maps; empty for prose."""
    t = F.trim(text)
    listed = F.from_json(t, ", ".join(f"{n} array<{_ENTRY}>" for n in LISTS))
    some = F.coalesce(*[listed[n] for n in LISTS])
    one = F.from_json(t, _ENTRY)
    single = F.when(F.coalesce(one["url"], one["title"], one["link"]).isNotNull(), F.array(one))
    parsed = F.when(t.startswith("["), F.from_json(t, f"array<{_ENTRY}>")).when(t.startswith("{"), F.coalesce(some, single))
    return F.coalesce(F.when(F.try_parse_json(t).isNotNull(), F.filter(parsed, lambda e: e.isNotNull())), F.array().cast(f"array<{_ENTRY}>"))


def _first(entry: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(entry[n], F.lit("")) for n in names])


def hits(replies: DataFrame, key: str = "query_id") -> DataFrame:
    """``key, position, url, title, snippet, external_id, unstructured`` from ``key, query, body``.

    Every text block of a reply gives its results; a block of prose is kept as
    one hit under the query's words, since dropping it would lose the answer.
    Results with neither url, title nor text are left out.
    """
    blocks = F.from_json(payload(F.col("body")), "result struct<content array<struct<type string, text string>>>")["result"]["content"]
    block = replies.select(key, "query", F.posexplode(blocks).alias("i", "block")).where("block.type = 'text' and block.text <> ''")
    found = block.select(key, "query", "i", F.col("block.text").alias("text"), entries(F.col("block.text")).alias("entries"))
    listed = found.select(key, "i", F.posexplode("entries").alias("j", "e"))
    listed = listed.select(
        key, "i", "j", _first(F.col("e"), URL).alias("url"), F.substring(tx.normalize_whitespace(_first(F.col("e"), TITLE)), 1, 300).alias("title"),
        F.substring(tx.clean_text(_first(F.col("e"), TEXT)), 1, 2000).alias("snippet"), F.nullif(F.col("e")["id"], F.lit("")).alias("external_id"), F.lit(False).alias("unstructured"),
    ).where("url is not null or title <> '' or snippet <> ''")
    null = F.lit(None).cast("string")
    prose = found.where(F.size("entries") == 0).select(key, "i", F.lit(0).alias("j"), null.alias("url"), F.substring("query", 1, 200).alias("title"), F.substring(tx.clean_text(F.col("text")), 1, 2000).alias("snippet"), null.alias("external_id"), F.lit(True).alias("unstructured"))
    both = listed.unionByName(prose)
    return both.select(key, (F.col("i") * 1000 + F.col("j")).alias("position"), "url", F.nullif("title", F.lit("")).alias("title"), F.nullif("snippet", F.lit("")).alias("snippet"), "external_id", "unstructured")
