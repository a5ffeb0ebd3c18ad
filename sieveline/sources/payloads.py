"""Provider payloads to search hits: each provider's nested JSON becomes the same flat row.

Every function takes a frame with a JSON string column and returns
``provider, external_id, title, url, published, doi, authors, text``. Requests
over a network are no part of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.ids import normalize_doi
from ..functions.text import strip_tags

_TEXT = "string"


def _rows(df: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    parsed = df.select(F.from_json(column, schema).alias("p"))
    return parsed.select(F.explode(f"p.{path}" if path else "p").alias("r"))


def _hit(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    order = ("external_id", "title", "url", "published", "doi", "authors", "text")
    null = {"published": "timestamp_ntz", "authors": "array<string>"}
    return df.select(F.lit(provider).alias("provider"), *[columns.get(c, F.lit(None)).cast(null.get(c, _TEXT)).alias(c) for c in order])


def inverted_index_to_text(index: Column, limit: int = 4000) -> Column:
    """Text of a ``map<word, positions>``: words by position, under ``limit`` of them."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, limit), lambda x: x["w"]), " ")


def openalex(df: DataFrame, column: str = "payload") -> DataFrame:
    s = "results array<struct<id string, doi string, display_name string, publication_date string, authorships array<struct<author struct<display_name string>>>, primary_location struct<landing_page_url string>, abstract_inverted_index map<string, array<int>>>>"
    r = _rows(df, column, s, "results")
    return _hit(r, "openalex", external_id=F.substring_index("r.id", "/", -1), title=F.col("r.display_name"), url=F.col("r.primary_location.landing_page_url"), published=parse_date(F.col("r.publication_date")), doi=normalize_doi(F.col("r.doi")), authors=F.col("r.authorships.author.display_name"), text=inverted_index_to_text(F.col("r.abstract_inverted_index")))


def crossref(df: DataFrame, column: str = "payload") -> DataFrame:
    s = "message struct<items array<struct<DOI string, title array<string>, URL string, abstract string, author array<struct<given string, family string>>, issued struct<`date-parts` array<array<int>>>>>>"
    r = _rows(df, column, s, "message.items")
    parts = F.get(F.col("r.issued.`date-parts`"), F.lit(0))
    day = F.make_date(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1)))
    return _hit(r, "crossref", external_id=F.lower("r.DOI"), title=F.get(F.col("r.title"), F.lit(0)), url=F.col("r.URL"), published=day.cast("timestamp_ntz"), doi=normalize_doi(F.col("r.DOI")), authors=F.transform("r.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), text=strip_tags(F.col("r.abstract")))


def semantic_scholar(df: DataFrame, column: str = "payload") -> DataFrame:
    s = "data array<struct<paperId string, title string, abstract string, url string, year int, publicationDate string, authors array<struct<name string>>, externalIds struct<DOI string>>>"
    r = _rows(df, column, s, "data")
    return _hit(r, "semantic_scholar", external_id=F.col("r.paperId"), title=F.col("r.title"), url=F.col("r.url"), published=parse_date(F.coalesce("r.publicationDate", F.col("r.year").cast("string"))), doi=normalize_doi(F.col("r.externalIds.DOI")), authors=F.col("r.authors.name"), text=F.col("r.abstract"))


def gdelt(df: DataFrame, column: str = "payload") -> DataFrame:
    r = _rows(df, column, "articles array<struct<url string, title string, seendate string, domain string>>", "articles")
    return _hit(r, "gdelt", external_id=F.col("r.url"), title=F.col("r.title"), url=F.col("r.url"), published=parse_date(F.col("r.seendate")))


def web_search(df: DataFrame, provider: str, column: str = "payload") -> DataFrame:
    """Brave (``web.results``, ``news.results``) and Tavily (``results``) alike."""
    item = "array<struct<url string, title string, description string, content string, page_age string, published_date string>>"
    p = df.select(F.from_json(column, f"results {item}, web struct<results {item}>, news struct<results {item}>").alias("p"))
    r = p.select(F.explode(F.coalesce("p.web.results", "p.news.results", "p.results")).alias("r"))
    return _hit(r, provider, external_id=F.col("r.url"), title=F.col("r.title"), url=F.col("r.url"), published=parse_date(F.substring(F.coalesce("r.page_age", "r.published_date"), 1, 10)), text=F.coalesce("r.description", "r.content"))


def bluesky(df: DataFrame, column: str = "payload") -> DataFrame:
    r = _rows(df, column, "posts array<struct<uri string, author struct<handle string, displayName string>, record struct<text string, createdAt string>>>", "posts")
    url = F.concat(F.lit("https://bsky.app/profile/"), F.col("r.author.handle"), F.lit("/post/"), F.substring_index("r.uri", "/", -1))
    return _hit(r, "bluesky", external_id=F.col("r.uri"), title=F.substring("r.record.text", 1, 80), url=url, published=parse_date(F.substring("r.record.createdAt", 1, 10)), authors=F.array("r.author.displayName"), text=F.col("r.record.text"))


def mastodon(df: DataFrame, column: str = "payload") -> DataFrame:
    r = _rows(df, column, "array<struct<id string, created_at string, url string, content string, account struct<display_name string>>>", "")
    return _hit(r, "mastodon", external_id=F.col("r.id"), title=F.substring(strip_tags(F.col("r.content")), 1, 80), url=F.col("r.url"), published=parse_date(F.substring("r.created_at", 1, 10)), authors=F.array("r.account.display_name"), text=strip_tags(F.col("r.content")))


def youtube(df: DataFrame, column: str = "payload") -> DataFrame:
    r = _rows(df, column, "items array<struct<id struct<videoId string>, snippet struct<title string, channelTitle string, publishedAt string, description string>>>", "items")
    return _hit(r, "youtube", external_id=F.col("r.id.videoId"), title=F.col("r.snippet.title"), url=F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("r.id.videoId")), published=parse_date(F.substring("r.snippet.publishedAt", 1, 10)), authors=F.array("r.snippet.channelTitle"), text=F.col("r.snippet.description"))


def arxiv(df: DataFrame, column: str = "payload") -> DataFrame:
    """Atom feeds: one entry a row, fields by XPath."""
    e = df.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("e"))
    x = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    names = F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1))
    return _hit(e, "arxiv", external_id=F.substring_index(x("id"), "/", -1), title=x("title"), url=x("id"), published=parse_date(F.substring(x("published"), 1, 10)), doi=normalize_doi(x("arxiv:doi")), authors=names, text=x("summary"))
