"""Corpora in JSON: academic records and web pages with their labels, as one table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.ids import normalize_doi
from . import files

_ACADEMIC = "array<struct<id string, doi string, title string, authors array<string>, published_at string, venue string, abstract string, references array<string>, url string>>"
_WEB = "array<struct<id string, url string, title string, publisher string, published_at string, family string, source_type string, snippet string, html string>>"
SCHEMA = f"name string, question string, academic {_ACADEMIC}, web {_WEB}"


def load_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of the corpora under ``path``: one JSON object a file, or one a line.

    ``label, family, source_type, title, abstract, text, url, doi, publisher,
    published, references``. A page's text is extracted from its HTML, its
    snippet stands in where there is none; a record's text is its abstract.
    Missing parts are empty; a file that is no JSON object gives no rows.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    a = raw.select(F.explode("academic").alias("e"))
    none = F.lit(None).cast("string")
    academic = a.select(
        F.col("e.id").alias("label"), F.lit("academic").alias("family"), F.lit("academic_peer_reviewed").alias("source_type"), F.col("e.title").alias("title"), F.col("e.abstract").alias("abstract"), F.col("e.abstract").alias("text"),
        F.when(F.col("e.doi") != "", F.concat(F.lit("https://doi.org/"), F.col("e.doi"))).alias("url"), normalize_doi(F.col("e.doi")).alias("doi"), F.col("e.venue").alias("publisher"), parse_date(F.col("e.published_at")).alias("published"), F.col("e.references").alias("references"),
    )
    w = raw.select(F.explode("web").alias("e")).select("e.*")
    pages = files.extract_pages(w.select(F.struct(*w.columns).alias("key"), "html"), key="key", html="html")
    kept = F.col("page_id")
    web = pages.select(
        kept["id"].alias("label"), F.coalesce(F.nullif(kept["family"], F.lit("")), F.lit("web")).alias("family"), F.coalesce(F.nullif(kept["source_type"], F.lit("")), F.lit("web_page")).alias("source_type"),
        F.coalesce(F.nullif(kept["title"], F.lit("")), F.col("title")).alias("title"), kept["snippet"].alias("abstract"), F.coalesce(F.nullif(F.col("text"), F.lit("")), kept["snippet"]).alias("text"),
        kept["url"].alias("url"), none.alias("doi"), kept["publisher"].alias("publisher"), parse_date(kept["published_at"]).alias("published"), F.array().cast("array<string>").alias("references"),
    )
    return academic.unionByName(web)
