"""What becomes of search hits: inline records, fetches within an allowance, documents with their origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import urls as ur


def acquire(hits: DataFrame, max_fetches: int | None = None, fetch_bodies: bool | None = None) -> DataFrame:
    """Adds ``outcome`` to ``query_id, position, url, inline, refused``: inline, fetched, unretrieved or not_tried.

    In order of position: a provider that answers with whole records is taken
    at its word unless bodies are wanted; other hits with a url are fetched
    while the query's allowance lasts, beyond it records come inline where they
    can. After the first hit that was refused when it was stored, none is tried.
    A query's hits are what one search returned, so a window holds few rows.
    """
    w = Window.partitionBy("query_id").orderBy("position")
    wants = F.lit(fetch_bodies) if fetch_bodies is not None else ~F.col("inline")
    direct = F.col("inline") & ~wants
    asks = ~direct & F.col("url").isNotNull()
    used = F.sum(asks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.lit(True) if max_fetches is None else used <= max_fetches
    outcome = F.when(direct, "inline").when(asks & fits, "fetched").when(F.col("inline"), "inline").otherwise("unretrieved")
    stored = outcome != "unretrieved"
    before = F.max((F.col("refused") & F.col("_stored")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = hits.withColumn("_outcome", outcome).withColumn("_stored", stored)
    return out.withColumn("outcome", F.when(F.coalesce(before, F.lit(0)) == 1, "not_tried").otherwise(F.col("_outcome"))).drop("_outcome", "_stored")


def identifiers_of(raw: Column) -> Column:
    """The authoritative identifiers of a raw record (``map<string,string>``), each in its normal form."""
    pairs = {"doi": ids.normalize_doi(raw["doi"]), "arxiv_id": ids.normalize_arxiv_id(F.coalesce(raw["arxiv_id"], raw["arxiv"]))}
    pairs |= {k: F.nullif(raw[k], F.lit("")) for k in ("pmid", "pmcid", "openalex_id", "semantic_scholar_id")}
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def public_keys(raw: Column) -> Column:
    """A raw record without the keys that are for internal use."""
    return F.map_filter(raw, lambda k, v: ~k.startswith("_"))


def from_page(pages: DataFrame) -> DataFrame:
    """Documents of fetched pages: ``url, canonical, site_name`` to ``canonical_url, publisher, republished_by, differs``.

    A declared canonical url stands for the page. If it names another host, the
    page republishes someone else's article, and its site is not the publisher.
    """
    own, declared = ur.canonicalize(F.col("url")), ur.canonicalize(F.col("canonical"))
    out = pages.withColumns({"_own": own, "_declared": declared}).withColumn("canonical_url", F.coalesce("_declared", "_own"))
    other = F.col("canonical_url").isNotNull() & ~ur.host_of(F.col("canonical_url")).eqNullSafe(ur.host_of(F.col("url")))
    out = out.withColumn("_other", other)
    return out.withColumns({
        "publisher": F.when(~F.col("_other"), F.col("site_name")), "republished_by": F.when(F.col("_other"), F.col("site_name")),
        "differs": F.col("_declared").isNotNull() & ~F.col("_declared").eqNullSafe(F.col("_own")),
    }).drop("_own", "_declared", "_other")


def as_hits(docs: DataFrame) -> DataFrame:
    """Documents back to the pointers by which providers know them: ``raw`` gets the provider's own id where it has one."""
    own = F.when(F.col("external_id").isNotNull() & F.col("provider").isin("openalex", "semantic_scholar"), F.create_map(F.concat("provider", F.lit("_id")), "external_id"))
    given = F.map_concat(F.create_map(F.lit("_endpoint"), F.lit("")), F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    raw = F.map_concat(F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(given, k)), given)
    return docs.withColumn("raw", raw).drop("metadata")


def citation_edges(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``citing, cited`` of records that list the works they refer to; citing works are the same edges read backwards."""
    r = payloads.select(F.from_json(column, "id string, referenced_works array<string>").alias("r"))
    last = lambda c: F.substring_index(c, "/", -1)
    return r.select(last(F.col("r.id")).alias("citing"), F.explode("r.referenced_works").alias("w")).select("citing", last(F.col("w")).alias("cited")).where("cited <> ''").distinct()


def by_doi(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Held records of DOIs in any spelling: an equi-join on the normal form, of both sides."""
    return wanted.withColumn("_doi", ids.normalize_doi(F.col("doi"))).join(held.withColumn("_doi", ids.normalize_doi(F.col("doi"))).drop("doi"), "_doi").drop("_doi")


def merged_sources(records: DataFrame, by: str, order: str, provider: str, address: str) -> DataFrame:
    """``by, provider, address, also_provided_by, also_retrieved_from``: the first record's origin, and in which others it was seen."""
    first = F.min_by(F.struct(provider, address), order)
    g = records.groupBy(by).agg(first.alias("f"), F.collect_set(provider).alias("p"), F.collect_set(address).alias("a"))
    rest = lambda c, x: F.array_sort(F.array_except(c, F.array(x)))
    return g.select(by, F.col("f")[provider].alias(provider), F.col("f")[address].alias(address), rest("p", F.col("f")[provider]).alias("also_provided_by"), rest("a", F.col("f")[address]).alias("also_retrieved_from"))
