"""A search's limits compiled into each provider's parameters; the requests themselves are no part of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a provider returns at most.
MOST = {"openalex": 200, "crossref": 100, "arxiv": 100, "semantic_scholar": 100, "gdelt": 250}
#: Words of a query that arXiv's terms are joined of at most, and shortest such word.
ARXIV_TERMS, ARXIV_SHORTEST = 6, 3
#: Words that say what kind of talk is wanted, not about what.
FRAMING = (
    "about", "recent", "latest", "news", "debate", "discussion", "public",
    "statements", "policy", "analysis", "opinion", "what", "which", "their",
    "there", "these", "those", "with", "from", "into", "that", "this",
)


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(",", *parts), F.lit(""))


def arxiv_terms(text: Column) -> Column:
    """Words of three letters or more, joined by AND, six at most; the text itself without one."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda w: F.length(w) >= ARXIV_SHORTEST)
    terms = F.array_join(F.transform(F.slice(words, 1, ARXIV_TERMS), lambda w: F.concat(F.lit("all:"), w)), " AND ")
    return F.when(terms == "", F.concat(F.lit("all:"), text)).otherwise(terms)


def hashtag(text: Column) -> Column:
    """The first word that says what a query is about; all of it without one."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""))
    words = F.filter(F.transform(F.split(F.trim(text), r"\s+"), bare), lambda w: (F.length(w) > 3) & ~w.isin(*FRAMING))
    return F.coalesce(F.get(words, F.lit(0)), bare(text))


def compiled(queries: DataFrame) -> DataFrame:
    """``query_id, provider, params`` (a map) for each provider that takes such a query.

    ``queries``: ``query_id, text, after, before, language, domain, open_access,
    work_type, wanted``; of these all but the first two may be null.
    """
    q, none = F.col, F.lit(None).cast("string")
    rows = lambda provider: F.least(F.coalesce(q("wanted"), F.lit(20)), F.lit(MOST[provider])).cast("string")
    dated = q("after").isNotNull() | q("before").isNotNull()
    stamp = lambda c, other: F.coalesce(F.date_format(c, "yyyyMMddHHmm"), F.lit(other))
    open_ = F.coalesce(q("open_access"), F.lit(False))
    span = F.concat(F.coalesce(F.year("after").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.year("before").cast("string"), F.lit("")))
    filters = _joined(
        F.concat(F.lit("from_publication_date:"), _day(q("after"))), F.concat(F.lit("to_publication_date:"), _day(q("before"))),
        F.when(open_, "is_oa:true"), F.concat(F.lit("type:"), q("work_type")),
    )
    ranged = F.concat(F.lit("("), arxiv_terms(q("text")), F.lit(") AND submittedDate:["), stamp("after", "190001010000"), F.lit(" TO "), stamp("before", "299901010000"), F.lit("]"))
    params = {
        "openalex": {"search": q("text"), "per-page": rows("openalex"), "filter": filters},
        "crossref": {"query.bibliographic": q("text"), "rows": rows("crossref"), "filter": _joined(F.concat(F.lit("from-pub-date:"), _day(q("after"))), F.concat(F.lit("until-pub-date:"), _day(q("before"))))},
        "arxiv": {"search_query": F.when(dated, ranged).otherwise(arxiv_terms(q("text"))), "max_results": rows("arxiv"), "sortBy": F.lit("relevance")},
        "semantic_scholar": {"query": q("text"), "limit": rows("semantic_scholar"), "year": F.when(dated, span), "openAccessPdf": F.when(open_, "")},
        "gdelt": {"query": F.concat_ws(" ", q("text"), F.concat(F.lit("sourcelang:"), q("language")), F.concat(F.lit("domain:"), q("domain"))), "maxrecords": rows("gdelt")},
    }
    maps = [F.struct(F.lit(p).alias("provider"), F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.coalesce(v, none))]), lambda k, v: v.isNotNull()).alias("params")) for p, kv in params.items()]
    return queries.select("query_id", F.explode(F.array(*maps)).alias("x")).select("query_id", "x.provider", "x.params")
