"""Text, url, identifier and fingerprint functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import fingerprint as fp
from ..functions import ids
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import retrieval as ret
from .registry import query

# (the tables hold no characters that normal form KC changes and C does not)
_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def ws_sql(column: str) -> str:
    return _WS.format(f"nfc_normalize({column})")


@query("normalize_whitespace", f"SELECT doc_id AS id, md5({ws_sql('text')}) AS h FROM documents")
def normalize_whitespace(spark, d):
    return b.documents(spark, d).select("id", F.md5(tx.normalize_whitespace(F.col("text"))).alias("h"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(" + ws_sql("text") + r", '(?im)^\s*(sign up|subscribe|share this|advertisement|read more)\b.*$', '', 'g'), '(?i)©\s*\d{4}[^\n]*', '', 'g'), '(?i)all rights reserved[^\n]*', '', 'g')"


@query("clean_text", f"SELECT doc_id AS id, length({ws_sql(_CLEAN)}) AS n FROM documents")
def clean_text(spark, d):
    return b.documents(spark, d).select("id", F.length(tx.clean_text(F.col("text"))).cast("bigint").alias("n"))


_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(replace(strip_accents(lower(split_part(text, chr(10), 1))), 'ß', 'ss')), '\s+[|–—-]\s+[^|–—-]{1,40}$', ''), '^(the|a|an|exclusive|breaking|opinion|analysis|update \d+|updated|video|watch|live)\s+', ''), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_title", f"SELECT doc_id AS id, {_TITLE} AS title FROM documents")
def normalize_title(spark, d):
    return b.documents(spark, d).select("id", tx.normalize_title(F.col("title")).alias("title"))


@query("title_key", f"SELECT id, CASE WHEN len(string_split(t, ' ')) >= 3 AND length(replace(t, ' ', '')) >= 12 THEN replace(t, ' ', '-') END AS key FROM (SELECT doc_id AS id, {_TITLE} AS t FROM documents)")
def title_key(spark, d):
    return b.documents(spark, d).select("id", tx.title_key(F.col("title")).alias("key"))


@query("truncate", r"SELECT doc_id AS id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 79), '\s+$', '') || '…' END AS short FROM documents")
def truncate(spark, d):
    return b.documents(spark, d).select("id", tx.truncate(F.col("text"), 80).alias("short"))


@query("tokens", "SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS n, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:5], ' ') AS head FROM documents")
def tokens(spark, d):
    t = tx.tokens(F.col("text"))
    return b.documents(spark, d).select("id", t.alias("t")).select("id", F.size("t").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


_TOK = "SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents"


@query("shingles", f"SELECT id, (CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) END)::INTEGER AS n FROM ({_TOK})")
def shingles(spark, d):
    w = b.documents(spark, d).select("id", tx.tokens(F.col("text")).alias("w"))
    return w.select("id", F.size(fp.shingles(F.col("w"), 5)).alias("n"))


_FOLD_CASES = " ".join(
    f"WHEN length(w) >= {len(s) + 4} AND ends_with(w, '{s}') THEN " + ("CASE WHEN ends_with(substr(w, 1, length(w) - 3), 'i') THEN substr(w, 1, length(w) - 4) ELSE substr(w, 1, length(w) - 3) || 'y' END" if s == "ies" else f"substr(w, 1, length(w) - {len(s)})")
    for s in tx.SUFFIXES
)


@query("fold_stem", f"SELECT CASE {_FOLD_CASES} ELSE w END AS stem, count(*) AS n FROM (SELECT unnest(w) AS w FROM ({_TOK})) GROUP BY 1")
def fold_stem(spark, d):
    w = b.documents(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.groupBy(tx.fold(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


_COMPARABLE = "trim(lower(regexp_replace(replace(translate(text, '‘’“”–—' || chr(160), repeat(chr(39), 2) || '\"\"-- '), '…', '...'), '\\s+', ' ', 'g')))"


@query("comparable", f"SELECT doc_id AS id, md5({_COMPARABLE}) AS h FROM documents")
def comparable(spark, d):
    return b.documents(spark, d).select("id", F.md5(tx.comparable(F.col("text"))).alias("h"))


@query("excerpt_appears_in", r"""WITH c AS (SELECT doc_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), i AS (SELECT item_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark)
SELECT item_id, count(*) AS documents, min(doc_id) AS first_document FROM i JOIN c ON contains(c.t, i.t) GROUP BY 1""")
def excerpt_appears_in(spark, d):
    """Which held passages are quoted verbatim, and where first."""
    items = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tx.comparable(F.col("text")).alias("needle"))
    docs = b.documents(spark, d).select("id", tx.comparable(F.col("text")).alias("hay"))
    return ret.quoted(docs, items).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("documents"), F.min("id").alias("first_document"))


@query("prepare_query", """SELECT item_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1), lambda w: '"' || w || '"'), ' OR ') AS q FROM benchmark""")
def prepare_query(spark, d):
    return b.table(spark, d, "benchmark").select("item_id", tx.prepare_query(F.col("text")).alias("q"))


@query("strip_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def strip_tags(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("h"))


@query("is_weak_name", r"WITH n AS (SELECT c_custkey AS id, list_filter(regexp_split_to_array(c_name, '[\s.]+'), lambda w: w <> '') AS w FROM customer) SELECT id, len(w) < 2 OR (len(w) = 2 AND length(w[1]) = 1) AS weak FROM n")
def is_weak_name(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), tx.is_weak_name(F.col("c_name")).alias("weak"))


@query("looks_like_prose", r"""WITH t AS (SELECT doc_id AS id, text AS t, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT id, length(t) >= 40 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 0.5 * length(t) AND length(regexp_replace(t, '[^\s]', '', 'g')) >= 0.06 * length(t)
AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{2,15}[.,;:!?]?$'))) >= 0.35 * len(w) AS prose FROM t""")
def looks_like_prose(spark, d):
    return b.documents(spark, d).select("id", tx.looks_like_prose(F.col("text")).alias("prose"))


@query("escape_markdown", r"SELECT doc_id AS id, md5(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[[', '\[\['), ']]', '\]\]'), '`', '\`'), '|', '\|')) AS h FROM documents")
def escape_markdown(spark, d):
    return b.documents(spark, d).select("id", F.md5(tx.escape_markdown(F.col("text"))).alias("h"))


@query("safe_filename", r"""SELECT id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS name FROM (SELECT page_id AS id,
substr(regexp_replace(regexp_replace(regexp_replace(url, '[\\/:*?"<>|#^\[\]\n\r\t]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 80) AS s FROM pages)""")
def safe_filename(spark, d):
    return b.table(spark, d, "pages").select(F.col("page_id").alias("id"), tx.safe_filename(F.col("url")).alias("name"))


@query("injection_marker", r"SELECT conv_id, count(*) FILTER (regexp_matches(text, '(?im)^\s*(system|assistant|user|developer)\s*:|</?\s*(document|evidence|system|instructions?)\b')) AS flagged, count(*) AS turns FROM conversations GROUP BY 1")
def injection_marker(spark, d):
    c = b.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(tx.injection_marker(F.col("text"))).alias("flagged"), F.count("*").alias("turns"))


@query("best_text", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), '') AS best FROM pages")
def best_text(spark, d):
    h = F.col("html")
    return b.table(spark, d, "pages").select("page_id", tx.best_text(F.regexp_extract(h, "<h1>([^<]*)", 1), F.lit(None).cast("string"), F.regexp_extract(h, "<title>([^<]*)", 1)).alias("best"))


@query("extract_page_subset", """SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INTEGER AS links FROM pages""")
def extract_page_subset(spark, d):
    h = F.col("html")
    return b.table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"), F.regexp_extract(h, '<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1))).alias("links"))


# --- urls -------------------------------------------------------------------
_U = r"WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),"
_TRACK = ", ".join(f"'{t.lower()}'" for t in ur.TRACKING if t != "outputType")
_CANON = _U + f"""
k AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda q: regexp_matches(q, '^[^=]+=.') AND lower(split_part(q, '=', 1)) NOT IN ({_TRACK}))) AS kept,
  CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS cpath FROM p),
c AS (SELECT page_id, host, lower(scheme) || '://' || host || cpath || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k),
h AS (SELECT *, CASE WHEN len(string_split(host, '.')) > 2 AND regexp_matches(host, '^(www|m|mobile|amp)\\.') THEN regexp_replace(host, '^[a-z]+\\.', '') ELSE host END AS bare FROM c)
"""


@query("canonicalize_url", _CANON + "SELECT page_id, canonical FROM h")
def canonicalize_url(spark, d):
    return b.table(spark, d, "pages").select("page_id", ur.canonicalize(F.col("url")).alias("canonical"))


@query("url_host", _CANON + "SELECT page_id, bare AS host, array_to_string(string_split(bare, '.')[-2:], '.') AS domain FROM h")
def url_host(spark, d):
    host = ur.host_of(F.col("url"))
    return b.table(spark, d, "pages").select("page_id", host.alias("host"), ur.registrable_domain(host).alias("domain"))


@query("url_identity_key", _CANON + r"""SELECT page_id, lower(bare || regexp_replace(regexp_extract(canonical, '://[^/?#]*([^?#]*)', 1), '/+$', '') ||
CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS key FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(canonical, '\?(.*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('amp', 'outputtype', 'page'))) AS q FROM h)""")
def url_identity_key(spark, d):
    return b.table(spark, d, "pages").select("page_id", ur.identity_key(F.col("url")).alias("key"))


_DOMAINS = "CASE WHEN page_id % 9 = 0 THEN 'https://www.youtube.com/watch?v=' WHEN page_id % 9 = 1 THEN 'https://news.ycombinator.com/item?id=' WHEN page_id % 9 = 2 THEN 'https://www.sec.gov/archives/edgar/' WHEN page_id % 9 = 3 THEN 'https://www.nrc.gov/docs/' WHEN page_id % 9 = 4 THEN 'https://data.energy.govt.nz/' WHEN page_id % 9 = 5 THEN 'https://firm.example.com/newsroom/' WHEN page_id % 9 = 6 THEN 'https://www.prnewswire.com/a/' WHEN page_id % 9 = 7 THEN 'https://x.com/u/' ELSE 'https://paper.example.org/story/' END || page_id"


@query("classify_url", """SELECT page_id, ['video', 'web_page', 'corporate_filing', 'regulatory_document', 'government_document', 'press_release', 'press_release', 'social_post', 'secondary_news_reporting'][(page_id % 9) + 1] AS source_type FROM pages""")
def classify_url(spark, d):
    u = b.table(spark, d, "pages").select("page_id", F.expr(_DOMAINS).alias("url"))
    return u.select("page_id", ur.classify(F.col("url"), is_news=F.col("page_id") % 9 == 8).alias("source_type"))


_WIRES = "|".join(ids.WIRES)


@query("wire_service", rf"""WITH t AS (SELECT doc_id, substr(['CITY (Reuters) - ', 'CITY ( AFP ) - ', 'By nobody - ', 'X (Bloomberg) '][(doc_id % 4) + 1] || text, 1, 600) AS t FROM documents)
SELECT doc_id AS id, MAP {{{", ".join(f"'{k}': '{v}'" for k, v in ids.WIRES.items())}}}[lower(coalesce(nullif(regexp_extract(t, '(?i)\(\s*({_WIRES})\s*\)', 1), ''),
  nullif(regexp_extract(t, '(?i)(?:^|\n)\s*(?:by\s+)?({_WIRES})\s*[–—-]\s', 1), '')))] AS wire FROM t""")
def wire_service(spark, d):
    """Whole texts behind an opening that may credit a service; credits count where an opening can stand."""
    heads = F.array(*map(F.lit, ("CITY (Reuters) - ", "CITY ( AFP ) - ", "By nobody - ", "X (Bloomberg) ")))
    t = b.documents(spark, d).select("id", F.concat(F.get(heads, (F.col("id") % 4).cast("int")), "text").alias("t"))
    return t.select("id", ids.wire_service(F.col("t")).alias("wire"))


# --- identifiers ------------------------------------------------------------
@query("normalize_doi", """SELECT item_id, CASE item_id % 5 WHEN 0 THEN '10.1000/x' || item_id WHEN 1 THEN '10.5555/ab/' || item_id WHEN 2 THEN '10.1234/q(1)' WHEN 3 THEN '10.1000/a(' || item_id || ')' WHEN 4 THEN '10.48550/arxiv.2401.0' || item_id END AS doi FROM benchmark""")
def normalize_doi(spark, d):
    forms = ("https://doi.org/10.1000/X%s", "doi: 10.5555/Ab/%s.", "see (10.1234/q(1)), of %s", "https://doi.org/10.1000%%2FA(%s).", "10.48550/arXiv.2401.0%s")
    raw = F.element_at(F.array(*[F.format_string(f, F.col("item_id").cast("string")) for f in forms]), (F.col("item_id") % 5 + 1).cast("int"))
    x = b.table(spark, d, "benchmark").select("item_id", raw.alias("raw"))
    return x.select("item_id", ids.normalize_doi(F.col("raw")).alias("doi"))


@query("normalize_arxiv_id", """SELECT item_id, '2401.0' || lpad((item_id % 10000)::VARCHAR, 4, '0') AS arxiv_id FROM benchmark""")
def normalize_arxiv_id(spark, d):
    n = F.concat(F.lit("2401.0"), F.lpad((F.col("item_id") % 10000).cast("string"), 4, "0"))
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("arXiv:"), n, F.lit("v2"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("https://arxiv.org/abs/"), n)).otherwise(F.concat(F.lit("10.48550/arXiv."), n))
    return b.table(spark, d, "benchmark").select("item_id", ids.normalize_arxiv_id(raw).alias("arxiv_id"))


@query("parse_id", r"SELECT c_custkey AS id, 'customer' AS prefix, c_custkey AS ordinal, true AS valid FROM customer")
def parse_id(spark, d):
    x = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"))
    return x.select("id", ids.id_prefix(F.col("key")).alias("prefix"), ids.id_ordinal(F.col("key")).alias("ordinal"), ids.is_id(F.col("key")).alias("valid"))


# --- hashes -----------------------------------------------------------------
@query("content_hash", r"SELECT doc_id AS id, CASE WHEN t || l <> '' THEN 'sha256:' || sha256(t || chr(31) || l) END AS h FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, lang AS l FROM documents)")
def content_hash(spark, d):
    return b.documents(spark, d).select("id", fp.content_hash(F.col("text"), F.col("lang")).alias("h"))


@query("hashing_embed", "SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1, 2")
def hashing_embed(spark, d):
    w = b.documents(spark, d).select("id", F.explode(tx.tokens(F.col("text"))).alias("w"))
    return w.groupBy("id", F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(64)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("detect_kind", """SELECT page_id, CASE WHEN starts_with(lower(html), '<!doctype html') OR starts_with(lower(html), '<html') THEN 'html' WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(html, '{') THEN 'json' ELSE 'text' END AS kind FROM pages""")
def detect_kind(spark, d):
    from ..sources import files

    return b.table(spark, d, "pages").select("page_id", files.detect_kind(F.encode("html", "UTF-8"), F.lit("")).alias("kind"))


@query("parse_date", """SELECT event_id, date_trunc('day', ts) AS at FROM events""")
def parse_date(spark, d):
    from ..functions import dates

    e = b.table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "d MMMM yyyy")).otherwise(F.date_format("ts", "yyyyMMdd'T'000000'Z'"))
    return e.select("event_id", dates.parse_date(raw).alias("at"))


@query("date_precision", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('month', ts) ELSE date_trunc('quarter', ts) END AS at, ['year', 'month', 'quarter'][(event_id % 3) + 1] AS precision FROM events")
def date_precision(spark, d):
    from ..functions import dates

    p = F.get(F.array(*map(F.lit, ("year", "month", "quarter"))), (F.col("event_id") % 3).cast("int"))
    return b.table(spark, d, "events").select("event_id", dates.truncate_to(F.col("ts"), p).alias("at"), p.alias("precision"))
