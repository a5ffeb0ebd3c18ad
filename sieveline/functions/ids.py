"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wire services by the names they are credited under.
WIRES = {
    "reuters": "Reuters", "associated press": "Associated Press", "ap": "Associated Press", "afp": "Agence France-Presse",
    "agence france-presse": "Agence France-Presse", "bloomberg": "Bloomberg", "pa media": "PA Media", "press association": "PA Media",
    "dpa": "dpa", "kyodo": "Kyodo News", "xinhua": "Xinhua", "efe": "EFE", "ansa": "ANSA", "tass": "TASS", "ani": "ANI", "pti": "Press Trust of India",
}


#: What a DOI looks like, and signs that end the sentence around it.
DOI = r"""\b(10\.\d{4,9}/[^\s"'<>]+)"""
DOI_TRAILING = r"""[.,;:)\]}>"']+$"""
#: arXiv ids of the present and of the old scheme.
ARXIV = r"(?:^|[^0-9.])(\d{4}\.\d{4,5})(?:v\d+)?(?![0-9])"
ARXIV_OLD = r"(?i)\b([a-z-]+(?:\.[A-Z]{2})?/\d{7})"


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _closed(doi: Column, trimmed: Column, opener: str, closer: str) -> Column:
    """``trimmed`` with as many of the closing brackets that follow in ``doi`` as it has open ones."""
    follow = F.length(F.regexp_extract(F.substring(doi, F.length(trimmed) + 1, 1 << 30), "^[" + "\\" + closer + "]*", 0))
    need = F.greatest(F.lit(0), _count(trimmed, opener) - _count(trimmed, closer))
    return F.concat(trimmed, F.repeat(F.lit(closer), F.least(need, follow)))


def normalize_doi(raw: Column) -> Column:
    """Bare lower-case DOI from a DOI, its url (percent-encoded or not) or prose.

    Closing signs at the end go, but for brackets that close one inside the DOI.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    text = F.when(text.contains("://") & (plain != ""), plain).otherwise(text)
    doi = F.regexp_extract(text, DOI, 1)
    trimmed = F.regexp_replace(doi, DOI_TRAILING, "")
    for opener, closer in (("(", ")"), ("[", "]")):
        trimmed = _closed(doi, trimmed, opener, closer)
    return F.nullif(F.lower(trimmed), F.lit(""))


def normalize_arxiv_id(raw: Column) -> Column:
    """arXiv id without a version, from an id, a DOI or a url; null for other hosts' urls."""
    t = F.regexp_replace(F.trim(raw), r"(?i)^10\.48550/arxiv\.", "")
    new, old = F.regexp_extract(t, ARXIV, 1), F.regexp_extract(t, ARXIV_OLD, 1)
    foreign = t.contains("://") & ~F.lower(t).rlike("^[a-z]+://([^/]*[.])?arxiv[.]org")
    return F.when(~foreign, F.lower(F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))))


def wire_service(text: Column, publisher: Column | None = None) -> Column:
    """Wire service that the publisher is, or that the opening credits."""
    names = F.create_map(*[F.lit(x) for kv in WIRES.items() for x in kv])
    alt = "|".join(WIRES)
    head = F.substring(F.coalesce(text, F.lit("")), 1, 600)
    credit = F.coalesce(
        F.nullif(F.regexp_extract(head, rf"(?i)\(\s*({alt})\s*\)", 1), F.lit("")),
        F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\n)\s*(?:by\s+)?({alt})\s*[–—-]\s", 1), F.lit("")),
    )
    found = names[F.lower(credit)]
    return found if publisher is None else F.coalesce(names[F.lower(F.trim(publisher))], found)


_ID = r"^([a-z_]+):(\d+)$"


def is_id(key: Column) -> Column:
    return F.coalesce(key, F.lit("")).rlike(_ID)


def id_prefix(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, _ID, 1), F.lit(""))


def id_ordinal(key: Column) -> Column:
    """The number of an id, by which ids sort."""
    return F.nullif(F.regexp_extract(key, _ID, 2), F.lit("")).cast("bigint")


def extract_dois(text: Column, limit: int = 20) -> Column:
    """Distinct DOIs of a text in order, ``limit`` at most."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOI), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, normalize_doi), lambda x: x.isNotNull())), 1, limit)


def doi_to_url(raw: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), normalize_doi(raw))


def split_authors(raw: Column) -> Column:
    """Names of a list written with semicolons, pipes, commas or a final ``and``."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\s*(?:;|\||,|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


#: What marks a work as a preprint.
PREPRINTS = r"(?i)preprint|arxiv|biorxiv|medrxiv|ssrn|posted-content|10\.48550/|research ?square"


def classify_work(kind: Column, venue: Column, doi: Column, url: Column) -> Column:
    """Preprint by type, venue, DOI or url; else peer-reviewed."""
    return F.when(F.concat_ws(" ", kind, venue, doi, url).rlike(PREPRINTS), "academic_preprint").otherwise("academic_peer_reviewed")


def family_for(source_type: Column) -> Column:
    """Family of a source type."""
    return (
        F.when(source_type.startswith("academic"), "academic").when(source_type.contains("news"), "news").when(source_type.isin("press_release", "corporate_filing"), "corporate")
        .when(source_type.isin("regulatory_document", "government_document"), "government").when(source_type.isin("social_post", "forum_post", "video"), "social").otherwise("web")
    )
