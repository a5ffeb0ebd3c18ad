"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What outlets add to article bodies.
BOILERPLATE = (r"(?im)^\s*(sign up|subscribe|share this|advertisement|read more)\b.*$", r"(?i)©\s*\d{4}[^\n]*", r"(?i)all rights reserved[^\n]*")
#: A leading word that title keys leave out, once.
TITLE_PREFIX = r"^(the|a|an|exclusive|breaking|opinion|analysis|update \d+|updated|video|watch|live)\s+"
#: Suffixes of the crude stem, tried in this order.
SUFFIXES = ("iness", "ingly", "ness", "ing", "ies", "ied", "es", "ed", "ly", "s")
#: Least number of characters, and shares of letters, blanks and plausible words, of legible text.
PROSE = {"characters": 40, "letters": 0.5, "blanks": 0.06, "words": 0.35}
#: Typographic signs and what they are compared as.
QUOTES_FROM, QUOTES_TO = "‘’“”–— ", "''\"\"-- "


def composed(text: Column) -> Column:
    """The text in normal form KC, by the JVM's Unicode library; plain ASCII is not touched."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)


def unaccented(text: Column) -> Column:
    """Case folded, decomposed (normal form KD), and without combining marks."""
    plain = F.regexp_replace(F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)), r"\p{M}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), plain, F.lit(True))).otherwise(F.lower(text))


def best_text(text: Column, abstract: Column, title: Column) -> Column:
    """First of text, abstract and title that is not empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(abstract, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    """Normal form KC, one line-feed style, single blanks, trimmed lines, at most one empty line in a row; null is empty."""
    return _single_spaced(composed(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")))


def _single_spaced(t: Column) -> Column:
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Normalised text without outlets' boilerplate lines."""
    t = normalize_whitespace(text)
    for pattern in BOILERPLATE:
        t = F.regexp_replace(t, pattern, "")
    return _single_spaced(t)


def normalize_title(title: Column) -> Column:
    """Case-folded words of a title, without accents, outlet suffix and one leading prefix."""
    t = F.trim(unaccented(F.coalesce(title, F.lit(""))))
    t = F.regexp_replace(t, r"\s+[|–—-]\s+[^|–—-]{1,40}$", "")
    t = F.regexp_replace(t, TITLE_PREFIX, "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def title_key(title: Column) -> Column:
    """Dash-joined title; null when it has under three words or twelve letters."""
    t = normalize_title(title)
    words = F.split(t, " ")
    return F.when((F.size(words) >= 3) & (F.length(F.replace(t, F.lit(" "), F.lit(""))) >= 12), F.array_join(words, "-"))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def fold(word: Column) -> Column:
    """A crude stem: the first listed suffix that leaves four letters goes."""
    low = F.lower(word)
    out = low
    for s in reversed(SUFFIXES):
        stem = F.substring(low, F.lit(1), F.length(low) - len(s))
        if s == "ies":
            stem = F.when(stem.endswith("i"), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(F.concat(stem, F.lit("y")))
        out = F.when((F.length(low) >= len(s) + 4) & low.endswith(s), stem).otherwise(out)
    return out


def singular(word: Column) -> Column:
    """Plural folding of the fixed-corpus search: one final s of a word over three letters."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def comparable(text: Column) -> Column:
    """The form in which quotations are compared: plain quotes, dashes and blanks, lower case."""
    t = F.replace(F.translate(F.coalesce(text, F.lit("")), QUOTES_FROM, QUOTES_TO), F.lit("…"), F.lit("..."))
    return F.trim(F.lower(F.regexp_replace(t, r"\s+", " ")))


def contains_excerpt(haystack: Column, excerpt: Column) -> Column:
    """Whether the excerpt stands verbatim in the text; an empty one does not."""
    needle = comparable(excerpt)
    return (needle != "") & comparable(haystack).contains(needle)


def prepare_query(text: Column, mode: str = "any") -> Column:
    """A full-text match expression: quoted words of two letters or more, joined by OR, or by AND."""
    words = F.filter(tokens(text), lambda w: F.length(w) > 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND " if mode == "all" else " OR ")


def strip_tags(text: Column) -> Column:
    """Markup removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "), r"\s+", " "))


def is_weak_name(name: Column) -> Column:
    """Under two words, or two of which the first is an initial."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"[\s.]+"), lambda w: w != "")
    return (F.size(words) < 2) | ((F.size(words) == 2) & (F.length(F.get(words, F.lit(0))) == 1))


def looks_like_prose(text: Column) -> Column:
    """Legible text: long enough, with enough letters, blanks and plausible words (``PROSE``)."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    blanks = F.length(F.regexp_replace(t, r"[^\s]", ""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    good = F.filter(words, lambda w: w.rlike("^[A-Za-z]{2,15}[.,;:!?]?$"))
    return (n >= PROSE["characters"]) & (letters >= PROSE["letters"] * n) & (blanks >= PROSE["blanks"] * n) & (F.size(good) >= PROSE["words"] * F.size(words))


def escape_markdown(text: Column) -> Column:
    """External text that cannot start markup: angle brackets and brackets are spelled out."""
    t = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[[", r"\[\["), ("]]", r"\]\]"), ("`", r"\`"), ("|", r"\|")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def safe_filename(name: Column, limit: int = 80) -> Column:
    """A name without what file systems and links forbid."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|#^\[\]\n\r\t]+', " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    t = F.substring(t, 1, limit)
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def injection_marker(text: Column) -> Column:
    """Whether external text imitates a role header or an envelope tag."""
    return F.coalesce(text, F.lit("")).rlike(r"(?im)^\s*(system|assistant|user|developer)\s*:|</?\s*(document|evidence|system|instructions?)\b")


def sanitize(text: Column) -> Column:
    """External text whose role headers and envelope tags are defanged."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^(\s*)(system|assistant|user|developer)(\s*):", r"$1[$2]$3;")
    return F.regexp_replace(t, r"(?i)<(/?\s*(?:document|evidence|system|instructions?)\b)", r"($1")


def json_in(prose: Column) -> Column:
    """The JSON object in a fenced block, else from the first brace to the last; null without one."""
    fenced = F.regexp_extract(prose, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(prose, r"(?s)\{.*\}", 0), F.lit("")))
