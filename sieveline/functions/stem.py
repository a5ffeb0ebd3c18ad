"""Porter's suffix stripping (1980), over distinct words in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship_package

#: The algorithm's steps two to four, suffix and replacement, longest suffix first within a step.
STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """Consonants and vowels of a word as c and v; y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _first(word: str, rules: Iterable[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer, and others than a-z, stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            stem = w[: len(w) - len(suffix)]
            if w.endswith(suffix) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _first(_first(w, STEP2), STEP3)
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(terms: DataFrame) -> DataFrame:
    """``term, stem`` of distinct terms: the vocabulary is what Python sees, not the texts."""
    ship_package(terms.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"term": batch["term"], "stem": [porter(t) for t in batch["term"]]})

    return terms.select("term").mapInPandas(run, "term string, stem string")
