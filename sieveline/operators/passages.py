"""Documents to passages, and the passages that answer a question."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import ship_package
from ..shared import cut

#: A passage's size, and the size below which it joins the one before.
LIMIT, SHORT = 900, 200
_SENTENCE_END = re.compile(r"[.!?]+(?=\s)\s*|\n\s*")


def cut_text(text: str) -> list[tuple[int, int]]:
    """Offsets of passages: sentences packed up to LIMIT, never over an empty line, longer ones cut hard; a short rest joins its predecessor. Only blanks are in none."""
    out: list[tuple[int, int]] = []
    for para in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", text):
        start = end = para.start()
        ends = [m.end() for m in _SENTENCE_END.finditer(text, para.start(), para.end())]
        for b in ends if ends and ends[-1] == para.end() else [*ends, para.end()]:
            if b - start > LIMIT and end > start:
                out.append((start, end))
                start = end
            while b - start > LIMIT:
                out.append((start, start + LIMIT))
                start += LIMIT
            end = b
        if end > start:
            if out and end - start < SHORT and end - out[-1][0] <= LIMIT + SHORT:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return [(a, b) for a, b in out if text[a:b].strip()]


class Passages:
    """The table function behind :func:`split_passages`: a text to its passages."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for k, (a, b) in enumerate(cut_text(text or "")):
            yield k, a, text[a:b]


def passage_function() -> Callable:
    """``passages(text)`` as an Arrow table function: ``passage, start, text``; for lateral joins, or to register for SQL."""
    return F.udtf(Passages, returnType="passage int, start int, text string", useArrow=True)


def split_passages(docs: DataFrame) -> DataFrame:
    """``id, passage, start, text``: verbatim slices of each ``id, text``, numbered from 0, by a lateral join with the table function."""
    ship_package(docs.sparkSession)
    cut = passage_function()(F.col("body").outer())
    return docs.select("id", F.col("text").alias("body")).lateralJoin(cut).select("id", "passage", "start", "text")


def _held(passages: DataFrame) -> DataFrame:
    """Passages with their words in place of the text, written once: all that follows reads them there, and no text is cut twice."""
    return cut(passages.select(*[c for c in ("id", "passage", "start") if c in passages.columns], tx.tokens(F.col("text")).alias("w")), "passages")


def bm25(passages: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, id, passage, score``: BM25 within each document, on folded words.

    A word in half of a document's passages or more says nothing and is skipped.
    Whether the queries are broadcast is left to their size.
    """
    return _scored(_held(passages), queries, k1, b)


def _scored(held: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """:func:`bm25` of passages with their words ``w``. Lengths are counted in place; only words that a query has are dealt out."""
    q = queries.select("query_id", F.explode(F.filter(tx.tokens(F.col("text")), lambda w: F.length(w) > 1)).alias("w")).select("query_id", tx.fold(F.col("w")).alias("term")).distinct()
    words = held.select("id", "passage", F.explode("w").alias("w")).select("id", "passage", tx.fold(F.col("w")).alias("term"))
    tf = words.join(q.select("term").distinct(), "term", "left_semi").groupBy("id", "passage", "term").agg(F.count("*").alias("tf"))
    sized = held.select("id", "passage", F.size("w").cast("long").alias("dl"))
    dl = sized.groupBy("id", "passage").agg(F.sum("dl").alias("dl"))
    stat = sized.groupBy("id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).withColumn("avg", F.col("total") / F.col("n"))
    # counted beside the rows: joined back, all words would be folded once more
    hit = tf.join(q, "term").withColumn("df", F.count("*").over(Window.partitionBy("query_id", "id", "term")))
    j = hit.join(dl, ["id", "passage"]).join(stat, "id")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    return j.where(idf > 0).groupBy("query_id", "id", "passage").agg(F.round(F.sum(part), 6).alias("score"))


def select_passages(passages: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """``query_id, id, passage, start, score``: each document's best ``k``, in document order."""
    held = _held(passages)
    w = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "passage")
    best = _scored(held, queries).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return best.join(held.select("id", "passage", "start"), ["id", "passage"]).select("query_id", "id", "passage", "start", "score")
