"""From raw documents to token ids: five filtering stages, each one of the llm operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and (but for the last) returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, decontam, jaccard, quality, suffix_dedup
from sieveline.llm.common import cut, table

#: Documents scored below this are rejected.
MIN_QUALITY = 0.5
#: Near-duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
WORDS, NUM, DEN = 5, 80, 100
#: Bytes of a repeated string: the shortest passage of over 50 words counts.
REPEAT_BYTES = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    usable = ~quality.in_split(F.col("doc_id"), 4, 2)
    model = quality.fit(quality.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", usable, quality.SAMPLE_ROWS))
    scored = quality.keep_quality(docs, model, MIN_QUALITY)
    return scored.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near-duplicates.

    Documents are rows, not ids: rows that agree in id and text are one, texts
    under one id, or under a null id, are documents of their own; a null and an
    empty text under one id are one. A null id stays only in a group that has
    no other.
    """
    groups = jaccard.jaccard_components(docs, WORDS, NUM, DEN, thin=True, rows=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))
    keep = groups.groupBy(F.coalesce("root", "rid")).agg(first.alias("first")).select(F.col("first.rid").alias("_rid"))
    rows = docs.withColumn("_rid", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return rows.join(keep.hint("merge"), "_rid", "left_semi").dropDuplicates(["_rid"]).select(*docs.columns)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; a text of which nothing is left goes."""
    return suffix_dedup.cut_repeats(docs, REPEAT_BYTES)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, and decode it again: ids, their number and digests, and whether the text came back."""
    out = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: A classifier and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
