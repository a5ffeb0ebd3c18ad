"""The thin queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontam, jaccard, kdtree, mixing, quality, repair, suffix_dedup, token_count, toxicity, url_filter, warc
from .common import shared_path, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, fitted outside the held-out fold; label 1 at 0.7 or more."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in the shared folder, read back; equal payloads of any size are revisits."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"), 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the public ranks and pattern, and decoded again."""
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the production rules and its aliases."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, fitted outside the held-out fold; label 1 at 0.7 or more."""
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, components times 64 and floored."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), 20, 64, 20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that a repeated string of 400 bytes covers."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar to nine tenths."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark, also with other numbers, names or units."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the public piece model, and whether they are more than 4096."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources, of half as much again, takes of every document; no source above two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"), (3, 1, 2), (3, 2), 2).select("doc_id", "size", "source_size", "target", "taken")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, and the cheapest edits that repair it."""
    return repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of 40 centroids over all vectors, components times 256 and floored."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), 40, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_token_count": op10_token_count,
    "op11_mixing": op11_mixing,
    "op12_repair": op12_repair,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op4_url_filter": url_filter.SQL,
    "op6_exact_top_k": kdtree.SQL,
    "op8_jaccard_join": jaccard.SQL,
    "op9_decontamination": decontam.SQL,
    "op11_mixing": mixing.SQL,
    "op12_repair": repair.SQL,
    "op13_centroids": centroids.SQL,
}
