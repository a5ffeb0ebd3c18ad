"""Hashes, shingles and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, with white space flattened; null when all are empty."""
    flat = [F.trim(F.regexp_replace(F.lower(F.coalesce(p, F.lit(""))), r"\s+", " ")) for p in parts]
    joined = F.concat_ws("\x1f", *flat)
    return F.when(F.length(F.concat(*flat)) > 0, F.concat(F.lit("sha256:"), F.sha2(joined, 256)))


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles of a token array; all words, when fewer. No words, no shingle."""
    size = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(grams))


def hashed_shingles(words: Column, n: int) -> Column:
    """The set of 64-bit hashes of :func:`shingles`."""
    return F.array_distinct(F.transform(shingles(words, n), lambda g: F.xxhash64(g)))


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B|; 0 when one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """|A n B| / |A|; 0 when one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def gram_bits(gram: Column) -> tuple[Column, Column]:
    """High and low 32 bits of a gram's md5, as non-negative longs."""
    m = F.md5(gram)
    return F.conv(F.substring(m, 1, 8), 16, 10).cast("long"), F.conv(F.substring(m, 9, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def band(simhash_half: Column, shift: int) -> Column:
    """16 bits of a 32-bit half."""
    return F.shiftright(simhash_half, shift).bitwiseAND(F.lit(65535))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty or unequal sizes or a zero norm."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)
