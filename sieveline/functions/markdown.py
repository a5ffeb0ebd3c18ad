"""Markdown and note syntax as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def yaml_scalar(value: Column) -> Column:
    """A value on one line, in double quotes: JSON strings are YAML scalars, so no title can end the block."""
    return F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def frontmatter(properties: Mapping[str, Column]) -> Column:
    """Properties between ``---`` lines, by name; null and empty ones are left out, and without any the block is."""
    kept = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}: "), yaml_scalar(v))) for k, v in sorted(properties.items())]
    body = F.concat_ws("\n", *kept)
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("---\n"), body, F.lit("\n---\n")))


def wikilink(note: Column, alias: Column | None = None) -> Column:
    """A link to another note; what would end the link early is replaced."""
    target = F.translate(note, "|[]", " ()")
    inner = target if alias is None else F.concat(target, F.lit("|"), F.translate(alias, "|", " "))
    return F.concat(F.lit("[["), inner, F.lit("]]"))


def blockquote(text: Column) -> Column:
    """Every line quoted."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^", "> "), r"(?m)^> $", ">")


def callout(kind: str, title: Column, body: Column) -> Column:
    """A block with a marked first line, its body quoted below."""
    return F.concat(F.lit(f"> [!{kind}] "), title, F.lit("\n"), blockquote(body))
