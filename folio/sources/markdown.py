"""Markdown units with code, inline code, addresses and anchors protected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_FENCE = r"(?s)(?:^|(?<=\n))(?:```|~~~).*?(?:\n(?:```|~~~)[ \t]*(?=\n|$)|$)"
# fixed order: inline code, link targets, bare addresses, anchors
PROTECTED = r"`[^`\n]+`|(?<=\])\([^)\s]*\)|https?://[^\s)>]+|\{#[^}]*\}"


def segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, text, kept``: a row a non-blank line outside code fences, protected spans as ``⟦Ki⟧`` and kept aside in order."""
    lines = F.filter(F.split(F.regexp_replace(F.col(text), _FENCE, ""), "\n", -1), lambda x: F.trim(x) != "")
    rows = docs.select(key, F.posexplode(lines).alias("ord", "line"))
    return rows.select(key, "ord", masked(F.col("line")).alias("text"), F.regexp_extract_all("line", F.lit(PROTECTED), F.lit(0)).alias("kept"))


def masked(c: Column) -> Column:
    pieces = F.split(c, PROTECTED, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦K"), (i - 1).cast("string"), F.lit("⟧"), p))), "")


def unmasked(c: Column, kept: Column) -> Column:
    hole = "⟦K([0-9]+)⟧"
    fill = lambda x, i: F.coalesce(F.try_element_at(kept, x.cast("int") + 1), F.lit(""))
    return T._joined(F.split(c, hole, -1), F.regexp_extract_all(c, F.lit(hole), F.lit(1)), fill)
