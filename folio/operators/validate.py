"""Checks of translations against the items they were asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T

PLACEHOLDER = "⟦[NP][0-9]+⟧"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def missing_ids(items: DataFrame, out: DataFrame) -> DataFrame:
    return items.select("doc", "chunk", "id").join(out.select("doc", "chunk", "id"), ["doc", "chunk", "id"], "left_anti")


def extra_ids(items: DataFrame, out: DataFrame) -> DataFrame:
    return out.select("doc", "chunk", "id").join(items.select("doc", "chunk", "id"), ["doc", "chunk", "id"], "left_anti")


def missing_files(items: DataFrame, out: DataFrame) -> DataFrame:
    """``doc, chunk, label`` of chunks without any translation."""
    have = out.select("doc", "chunk").distinct()
    return items.select("doc", "chunk").distinct().join(have, ["doc", "chunk"], "left_anti").withColumn("label", T.chunk_label(F.col("doc"), F.col("chunk")))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def flags(cfg: EngineConfig = DEFAULT) -> dict[str, Column]:
    """Flags of a row with ``text`` and a non-null ``zh``."""
    src, out = F.col("text"), F.col("zh")
    ls, lo = F.length(T.strip(src)), F.length(T.strip(out))
    holes = lambda c: F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))
    latin = src.rlike("[A-Za-z]{3,}") & ~T.is_symbolic(src)
    return {
        "bad_placeholder": ~same_multiset(holes(src), holes(out)),
        "escape": T.has_escape_residue(out) & ~T.has_escape_residue(src),
        "truncated": (ls > cfg.truncation_min_source) & (lo > 0) & (lo < cfg.truncation_share * ls) & latin,
        "short": (lo > 0) & (lo < cfg.short_output_share * ls) & src.rlike(r"(?m)^\s*(?:[-•*]|[0-9]+[.)]|\([a-z]\))\s"),
    }


def report(items: DataFrame, out: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row a chunk of counts, with ``passed``; a chunk must have all its ids and placeholders."""
    rows = items.select("doc", "chunk", "id", "text", F.lit(1).alias("asked")).join(out.select("doc", "chunk", "id", "zh", F.lit(1).alias("given")), ["doc", "chunk", "id"], "full_outer")
    both = F.col("asked").isNotNull() & F.col("given").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    agg = [n(F.col("asked").isNotNull()).alias("n_items"), n(F.col("given").isNull()).alias("n_missing"), n(F.col("asked").isNull()).alias("n_extra"), n(both & F.col("zh").isNull()).alias("n_null")]
    agg += [n(both & c).alias(f"n_{name}") for name, c in flags(cfg).items()]
    return rows.groupBy("doc", "chunk").agg(*agg).withColumn("passed", (F.col("n_items") > 0) & (F.col("n_missing") + F.col("n_extra") + F.col("n_bad_placeholder") == 0))


def totals(report_: DataFrame) -> DataFrame:
    """Per document and over all (``doc`` null): chunks and sums."""
    sums = [F.sum(c).alias(c) for c in report_.columns if c.startswith("n_")]
    return report_.rollup("doc").agg(F.count("*").alias("n_chunks"), *sums, F.bool_and("passed").alias("passed"))


def number_preservation(pairs: DataFrame) -> DataFrame:
    """Rows of ``text, zh`` with ``same_numbers``: one multiset of numbers on both sides."""
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(NUMBER), F.lit(0))
    return pairs.withColumn("same_numbers", same_multiset(numbers("text"), numbers("zh")))


def line_parity(pairs: DataFrame) -> DataFrame:
    """``src_lines, out_lines, level``: other line counts fail rotated blocks and warn elsewhere."""
    lines = lambda c: F.size(F.split(F.col(c), "\n", -1))
    rows = pairs.withColumns({"src_lines": lines("text"), "out_lines": lines("zh")})
    return rows.withColumn("level", F.when(F.col("src_lines") == F.col("out_lines"), "ok").when(F.col("rotated"), "fail").otherwise("warn"))


def count_parity(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_before, n_after, equal`` for units read before and read back."""
    a, b = before.groupBy(*keys).agg(F.count("*").alias("n_before")), after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    zero = F.lit(0).cast("long")
    rows = a.join(b, keys, "full_outer").select(*keys, F.coalesce("n_before", zero).alias("n_before"), F.coalesce("n_after", zero).alias("n_after"))
    return rows.withColumn("equal", F.col("n_before") == F.col("n_after"))


def samples(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
