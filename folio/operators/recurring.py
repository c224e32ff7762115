"""Recurring short texts: groups, varying numbers, templates and their use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def candidates(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Blocks short enough to recur, with ``norm_key``."""
    return blocks.where(F.length("text") < cfg.recurring_max_len).withColumn("norm_key", T.norm_key(F.col("text"), cfg.key_length))


def recurring(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, norm_key, n, pages`` of keys with enough members."""
    return (candidates(blocks, cfg).groupBy("doc", "norm_key").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))
            .where(F.col("n") >= cfg.recurring_min_count))


def varying_digits(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, norm_key, pos``: digit runs that differ inside a recurring group, where every member has them."""
    rows = candidates(blocks, cfg).withColumn("runs", T.digit_runs(F.col("text")))
    # one row a distinct list of runs: a frequent text is one row before anything is exploded
    kinds = rows.groupBy("doc", "norm_key", "runs").agg(F.count("*").alias("n"))
    size = kinds.groupBy("doc", "norm_key").agg(F.sum("n").alias("n"), F.min(F.size("runs")).alias("least")).where(F.col("n") >= cfg.recurring_min_count)
    values = kinds.join(size.drop("n"), ["doc", "norm_key"]).select("doc", "norm_key", F.posexplode(F.slice("runs", F.lit(1), F.col("least"))).alias("pos", "value"))
    return values.groupBy("doc", "norm_key", "pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("doc", "norm_key", "pos")


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``keys, value, n``: the commonest value of a group, the first seen of equals."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("seen")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{value}").alias(value), F.col("best.n").alias("n"))


def majority(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``keys, flag``: true where more than half of the rows have it."""
    return rows.groupBy(*keys).agg((F.count_if(F.col(flag)) * 2 > F.count("*")).alias(flag))


def templates(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, norm_key, text, template, sig, n, seen`` of recurring groups whose members have one number of digit runs.

    The template numbers the digit runs of the group's commonest text.
    """
    rows = candidates(blocks, cfg)
    shape = rows.groupBy("doc", "norm_key").agg(
        F.count("*").alias("n"), F.min(F.size(T.digit_runs(F.col("text")))).alias("lo"), F.max(F.size(T.digit_runs(F.col("text")))).alias("hi"), F.min("ord").alias("seen"))
    fit = shape.where((F.col("n") >= cfg.recurring_min_count) & (F.col("lo") == F.col("hi"))).select("doc", "norm_key", "n", "seen")
    modal = first_seen_mode(rows, ["doc", "norm_key"], "text", "ord").drop("n")
    out = fit.join(modal, ["doc", "norm_key"]).withColumn("template", T.number_runs(F.col("text")))
    return out.withColumn("sig", T.signature(F.col("template")))


def apply_recurring(blocks: DataFrame, table: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, id, zh``: blocks of a recurring key get its template with their own numbers; missing ones are blanked."""
    hit = candidates(blocks, cfg).join(table.select("doc", "norm_key", F.col("template").alias("t")), ["doc", "norm_key"])
    return hit.select("doc", "id", T.restore_runs(F.col("t"), F.col("text"), blank=True).alias("zh"))


def slim(items: DataFrame, covered: DataFrame, table: DataFrame) -> DataFrame:
    """Chunk items that neither a covered block id nor a recurring key already answers."""
    left = items.join(covered.select("doc", "id").distinct(), ["doc", "id"], "left_anti")
    return left.join(table.select("doc", "norm_key").distinct(), ["doc", "norm_key"], "left_anti")
