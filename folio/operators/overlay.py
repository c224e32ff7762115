"""Translation layers, overrides and per-block fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def merge_layers(layers: DataFrame) -> DataFrame:
    """``doc, id, zh`` of the highest ``priority``; null and empty values are not translations."""
    rows = layers.where("zh is not null and zh <> ''")
    return rows.groupBy("doc", "id").agg(F.max_by("zh", "priority").alias("zh"))


def apply_overrides(merged: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(doc, id, set_to, append)``: set, or append to what is there; a missing base stays missing."""
    rows = merged.join(overrides, ["doc", "id"], "full_outer")
    base = F.col("zh")
    appended = F.when(base == "", F.col("append")).otherwise(F.concat(F.regexp_replace(base, r"\s+$", ""), F.col("append")))
    zh = F.when(F.col("set_to").isNotNull(), F.col("set_to")).when(F.col("append").isNotNull(), appended).otherwise(base)
    return rows.select("doc", "id", zh.alias("zh")).where("zh is not null")


def reorder(merged: DataFrame, fixes: DataFrame) -> DataFrame:
    """``fixes(doc, id, order, holes)``: put lines in order and renumber holes."""
    rows = merged.join(fixes, ["doc", "id"], "left")
    zh = F.when(F.col("order").isNotNull(), T.permute_lines(F.col("zh"), F.col("order"))).otherwise(F.col("zh"))
    zh = F.when(F.col("holes").isNotNull(), T.remap_runs(zh, F.col("holes"))).otherwise(zh)
    return rows.select("doc", "id", zh.alias("zh"))


def drop_blocks(blocks: DataFrame, ids: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    return blocks.join(ids.select("doc", "id").distinct(), ["doc", "id"], "left_anti").where(~T.starts_with_any(T.strip(F.col("text")), prefixes))


def split_lines(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    """Replace a block by the listed lines; ``splits(doc, id, line, new_id, size, color, dy)``, nulls keep the block's.

    ``blocks`` has ``lines``, an array of struct<y, x0, w, h, text>; unlisted lines are not emitted.
    """
    kept = blocks.join(splits.select("doc", "id").distinct(), ["doc", "id"], "left_anti")
    s = splits.select("doc", "id", "line", "new_id", F.col("size").alias("s_size"), F.col("color").alias("s_color"), F.coalesce("dy", F.lit(0.0)).alias("dy"))
    rows = blocks.join(s, ["doc", "id"]).withColumn("ln", F.try_element_at("lines", F.col("line") + 1)).where("ln is not null")
    y, h = F.col("ln.y") + F.col("dy"), F.when(F.col("s_size").isNotNull(), F.col("s_size") * 1.2).otherwise(F.col("ln.h"))
    one = {"nlines": F.lit(1), "line_ys": F.array(y), "line_x0s": F.array("ln.x0"), "line_ws": F.array("ln.w"), "line_hs": F.array(h)}
    new = one | {"id": F.col("new_id"), "text": F.col("ln.text"), "y0": y - 1, "y1": y + h + 1, "size": F.coalesce("s_size", "size"), "color": F.coalesce("s_color", "color"),
                 "lines": F.array(F.struct(y.alias("y"), F.col("ln.x0").alias("x0"), F.col("ln.w").alias("w"), h.alias("h"), F.col("ln.text").alias("text")))}
    new = {c: v.cast(kind) if kind != "null" else v for c, kind in blocks.dtypes if (v := new.get(c)) is not None}
    return kept.unionByName(rows.select(*[new.get(c, F.col(c)).alias(c) for c in blocks.columns]))


def shift_lines(ys: Column, shift: Column, y0: Column, y1: Column) -> Column:
    """Struct of shifted line tops and grown box; lines beyond the shorter list are left out."""
    n = F.least(F.size(ys), F.size(shift))
    cut = F.slice(shift, F.lit(1), n)
    moved = F.zip_with(F.slice(ys, F.lit(1), n), cut, lambda a, b: a + b)
    low, high = F.least(F.lit(0.0), F.array_min(cut)), F.greatest(F.lit(0.0), F.array_max(cut))
    return F.struct(moved.alias("ys"), (y0 + F.coalesce(low, F.lit(0.0))).alias("y0"), (y1 + F.coalesce(high, F.lit(0.0))).alias("y1"))


def output_name(display: Column, doc: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), doc)


def source_name(source: Column, display: Column, doc: Column, files: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` with ``source``: the first of the given file, the display name's and the document's that is in ``files(name)``; null: none is."""
    tried = F.array_distinct(F.array_compact(F.array(F.nullif(source, F.lit("")), F.concat(output_name(display, doc), F.lit(".pdf")), F.concat(doc, F.lit(".pdf")))))
    rows = names.select(*names.columns, F.posexplode(tried).alias("nth", "name")).join(files.select("name").distinct(), "name", "left_semi")
    best = rows.groupBy(doc.alias("doc")).agg(F.min_by("name", "nth").alias("source"))
    return names.select(doc.alias("doc"), output_name(display, doc).alias("output")).join(best, "doc", "left")


def redactions(blocks: DataFrame, actions: DataFrame, margin: float = 0.5) -> DataFrame:
    """``doc, page, id, x0, y0, x1, y1``: what a writer clears before it draws; only text goes, lines and images stay.

    Blocks that are drawn anew and blocks that are dropped are cleared, with a margin; kept ones are not.
    """
    gone = actions.where("action in ('DRAW', 'VERBATIM', 'DROP')").select("doc", "id", (F.col("action") != "DROP").cast("double").alias("m"))
    m = F.col("m") * margin
    return blocks.join(gone, ["doc", "id"]).select("doc", "page", "id", (F.col("x0") - m).alias("x0"), (F.col("y0") - m).alias("y0"), (F.col("x1") + m).alias("x1"), (F.col("y1") + m).alias("y1"))


#: What may happen to a block.
ACTIONS = ("KEEP", "DROP", "VERBATIM", "UNTRANSLATED", "UNRESOLVED", "DRAW")


def render_action(blocks: DataFrame, merged: DataFrame, keep: tuple[str, ...], drop: tuple[str, ...]) -> DataFrame:
    """``doc, id, action, zh``: the first rule that holds decides, in this order."""
    rows = blocks.join(merged, ["doc", "id"], "left")
    s = T.strip(F.col("text"))
    drawn = T.restore_runs(F.col("zh"), F.col("text"))
    verbatim = s.rlike(r"^[0-9\s.,\-–—°×/%≥≤<>+=()^\[\]]+$") | T.is_symbolic(F.col("text"))
    action = (F.when(T.starts_with_any(s, keep), "KEEP").when(T.starts_with_any(s, drop), "DROP")
              .when(F.col("zh") == "__DROP__", "DROP").when(F.coalesce(F.col("zh"), F.lit("")) == "", F.when(verbatim, "VERBATIM").otherwise("UNTRANSLATED"))
              .when(drawn.rlike("⟦N[0-9]"), "UNRESOLVED").otherwise("DRAW"))
    text = F.when(action == "DRAW", F.when(F.instr("text", "\n") > 0, drawn).otherwise(F.replace(drawn, F.lit("\n"), F.lit(" ")))).when(action == "VERBATIM", F.col("text"))
    return rows.select("doc", "id", action.alias("action"), text.alias("zh"))
