"""Geometry of lines: envelopes, alignment, row clusters, merged columns, pseudo-blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import Decimal
from math import inf
from operator import le

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from . import sweep


def envelopes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, x0, y0, x1, y1`` over non-blank lines."""
    rows = lines.where(T.strip(F.col("text")) != "")
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def alignment(lines: DataFrame, keys: list[str], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``keys, align``: ``c`` where the block is wide enough and every line's centre is near its own."""
    box = lines.groupBy(*keys).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"))
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("bx0") + F.col("bx1")) / 2)
    width = F.col("bx1") - F.col("bx0")
    rows = lines.join(box, keys).groupBy(*keys).agg(F.max(off).alias("off"), F.max(width).alias("width"))
    centred = (F.col("width") > cfg.centre_min_width) & (F.col("off") < cfg.centre_share * F.col("width"))
    return rows.select(*keys, F.when(centred, "c").otherwise("l").alias("align"))


def rotation(dirs: Column) -> Column:
    """90 or 270 from an array of line directions (dx, dy); null if all are horizontal.  The first of equally common ones decides."""
    turned = F.filter(dirs, lambda d: (d["dx"] != 1) | (d["dy"] != 0))
    kinds = F.array_distinct(turned)
    count = F.transform(kinds, lambda k: F.size(F.filter(turned, lambda d: d == k)))
    best = F.element_at(kinds, F.array_position(count, F.array_max(count)).cast("int"))
    return F.when(F.size(turned) > 0, F.when((best["dx"] == 0) & (best["dy"] == -1), 90).otherwise(270))


def first_fit(ys: list[float], tolerance: float = DEFAULT.row_tolerance) -> list[int]:
    """Row of each line top, in their order: the first seed near enough, else a new seed.

    Seeds lie more than the tolerance apart, so a sorted list finds the few that can be near.
    """
    if all(map(le, ys, ys[1:])):  # from top to bottom: only the last seed can be near
        out, seed, row = [], -inf, -1
        for y in ys:
            if not y - seed <= tolerance:
                seed, row = y, row + 1
            out.append(row)
        return out
    seeds: list[float] = []
    number: dict[float, int] = {}
    out = []
    for y in ys:
        at = bisect_left(seeds, y)
        near = [number[s] for s in seeds[max(0, at - 2) : at + 2] if abs(s - y) <= tolerance]
        if not near:
            seeds.insert(at, y)
            near = [number.setdefault(y, len(number))]
        out.append(min(near))
    return out


def row_clusters(lines: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, id, line_no, row`` for lines ``doc, id, line_no, y``: the row is the first seed within tolerance.

    The lines of one block are gathered; their rows are found in one pass over them.
    """
    tolerance = cfg.row_tolerance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [first_fit(ys, tolerance) for ys in b.column("ys").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("id"), b.column("ns"), pa.array(rows, pa.list_(pa.int32()))], names=["doc", "id", "ns", "rows"])

    kind = dict(lines.dtypes)
    per = lines.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("y").cast("double").alias("y")))).alias("ls"))
    found = per.select("doc", "id", F.col("ls.line_no").alias("ns"), F.col("ls.y").alias("ys")).mapInArrow(run, f"doc {kind['doc']}, id {kind['id']}, ns array<{kind['line_no']}>, rows array<int>")
    return found.select("doc", "id", F.explode(F.arrays_zip("ns", "rows")).alias("r")).select("doc", "id", F.col("r.ns").alias("line_no"), F.col("r.rows").alias("row"))


def gathered(lines: DataFrame) -> DataFrame:
    """``doc, id, ls``: the lines of each block as one array, in order; the only time that lines move."""
    fields = [c for c in ("line_no", "text", "x0", "x1", "y") if c in lines.columns]
    return lines.groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ls"))


def has_gap(ls: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Whether gathered lines ``line_no, x0, x1, y`` have a gap between neighbours of one row, as ``merged_columns`` finds it."""
    tolerance, gap = cfg.row_tolerance, cfg.column_gap

    def run(ns: pa.Array, x0s: pa.Array, x1s: pa.Array, ys: pa.Array) -> pa.Array:
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = ys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        tops = flat(ys).tolist()
        rows = np.array([r for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True) for r in first_fit(tops[a:z], tolerance)], np.int64)
        block, n, left, right = np.repeat(np.arange(len(sizes)), sizes), flat(ns), flat(x0s), flat(x1s)
        first = np.where(x0s.flatten().is_null().to_numpy(zero_copy_only=False), -inf, left)  # as Spark sorts nulls
        by = np.lexsort((n, first, rows, block))
        a, z = by[:-1], by[1:]
        hit = (block[a] == block[z]) & (rows[a] == rows[z]) & (left[z] - right[a] > gap)
        return pa.array(np.bincount(block[a[hit]], minlength=len(sizes)) > 0)

    return F.arrow_udf(run, "boolean")(ls["line_no"], ls["x0"], ls["x1"], ls["y"])


def merged_columns(lines: DataFrame, rows: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, id``: blocks with a gap between neighbours of one row."""
    w = Window.partitionBy("doc", "id", "row").orderBy("x0", "line_no")
    at = lines.join(rows, ["doc", "id", "line_no"]).withColumn("next", F.lead("x0").over(w))
    return at.where(F.col("next") - F.col("x1") > cfg.column_gap).select("doc", "id").distinct()


def pseudo_blocks(lines: DataFrame, merged: DataFrame, translations: DataFrame, rotated: DataFrame | None = None) -> DataFrame:
    """``doc, id, parent_id, line_no, text, zh``: each line of a column-merged block as a block of its own.

    Blocks stay whole unless they have two lines, are not rotated and their translation has as many lines.
    Holes take the whole block's numbers.
    """
    if rotated is not None:
        merged = merged.join(rotated.select("doc", "id"), ["doc", "id"], "left_anti")
    return split_gathered(gathered(lines.select("doc", "id", "line_no", "text")).join(merged.select("doc", "id"), ["doc", "id"], "left_semi").join(translations.select("doc", "id", "zh"), ["doc", "id"]))


def split_gathered(blocks: DataFrame) -> DataFrame:
    """``pseudo_blocks`` of blocks ``doc, id, ls, zh`` with gathered lines and their translation, each by itself."""
    parts = F.split("zh", "\n", -1)
    fit = blocks.where((F.size("ls") >= 2) & (F.col("zh") != "") & (F.size(parts) == F.size("ls")))
    # holes are filled once a block, in lines that are stripped already; none can hold a line break
    parent = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    whole = T.let(F.array_join(F.transform(parts, T.strip), "\n"), lambda w: T.restore_runs(w, parent, blank=True))
    rows = fit.select("doc", "id", "ls", F.split(whole, "\n", -1).alias("parts"))
    of_line = F.transform("ls", lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), F.element_at("parts", x["line_no"] + 1).alias("zh")))
    rows = rows.select("doc", "id", F.inline(of_line))
    return rows.select("doc", F.concat("id", F.lit("#"), F.col("line_no").cast("string")).alias("id"), F.col("id").alias("parent_id"), "line_no", "text", F.nullif("zh", F.lit("")).alias("zh"))


def split_blocks(blocks: DataFrame, pseudo: DataFrame) -> DataFrame:
    """``blocks`` with each block that ``pseudo`` names as a parent replaced by its lines, which keep the parent's other attributes."""
    kept = blocks.join(pseudo.select("doc", F.col("parent_id").alias("id")).distinct(), ["doc", "id"], "left_anti")
    lines = pseudo.select("doc", F.col("parent_id").alias("id"), F.col("id").alias("line_id"), "line_no", F.col("text").alias("line"))
    rows = blocks.join(lines, ["doc", "id"])
    at = lambda c, other: F.coalesce(F.try_element_at(c, F.col("line_no") + 1), other)
    y, x, w, h = at("line_ys", F.col("y0")), at("line_x0s", F.col("x0")), at("line_ws", F.col("x1") - F.col("x0")), at("line_hs", F.col("size") * 1.2)
    new = {"id": F.col("line_id"), "text": F.col("line"), "align": F.lit("l"), "nlines": F.lit(1), "x0": x, "y0": y, "x1": x + w, "y1": y + h, "line_ys": F.array(y), "line_x0s": F.array(x), "line_ws": F.array(w), "line_hs": F.array(h)}
    return kept.unionByName(rows.select(*[new[c].cast(k).alias(c) if c in new else F.col(c) for c, k in blocks.dtypes]))


def zipped_by_place(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages whose two block lists have equal length, joined by place: ``doc, page, ord`` and both texts."""
    count = lambda x, n: x.withColumn(n, F.count("*").over(Window.partitionBy("doc", "page")))
    left, right = count(a.select("doc", "page", "ord", F.col("text").alias("text_a")), "na"), count(b.select("doc", "page", "ord", F.col("text").alias("text_b")), "nb")
    return left.join(right, ["doc", "page", "ord"]).where("na = nb").select("doc", "page", "ord", "text_a", "text_b")


def line_pitch(lines: DataFrame) -> DataFrame:
    """``doc, id, line_no, pitch``: distance to the next line, else the line's height; also where the distance is too small for the font."""
    w = Window.partitionBy("doc", "id").orderBy("line_no")
    step = F.lead("y").over(w) - F.col("y")
    return lines.select("doc", "id", "line_no", F.when(step >= F.col("size") * 0.9, step).otherwise(F.col("h")).alias("pitch"))


def paragraph_like(widths: Column, width: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Three lines or more, most of which but the last nearly fill the block."""
    n = F.size(widths)
    full = F.size(F.filter(F.slice(widths, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda w: w > width * cfg.paragraph_line_share))
    # the share as it is written: 90 * 0.7 is 63, not a hair less
    share = F.lit(Decimal(str(cfg.paragraph_share)))
    return (n >= 3) & (full >= F.greatest(F.lit(1), F.floor((n - 1) * share)))


def cell_expand(blocks: DataFrame, cells: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, id, x0, x1``: single-line blocks inside a table cell take the first such cell's width."""
    s = cfg.cell_slack
    good = cells.where(f"x1 - x0 > {cfg.cell_min_width} and y1 - y0 > {cfg.cell_min_height}").select("doc", "page", "cell_no", *[F.col(c).alias("c" + c) for c in ("x0", "y0", "x1", "y1")])
    # a sweep brings a block's first corner together with the cells it is in: no page is a cross product
    corner = blocks.select("doc", "page", "id", *[F.col(c).alias(f"b{c}") for c in sweep.EDGES], "x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    boxes = good.select("doc", "page", "cell_no", "cx0", "cy0", "cx1", "cy1", *[(F.col(f"c{c}") + d).alias(c) for c, d in zip(sweep.EDGES, (-s, -s, s, s), strict=True)])
    met = sweep.meeting(corner, boxes)
    near = met.select("doc", F.col("a_id").alias("id"), *[F.col(f"a_b{c}").alias(c) for c in sweep.EDGES], "b_cell_no", *[F.col(f"b_c{c}").alias(f"c{c}") for c in sweep.EDGES]).withColumnRenamed("b_cell_no", "cell_no")
    near = near.where((F.col("x0") >= F.col("cx0") - s) & (F.col("x1") <= F.col("cx1") + s) & (F.col("y0") >= F.col("cy0") - s) & (F.col("y1") <= F.col("cy1") + s))
    first = near.groupBy("doc", "id").agg(F.min_by(F.struct("cx0", "cx1"), "cell_no").alias("c"), F.min("x1").alias("x1"), F.min("x0").alias("x0"))
    wider = (F.col("c.cx1") - 2 > F.col("x1") + 3) | (F.col("c.cx0") + 2 < F.col("x0") - 3)
    return first.select("doc", "id", F.when(wider, F.col("c.cx0") + 2).otherwise(F.col("x0")).alias("x0"), F.when(wider, F.col("c.cx1") - 2).otherwise(F.col("x1")).alias("x1"))
