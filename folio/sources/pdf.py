"""Plug-in boundary for PDF: parsers and renderers are functions that run in tasks.

A parser takes a file's name and bytes and yields the records of one kind (``RECORDS``); the
engine does the rest.  Files are read as binary rows, so a file is the unit of work and of
recovery; parsers that can open a file at any page read large files in ranges (``paged``).  No
PDF parser ships with the engine, and page images stay with the renderer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import columns, recurring

_BOX = "x0 double, y0 double, x1 double, y1 double"
SPANS = f"doc string, page int, block int, line int, ord int, {_BOX}, dx double, dy double, size double, flags int, color int, font string, text string"
#: What a parser may yield, by kind: text spans, table cells, fonts, page boxes, content streams, counts of drawings and images.
RECORDS = {
    "spans": SPANS,
    "cells": f"doc string, page int, table_no int, row_no int, cell_no int, {_BOX}, cols int",
    "fonts": "doc string, page int, ftype string, name string",
    "boxes": "doc string, page int, " + ", ".join(f"{k}_{c} double" for k in ("media", "crop") for c in ("x0", "y0", "x1", "y1")) + ", rotation int",
    "streams": "doc string, page int, text string",
    "marks": "doc string, page int, drawings int, images int, short_lines int",
}
Parser = Callable[[str, bytes], Iterable[tuple]]


def read_records(spark: SparkSession, path: str, kind: str, parser: Parser) -> DataFrame:
    """Records of one kind of every file under ``path``, parsed file by file in tasks."""
    names = [x.split()[0] for x in RECORDS[kind].split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p.path, p.content, strict=True):
                rows = [tuple(x.decode("latin-1") if isinstance(x, bytes) else x for x in r) for r in parser(name, bytes(data))]
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORDS[kind])


def read_spans(spark: SparkSession, path: str, parser: Parser) -> DataFrame:
    return read_records(spark, path, "spans", parser)


def tables_of(cells: DataFrame) -> DataFrame:
    """``doc, page, table_no, x0, x1, y1, cols`` of each table: what decides whether it goes on over the page."""
    return cells.groupBy("doc", "page", "table_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("cols").alias("cols"))


def spans_to_blocks(spans: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Blocks with ``id`` by kept order, text, envelope, modal size and colour, majority styles, alignment and rotation."""
    key = ["doc", "page", "block"]
    rows = spans.where("text <> ''")
    place = F.struct("line", "ord")
    line = rows.groupBy(*key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("text"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.min_by(F.struct("dx", "dy"), "ord").alias("dir"))
    line = line.where(T.strip(F.col("text")) != "")
    joined = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line", F.col(c).alias("v")))), lambda x: x["v"])
    block = line.groupBy(*key).agg(joined.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("nlines"), in_order("y0").alias("line_ys"), in_order("x0").alias("line_x0s"), in_order("dir").alias("dirs"))
    seen = rows.withColumn("seen", F.shiftleft(F.col("line").cast("long"), 32) + F.col("ord"))
    size = recurring.first_seen_mode(seen, key, "size", "seen").drop("n")
    color = recurring.first_seen_mode(seen, key, "color", "seen").drop("n")
    style = rows.groupBy(*key).agg(*[(F.count_if(F.col("flags").bitwiseAND(bit) > 0) * 2 > F.count(place)).alias(n) for n, bit in (("bold", 16), ("italic", 2))])
    out = block.join(size, key).join(color, key).join(style, key).join(columns.alignment(line, key, cfg), key)
    nth = F.row_number().over(Window.partitionBy("doc", "page").orderBy("block")) - 1
    return out.select("doc", "page", F.col("block").alias("ord"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("b"), nth.cast("string")).alias("id"), "text", "x0", "y0", "x1", "y1", "size", "bold", "italic", "color", "align", "nlines", "line_ys", "line_x0s", columns.rotation(F.col("dirs")).alias("rot"), T.is_kept(F.col("text"), cfg).alias("keep"))


def write_pages(ops: DataFrame, renderer: Callable[[tuple, pd.DataFrame], None]) -> DataFrame:
    """Hand each page's draw commands, in order, to a renderer; ``doc, page, n`` of what was drawn."""

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        renderer(key, page.sort_values(["r", "g", "b", "y", "x", "seq"]))
        return pd.DataFrame([(key[0], key[1], len(page))], columns=["doc", "page", "n"])

    kind = dict(ops.dtypes)["doc"]
    return ops.groupBy("doc", "page").applyInPandas(run, f"doc {kind}, page int, n long")
