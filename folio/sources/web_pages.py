"""A page parser for Parquet files of web pages: a row is a page, its HTML the content.

A page's number is its ``page_id`` and one, so rows may stand in any order and in any of a table's files;
without that column it is the place in the file.

Lines of the HTML are spans, one under the other; ``td`` and ``th`` are cells of their tables; classes
are fonts; the text is the content stream; tags are counted as marks.  It reads the row groups and
columns that a range of pages needs, so it also shows what a parser has to do for a large file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.parquet as pq

LINE, WIDTH = 12.0, 5.0
_TABLE, _ROW, _CELL = re.compile(r"<table[\s>].*?</table>", re.S), re.compile(r"<tr[\s>].*?(?=<tr[\s>]|</table>)", re.S), re.compile(r"<t[dh][\s>]")
_CLASS = re.compile(r'class="([^"]*)"')


def _spans(html: str) -> Iterator[dict]:
    for i, text in enumerate(html.split("\n")):
        y, n = LINE * i, len(text)
        yield {"block": i, "line": 0, "ord": 0, "x0": 50.0, "y0": y, "x1": 50.0 + WIDTH * n, "y1": y + 10.0, "dx": 1.0, "dy": 0.0, "size": 9.0, "flags": 0, "color": 0, "font": "html", "text": text}


def _cells(html: str) -> Iterator[dict]:
    for t, table in enumerate(_TABLE.findall(html)):
        rows = [len(_CELL.findall(r)) for r in _ROW.findall(table)]
        for r, n in enumerate(rows):
            for c in range(n):
                yield {"table_no": t, "row_no": r, "cell_no": c, "x0": 50.0 + 100 * c, "y0": LINE * r, "x1": 150.0 + 100 * c, "y1": LINE * (r + 1), "cols": max(rows)}


def _fonts(html: str) -> Iterator[dict]:
    yield from ({"ftype": "class", "name": n} for n in dict.fromkeys(_CLASS.findall(html)))


def _boxes(html: str) -> Iterator[dict]:
    high = LINE * (html.count("\n") + 1)
    yield {f"{k}_{c}": v for k in ("media", "crop") for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", high))} | {"rotation": 0}


def _streams(html: str) -> Iterator[dict]:
    yield {"text": html}


def _marks(html: str) -> Iterator[dict]:
    yield {"drawings": html.count("<div"), "images": html.count("<img"), "short_lines": sum(len(x) <= 12 for x in html.split("\n"))}


_KINDS = {"spans": _spans, "cells": _cells, "fonts": _fonts, "boxes": _boxes, "streams": _streams, "marks": _marks}


class WebPages:
    """``PageParser`` of Parquet files with a column ``html``; null pages have no records."""

    numbered = True

    def pages(self, file: BinaryIO) -> int:
        return pq.ParquetFile(file).metadata.num_rows

    def records(self, file: BinaryIO, kind: str, first: int, last: int, columns: list[str]) -> Iterator[dict]:
        table = pq.ParquetFile(file)
        read, place = [c for c in ("html", "page_id") if c in table.schema_arrow.names], 0
        for group in range(table.num_row_groups):
            n = table.metadata.row_group(group).num_rows
            if place + n < first or place >= last:
                place += n
                continue
            for batch in table.iter_batches(64, [group], read):
                ids = batch.column("page_id").to_pylist() if "page_id" in read else range(place, place + len(batch))
                for html, page_id in zip(batch.column("html").to_pylist(), ids, strict=True):
                    place += 1
                    if html is not None and page_id is not None and first <= place <= last:
                        yield from (r | {"page": page_id + 1} for r in _KINDS[kind](html))
