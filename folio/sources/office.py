"""Text units of Office files with nothing but the standard library: ``path, part, ord, kind, style_key, text``.

Files are read as binary rows by Spark and parsed in tasks, one file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = "path string, part string, ord int, kind string, style_key string, text string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
Unit = tuple[str, int, str, str, str]


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: (re.sub(r"\d+", "", n), number(n)))


def _walk(node: ElementTree.Element, skip: Callable[[ElementTree.Element], bool]) -> Iterator[ElementTree.Element]:
    """A node and what is below it, in order, without skipped parts; of alternatives the fallback only where it is alone."""
    yield node
    alone = node.tag == f"{_M}AlternateContent" and node.find(f"{_M}Choice") is None
    for child in node:
        if not skip(child) and (alone or child.tag != f"{_M}Fallback"):
            yield from _walk(child, skip)


def _paragraph_runs(p: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The runs of a paragraph, also those in links, insertions and controls; deleted text and nested paragraphs are not its own."""
    skip = lambda x: x.tag in (f"{_W}p", f"{_W}del", f"{_W}moveFrom")
    for x in _walk(p, skip):
        if x.tag == f"{_W}r":
            yield x


def docx_units(data: bytes) -> Iterator[Unit]:
    """Runs of paragraphs, table cells, heads, feet and text boxes; the style key is the run's properties."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in _parts(z, r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml"):
            root, i = ElementTree.fromstring(z.read(part)), 0
            in_table = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
            in_box = {id(p) for t in root.iter(f"{_W}txbxContent") for p in t.iter(f"{_W}p")}
            kind = "header" if "header" in part else "footer" if "footer" in part else "note" if "notes" in part else ""
            for n, p in enumerate(x for x in _walk(root, lambda x: False) if x.tag == f"{_W}p"):
                for r in _paragraph_runs(p):
                    if text := "".join(t.text or "" for t in r.findall(f"{_W}t")):
                        style = r.find(f"{_W}rPr")
                        key = "" if style is None else ElementTree.tostring(style, encoding="unicode")
                        yield part, i, kind or ("cell" if id(p) in in_table else "box" if id(p) in in_box else "paragraph"), f"{n}|{key}", text
                        i += 1


def xlsx_units(data: bytes) -> Iterator[Unit]:
    """Text cells of all sheets; formulas, numbers and dates are left alone."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        for part in _parts(z, r"xl/worksheets/sheet\d+\.xml"):
            i = 0
            for c in ElementTree.fromstring(z.read(part)).iter(f"{_S}c"):
                if c.find(f"{_S}f") is not None:
                    continue
                kind, v = c.get("t"), c.find(f"{_S}v")
                text = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else None
                if text and not text.startswith("="):
                    yield part, i, "cell", c.get("r") or "", text
                    i += 1


def pptx_units(data: bytes) -> Iterator[Unit]:
    """Paragraphs of slides, notes and diagrams."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in _parts(z, r"ppt/(slides/slide|notesSlides/notesSlide|diagrams/data)\d+\.xml"):
            i, root = 0, ElementTree.fromstring(z.read(part))
            in_table = {id(p) for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
            for p in root.iter(f"{_A}p"):
                if text := "".join(t.text or "" for t in p.iter(f"{_A}t")):
                    yield part, i, "note" if "notes" in part else "diagram" if "diagrams" in part else "cell" if id(p) in in_table else "paragraph", "", text
                    i += 1


_READERS = {"docx": docx_units, "xlsx": xlsx_units, "pptx": pptx_units}


def office_units(files: DataFrame) -> DataFrame:
    """Units of ``files(path, content)``; other kinds of file give none, a damaged one a row of kind ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p.path, p.content, strict=True):
                reader = _READERS.get(path.rsplit(".", 1)[-1].lower())
                try:
                    rows += [(path, *u) for u in (reader(bytes(data)) if reader else ())]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
                    rows.append((path, "", 0, "error", "", str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "part", "ord", "kind", "style_key", "text"])

    return files.select("path", "content").mapInPandas(run, UNITS)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    return office_units(spark.read.format("binaryFile").load(path).select(F.col("path"), "content"))
