"""HTML as a stream of tokens, by a table function.

A page is cut into tags, comments, CDATA sections, declarations and text; the pieces follow each
other without a gap, so put together they are the page again.  A ``>`` inside a quoted attribute ends
no tag; the content of scripts and styles is raw, whatever stands in it; what is never closed goes to
the end.  Offsets are code points, end exclusive.  Texts are decoded by ``html.ENTITIES``.

Defined cases: null gives no rows, an empty page none; a lone ``<`` is text; a tag with an unclosed
quote ends at the next ``>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .html import ENTITIES

KINDS = ("text", "tag", "comment", "cdata", "declaration", "raw")
_PIECE = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<cdata><!\[CDATA\[.*?(?:\]\]>|\Z))|(?P<declaration><[!?][^>]*+>?)"
    r"""|(?P<tag></?[A-Za-z](?:[^>"']|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^>]*+>?)|(?P<text>(?:[^<]|<(?![A-Za-z!?/])|</(?![A-Za-z]))++)""", re.S)
_RAW = {"script": re.compile(r"</script\b", re.I), "style": re.compile(r"</style\b", re.I)}
_NAME = re.compile(r"<([A-Za-z]+)")
_SCHEMA = StructType([StructField(c, IntegerType() if c in ("ord", "start", "end") else StringType()) for c in ("ord", "kind", "start", "end", "source", "text")])


def pieces(page: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of a page, in order and without gaps."""
    at = 0
    while at < len(page):
        m = _PIECE.match(page, at)
        kind, end = (m.lastgroup, m.end()) if m else ("text", at + 1)
        yield kind, at, end
        at = end
        name = _NAME.match(m[0]) if kind == "tag" else None
        if name and (close := _RAW.get(name[1].lower())) and not m[0].endswith("/>"):
            stop = found.start() if (found := close.search(page, at)) else len(page)
            if stop > at:
                yield "raw", at, stop
            at = stop


def decoded(text: str) -> str:
    for name, ch in ENTITIES:
        text = text.replace(name, ch)
    return text


@udtf
class HtmlTokens:
    """``ord, kind, start, end, source, text`` of a page; ``text`` (decoded) of text and CDATA alone."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        if page.dataType.simpleString() not in ("string", "void"):
            raise ValueError(f"a page is a string, not {page.dataType.simpleString()}")
        return AnalyzeResult(_SCHEMA)

    def eval(self, page: str | None) -> Iterator[tuple]:
        for i, (kind, a, z) in enumerate(pieces(page or "")):
            own = page[a:z]
            text = decoded(own) if kind == "text" else own.removeprefix("<![CDATA[").removesuffix("]]>") if kind == "cdata" else None
            yield i, kind, a, z, own, text


def register(spark: SparkSession, name: str = "html_tokens") -> None:
    """Make the function known to SQL: ``select ... from pages, lateral html_tokens(html)``."""
    spark.udtf.register(name, HtmlTokens)


def html_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, ord, kind, start, end, source, text`` of every page."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("page"))
    found = rows.lateralJoin(HtmlTokens(F.col("page").outer()))
    return found.select(F.col("key").alias(key), *_SCHEMA.names)
