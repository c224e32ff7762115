"""Text nodes of HTML, tags untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the named entities that are decoded, the ampersand last
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_CUT = "\x01"


def unescape(c: Column) -> Column:
    for name, ch in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def text_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, ord, text`` of the text between tags, outside scripts, styles and comments; blank nodes are left out."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>", _CUT)
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", _CUT)
    nodes = F.filter(F.split(bare, _CUT, -1), lambda x: x.rlike(r"[^ \t\n\r\f]"))
    rows = pages.where(F.col(html).isNotNull()).select(key, F.posexplode(nodes).alias("ord", "x"))
    return rows.select(key, "ord", F.trim(F.regexp_replace(unescape(F.col("x")), r"[ \t\n\r\f]+", " ")).alias("text"))
