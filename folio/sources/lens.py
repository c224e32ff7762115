"""Driver tables seen as documents, pages and blocks.

A row of ``documents`` is a document, its lines are blocks and ``blocks_per_page`` lines make a
page, so that every window and fold is bounded by one document and none by a source.  Geometry
and fonts follow from the text's length alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS_PER_PAGE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(docs: DataFrame, per_page: int = BLOCKS_PER_PAGE) -> DataFrame:
    """``doc, page, ord, id, text`` and geometry: blank blocks dropped, hard spaces made plain."""
    raw = docs.where("text is not null").select(F.col("doc_id").alias("doc"), F.split(F.replace("text", F.lit("\u00a0"), F.lit(" ")), "\n", -1).alias("raw"))
    # pages first, then their few lines: no row carries a whole document
    page = F.transform(F.sequence(F.lit(0), F.floor((F.size("raw") - 1) / per_page).cast("int")), lambda p: F.struct(p.alias("p"), F.slice("raw", p * per_page + 1, F.lit(per_page)).alias("ls")))
    pages = raw.select("doc", F.explode(page).alias("x")).select("doc", "x.p", "x.ls")
    rows = pages.select("doc", "p", "ls", F.posexplode("ls").alias("i", "text")).where(F.col("text").rlike(r"[^ \t\r\f]"))
    # the block's number counts the kept blocks of its page
    nth = F.size(F.filter(F.slice("ls", F.lit(1), F.col("i")), lambda t: t.rlike(r"[^ \t\r\f]")))
    rows = rows.select("doc", (F.col("p") + 1).alias("page"), (F.col("p") * per_page + F.col("i")).alias("ord"), nth.alias("nth"), "text")
    n = F.length("text")
    return rows.select(
        "doc", "page", "ord", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("b"), F.col("nth").cast("string")).alias("id"), "text",
        (F.lit(50) + n % 40).cast("double").alias("x0"), (F.lit(40) + (F.col("ord") % per_page) * 170).cast("double").alias("y0"),
        (F.lit(50) + n % 40 + F.least(n * 5, F.lit(500))).cast("double").alias("x1"), (F.lit(52) + (F.col("ord") % per_page) * 170 + n % 9).cast("double").alias("y1"),
        (F.lit(7) + n % 6).cast("double").alias("size"), (n % 5 == 0).alias("bold"))


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "documents"))


#: The same view for the oracle: a list of common table expressions that defines ``blocks``.
BLOCKS_SQL = f"""
b0 as (select doc_id as doc, unnest(ls) as text, unnest(range(len(ls))) as ord
       from (select doc_id, string_split(replace(text, chr(160), ' '), chr(10)) as ls from documents where text is not null)),
b1 as (select doc, cast(ord // {BLOCKS_PER_PAGE} as int) + 1 as page, cast(ord as int) as ord, text from b0 where regexp_matches(text, '[^ \\t\\r\\f]')),
blocks as (select doc, page, ord, 'p' || page || 'b' || (row_number() over (partition by doc, page order by ord) - 1) as id, text,
  cast(50 + length(text) % 40 as double) as x0, cast(40 + (ord % {BLOCKS_PER_PAGE}) * 170 as double) as y0,
  cast(50 + length(text) % 40 + least(length(text) * 5, 500) as double) as x1, cast(52 + (ord % {BLOCKS_PER_PAGE}) * 170 + length(text) % 9 as double) as y1,
  cast(7 + length(text) % 6 as double) as size, length(text) % 5 = 0 as bold from b1)
"""
