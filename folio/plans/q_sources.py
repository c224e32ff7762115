"""Queries that read a table's own file page by page, through the paged data source, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import paged

QUERIES: dict = {}
SQL: dict[str, str] = {}
PARSER = "folio.sources.web_pages:WebPages"
#: Bytes of a file for each task; small, so that the test tables have several.
PART_BYTES = 1 << 20


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir, kind, columns=None):
    return paged.read_pages(spark, f"{sf_dir}/pages.parquet", kind, PARSER, columns, PART_BYTES, doc="pages")


# the table is one document, in however many files; a row of it is a page, counted from 1
_PAGE = "pg as (select 'pages' as doc, cast(page_id + 1 as int) as page, html, string_split(html, chr(10)) as ls from pages where html is not null)"


@query(f"""with {_PAGE}, l as (select doc, page, unnest(ls) as text, unnest(range(len(ls))) as i from pg)
select doc, page, cast(i as int) as block, cast(12.0 * i as double) as y0, cast(50 + 5.0 * length(text) as double) as x1, text from l""")
def q_paged_spans(spark, sf_dir):
    return _read(spark, sf_dir, "spans", ["doc", "page", "block", "y0", "x1", "text"])


@query(f"""with {_PAGE}, f as (select page, count(distinct c) as n_fonts, array_to_string(list_sort(list(distinct c)), ',') as fonts from (select page, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) as c from pg) group by 1)
select doc, page, coalesce(n_fonts, 0) as n_fonts, coalesce(fonts, '') as fonts, cast(12.0 * len(ls) as double) as height, strlen(html) as stream_bytes, len(regexp_extract_all(html, '<div')) * 2 + len(regexp_extract_all(html, '<img')) * 3 + len(list_filter(ls, lambda x: length(x) <= 12)) as score from pg left join f using (page)""")
def q_paged_profile(spark, sf_dir):
    """Fonts, boxes, streams and marks of each page, from one source by kind."""
    key = ["doc", "page"]
    fonts = _read(spark, sf_dir, "fonts", [*key, "name"]).groupBy(*key).agg(F.count_distinct("name").alias("n_fonts"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("fonts"))
    boxes = _read(spark, sf_dir, "boxes", [*key, "media_y1"]).withColumnRenamed("media_y1", "height")
    streams = _read(spark, sf_dir, "streams").select(*key, F.octet_length("text").cast("long").alias("stream_bytes"))
    marks = _read(spark, sf_dir, "marks").select(*key, (F.col("drawings") * 2 + F.col("images") * 3 + F.col("short_lines")).cast("long").alias("score"))
    found = boxes.join(streams, key).join(marks, key).join(fonts, key, "left")
    return found.select(*key, F.coalesce("n_fonts", F.lit(0)).cast("long").alias("n_fonts"), F.coalesce("fonts", F.lit("")).alias("fonts"), "height", "stream_bytes", "score")
