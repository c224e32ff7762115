"""The paged data source: kinds, ranges, pruned columns and pushed filters."""

import io
from contextlib import redirect_stdout

import pytest

from folio.sources import jsonio, paged, pdf

PARSER = "page_parser:FeedPages"
PAGE = "spans|block=0|x1=60|y1=9|text=p{n}\nspans|block=1|text=second\ncells|table_no=1|cols=3\nfonts|name=Times|ftype=Type3\nboxes|media_x1=612|rotation=90\nstreams|text=q Q q\nmarks|drawings={n}|images=2"


@pytest.fixture
def folder(tmp_path):
    for doc, n in (("a", 10), ("b", 1), ("c", 3)):
        (tmp_path / f"{doc}.feed").write_text("\f".join(PAGE.format(n=i + 1) for i in range(n)))
    (tmp_path / "_note.feed").write_text("no data")
    (tmp_path / "empty.feed").write_text("")
    return tmp_path


def shown(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("kind", list(pdf.RECORDS))
@pytest.mark.parametrize("part_bytes", [100, 1 << 20])
def test_every_kind_in_ranges(spark, folder, kind, part_bytes):
    found = paged.read_pages(spark, str(folder), kind, PARSER, part_bytes=part_bytes)
    n = {"a": 10, "b": 1, "c": 3}
    want = sorted((d, i + 1) for d in n for i in range(n[d]) for _ in range(2 if kind == "spans" else 1))
    assert sorted((r.doc, r.page) for r in found.collect()) == want and found.schema.simpleString() == spark.createDataFrame([], pdf.RECORDS[kind]).schema.simpleString()
    if part_bytes == 100:
        assert found.rdd.getNumPartitions() > 20


def test_columns_are_pruned(spark, folder):
    found = paged.read_pages(spark, str(folder), "spans", PARSER, ["text", "page"])
    assert found.columns == ["page", "text"] and "ReadSchema: struct<page:int,text:string>" in shown(found)
    assert sorted(map(tuple, found.where("text <> 'second'").collect()))[:2] == [(1, "p1"), (1, "p1")]


def test_filters_are_pushed(spark, folder):
    """A page that cannot be read does no harm where a filter leaves it out; nor does a file that cannot be opened."""
    (folder / "bad.feed").write_text(PAGE.format(n=1) + "\f" + "broken" + "\f" + PAGE.format(n=3))
    every = paged.read_pages(spark, str(folder), "marks", PARSER, part_bytes=60, push_filters=True)
    with pytest.raises(Exception, match="cannot be read as marks"):
        every.collect()
    for condition, want in (("page < 2 and doc = 'bad'", [1]), ("page > 2 and page <= 9 and doc in ('bad', 'nothing')", [3]), ("page = 3 and doc = 'bad'", [3]), ("doc in ('b')", [1]), ("doc = 'x'", []), ("doc = 'a' and doc = 'b'", []), ("page > 8 and doc = 'a'", [9, 10]), ("doc = 'c' and drawings = 2", [2])):
        found = every.where(condition)
        assert sorted(r.page for r in found.collect()) == want, condition
    plan = shown(every.where("page >= 3 and doc = 'a'"))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(page,3)" in plan and "EqualTo(doc,a)" in plan


def test_a_frame_that_stands_in_a_plan_twice(spark, folder):
    """Its filters do not reach each other's scan, whether or not another frame has pushed filters."""
    every = paged.read_pages(spark, str(folder), "marks", PARSER)
    one, two = every.where("doc = 'a' and page = 1"), every.where("doc = 'a' and page = 2")
    assert sorted(r.page for r in one.unionByName(two).collect()) == [1, 2]
    assert every.unionByName(one).count() == 15 and one.select("doc").join(every, "doc").count() == 10


def test_ranges_and_names_as_arguments(spark, folder):
    (folder / "bad.feed").write_text(PAGE.format(n=1) + "\f" + "broken" + "\f" + PAGE.format(n=3))
    for docs, pages, want in ((["a"], (3, 5), [3, 4, 5]), (["bad"], (3, None), [3]), (["bad", "c"], (1, 1), [1, 1]), ([], None, []), (["x"], None, [])):
        found = paged.read_pages(spark, str(folder), "marks", PARSER, part_bytes=60, docs=docs, pages=pages)
        assert sorted(r.page for r in found.unionByName(found).collect()) == sorted(2 * want)


def test_patterns_and_extracts(spark, folder, tmp_path):
    assert paged.read_pages(spark, f"{folder}/[ab]*.feed", "boxes", PARSER).count() == 11
    found = paged.read_pages(spark, f"file://{folder}/a*.feed", "spans", PARSER, part_bytes=200)
    blocks = pdf.spans_to_blocks(found)
    assert blocks.count() == 20 and {r.id for r in blocks.where("page = 7").collect()} == {"p7b0", "p7b1"}
    jsonio.write_extracts(blocks, str(tmp_path / "x"))
    back = spark.read.schema(jsonio.EXTRACT).json(str(tmp_path / "x"))
    assert [r.ord for r in jsonio.flatten_extracts(back).orderBy("page", "id").collect()][:2] == [0, 1]


def test_places_of_blocks_without_one(spark):
    """Blocks without their own place are counted through the document, whatever the length of a page."""
    page = lambda p, n: f'{{"page":{p},"blocks":[' + ",".join(f'{{"id":"p{p}b{i}","text":"t"}}' for i in range(n)) + "]}"
    text = '{"doc":"d","pages":[' + ",".join(page(p, n) for p, n in ((1, 3), (2, 0), (3, 2))) + "]}"
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", jsonio.EXTRACT).alias("x")).select("x.*")
    assert [(r.page, r.ord, r.id) for r in jsonio.flatten_extracts(docs).orderBy("ord").collect()] == [(1, 0, "p1b0"), (1, 1, "p1b1"), (1, 2, "p1b2"), (3, 3, "p3b0"), (3, 4, "p3b1")]


def test_command(spark, folder, tmp_path):
    from folio.__main__ import main

    assert main(["extract", str(folder / "c.feed"), str(tmp_path / "out"), "--parser", PARSER]) == 0
    assert jsonio.read_extracts(spark, str(tmp_path / "out")).count() == 6


def test_a_table_in_many_files_is_one_document(spark, tmp_path):
    """Pages keep their own numbers, whatever file they are in and in whatever order; SQL sees the same."""
    import duckdb

    from folio.plans import q_sources

    pages = spark.createDataFrame([(i, "u", None if i == 4 else f'<div class="c{i % 3}">\n{i}</div>') for i in (7, 3, 0, 4, 9, 1, 8, 2, 5, 6)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("q_paged_spans", "q_paged_profile"):
        found = q_sources.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(found.columns)} from ({q_sources.SQL[name]})").fetchall()
        assert sorted(map(tuple, found.collect())) == sorted(want) and want
    read = lambda **more: sorted(r.page for r in paged.read_pages(spark, f"{tmp_path}/pages.parquet", "marks", q_sources.PARSER, doc="pages", **more).collect())
    assert read(pages=(3, 6)) == [3, 4, 6] and read(docs=["pages"]) == [1, 2, 3, 4, 6, 7, 8, 9, 10] and read(docs=["x"]) == []
    with pytest.raises(Exception, match="does not number pages"):
        paged.read_pages(spark, f"{tmp_path}/pages.parquet", "marks", PARSER, doc="pages").collect()
