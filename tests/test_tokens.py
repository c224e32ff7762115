"""Tokens of HTML: what they are, and that they are the whole page."""

import random

import pytest

from folio.sources import tokens


@pytest.mark.parametrize(("page", "kinds", "texts"), [
    ('<a title="x > y">b</a>', "tag text tag", ["b"]), ("<p>1 < 2 &amp;&lt; 3</p>", "tag text tag", ["1 < 2 &< 3"]), ("<!-- <b> -- > -->x", "comment text", ["x"]), ("<![CDATA[a <b> ]] c]]>d", "cdata text", ["a <b> ]] c", "d"]),
    ("<script>if (a<b) '</p>'</SCRIPT >t", "tag raw tag text", ["t"]), ("<script/>t", "tag text", ["t"]), ("<style></style>", "tag tag", []), ("<!DOCTYPE html><?xml?>x", "declaration declaration text", ["x"]),
    ("a <", "text", ["a <"]), ("</ p> x", "text", ["</ p> x"]), ('<a href="open>b</a> c', "tag text tag text", ["b", " c"]), ("<!-- open <b>", "comment", []), ("<script>x", "tag raw", []), ("<a", "tag", []), ("", "", []),
])
def test_pieces(page, kinds, texts):
    found = list(tokens.pieces(page))
    assert " ".join(k for k, _, _ in found) == kinds and "".join(page[a:z] for _, a, z in found) == page
    out = [tokens.decoded(page[a:z]) if k == "text" else page[a + 9 : z - 3] for k, a, z in found if k in ("text", "cdata")]
    assert out == texts


@pytest.mark.parametrize("seed", range(3))
def test_every_page_is_its_pieces(seed):
    rng = random.Random(seed)
    for _ in range(300):
        page = "".join(rng.choices(["<", ">", "</", "a", "script", "style", " ", '"', "'", "!--", "-->", "![CDATA[", "]]>", "?", "/>", "é", "&amp;", "\n"], k=30))
        found = list(tokens.pieces(page))
        assert "".join(page[a:z] for _, a, z in found) == page and all(a < z for _, a, z in found)


def test_table_function(spark):
    rows = spark.createDataFrame([(1, '<p class="a>b">x &gt; y</p>', 5, "k"), (2, None, 6, "k"), (3, "", 7, "k"), (4, "é<b>", 8, "k")], "page_id int, html string, ord int, kind string")
    got = [(r.page_id, r.ord, r.kind, r.start, r.end, r.text) for r in tokens.html_tokens(rows, "page_id", "html").orderBy("page_id", "ord").collect()]
    assert got == [(1, 0, "tag", 0, 15, None), (1, 1, "text", 15, 23, "x > y"), (1, 2, "tag", 23, 27, None), (4, 0, "text", 0, 1, "é"), (4, 1, "tag", 1, 4, None)]
    tokens.register(spark)
    rows.createOrReplaceTempView("some_pages")
    assert spark.sql("select page_id, t.kind from some_pages, lateral html_tokens(html) t where t.kind = 'text'").count() == 2
    with pytest.raises(Exception, match="a page is a string"):
        spark.sql("select * from some_pages, lateral html_tokens(page_id)").collect()
