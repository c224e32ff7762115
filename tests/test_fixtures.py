"""Hand-derived cases for single operators."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.config import DEFAULT
from folio.functions import text as T
from folio.operators import canonical, chunking, columns, layout, overlay, profile, qa, recurring, terms, validate
from folio.sources import jsonio, markdown, office, pdf
from folio.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("Page 12", "Page "), ("a" * 70, "a" * 60), ("a b1", "a b")])
def test_norm_key(spark, text, want):
    assert one(spark, T.norm_key(F.lit(text))) == want


@pytest.mark.parametrize(("text", "parity", "want"), [
    ("Scope ..... 12", False, "Scope ⟦P12⟧"), ("Scope       12", False, "Scope ⟦P12⟧"), ("Scope ........ 12", False, "Scope ⟦P12⟧"), ("Scope ........ 12", True, "Scope ... ⟦P12⟧"),
    ("........ 7", False, "⟦P7⟧"), ("v 1.2", False, "v 1.2"), ("a\nB ....... 3", False, "a\nB ⟦P3⟧")])
def test_toc(spark, text, parity, want):
    assert one(spark, T.toc_mark(F.lit(text), parity)) == want


def test_number_runs(spark):
    text = F.lit("a1b22c333")
    assert one(spark, T.number_runs(text)) == "a⟦N0⟧b⟦N1⟧c⟦N2⟧"
    assert one(spark, T.number_runs(text, F.array(F.lit(1)))) == "a1b⟦N1⟧c333"
    assert one(spark, T.signature(T.number_runs(text))) == "a#b#c#"
    assert one(spark, T.restore_runs(T.number_runs(text), text)) == "a1b22c333"
    zh, src = F.lit("第⟦N1⟧册 ⟦N0⟧ ⟦N9⟧"), F.lit("a12 b34")
    assert one(spark, T.restore_runs(zh, src)) == "第34册 12 ⟦N9⟧"
    assert one(spark, T.restore_runs(zh, src, blank=True)) == "第34册 12 "


@pytest.mark.parametrize(("text", "v1", "v2"), [("(12.5 ≥ x)", True, True), ("Table", False, False), ("表 1", False, False), (" ", False, False), ("zzzz", False, True), ("ÅÅÅÅ", True, True), (None, False, False)])
def test_symbolic(spark, text, v1, v2):
    c = F.lit(text).cast("string")
    assert one(spark, T.is_symbolic(c)) == v1
    assert one(spark, T.is_symbolic(c, runs=True)) == v2


def test_rule_with_mark_fires(spark):
    assert one(spark, T.replace_words(F.lit("see Fig. 3"), {"Fig.": "Abb."})) == "see Abb. 3"


def test_colour_and_crop(spark):
    c = one(spark, T.rgb(F.lit(0xFF8000)))
    assert (c.r, round(c.g, 6), c.b) == (1.0, round(128 / 255, 6), 0.0)
    assert one(spark, T.crop_spec(F.lit("3:x"))) is None
    px = one(spark, qa.crop_pixels(F.lit("3:-5,0,72,9999"), F.lit(144), F.lit(100), F.lit(200)))
    assert tuple(px) == (0, 0, 100, 200)


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, ord int, id string, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")


def test_varying_and_arity(spark):
    rows = blocks(spark, [("d", i, i, f"p{i}b0", f"Page {i} of 9", 9.0, False, 0.0, 0.0, 1.0, 1.0) for i in (1, 2, 3)] + [("e", i, i, f"p{i}b0", t, 9.0, False, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(("1-2", "1-", "3-4"))])
    assert [(r.doc, r.pos) for r in recurring.varying_digits(rows).where("doc = 'd'").collect()] == [("d", 0)]
    assert [r.doc for r in recurring.templates(rows).collect()] == ["d"]


def test_mode_and_majority(spark):
    rows = spark.createDataFrame([("k", v, i) for i, v in enumerate("baab")], "k string, v string, o int")
    assert recurring.first_seen_mode(rows, ["k"], "v", "o").first()["v"] == "b"
    assert not recurring.majority(rows.withColumn("f", F.col("v") == "a"), ["k"], "f").first()["f"]


def test_fold(spark):
    pages = spark.createDataFrame([("d", i + 1, c) for i, c in enumerate((10, 5, 9, 3, 30, 1, 20))], "doc string, page int, chars long")
    safe = spark.createDataFrame([("d", p, p in (3, 6, 7)) for p in range(2, 8)], "doc string, page int, safe boolean")
    from dataclasses import replace

    got = chunking.chunks(pages, safe, replace(DEFAULT, chunk_target=14, chunk_hard=21)).orderBy("page").collect()
    assert [(r.page, r.chunk, r.forced) for r in got] == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 2, False), (5, 2, True), (6, 3, False), (7, 3, True)]


def test_fold_covers_all_pages_once(spark):
    pages = spark.range(400).select((F.col("id") % 7).alias("doc"), (F.col("id") / 7).cast("int").alias("page"), (F.xxhash64("id") % 9000 + 9000).alias("chars"))
    rows = chunking.chunks(pages, pages.select("doc", "page", (F.col("chars") % 3 == 0).alias("safe"))).cache()
    assert rows.count() == rows.select("doc", "page").distinct().count() == 400
    size = rows.join(pages, ["doc", "page"]).groupBy("doc", "chunk").agg(F.sum("chars").alias("c"), F.max("forced").alias("f"), F.min("page").alias("a"), F.max("page").alias("z"), F.count("*").alias("n"))
    last = size.groupBy("doc").agg(F.max("chunk").alias("last"))
    assert size.join(last, "doc").where("chunk < last and c < 14000 and not f").count() == 0
    assert size.where("z - a + 1 <> n").count() == 0


@pytest.mark.parametrize(("prev", "width", "bold", "size", "cont", "safe"), [
    ("It ends.", 300.0, False, 10.0, False, True), ("ends with", 300.0, False, 10.0, False, False), ("ends with", 200.0, False, 10.0, False, True), ("ends with", 300.0, True, 12.0, False, True), ("It ends.", 300.0, False, 10.0, True, False)])
def test_boundary(spark, prev, width, bold, size, cont, safe):
    rows = blocks(spark, [("d", 1, 0, "p1b0", prev, 10.0, False, 0.0, 0.0, width, 9.0), ("d", 2, 1, "p2b0", "goes on here", size, bold, 0.0, 0.0, 300.0, 9.0)])
    more = spark.createDataFrame([("d", 2)] * cont, "doc string, page int")
    assert [r.safe for r in chunking.safe_boundary(rows, more).collect()] == [safe]


@pytest.mark.parametrize(("bottom", "cols", "want"), [(700.0, 4, [2]), (650.0, 4, []), (700.0, 5, [])])
def test_table_continuation(spark, bottom, cols, want):
    rows = spark.createDataFrame([("d", 1, 0, 50.0, 550.0, bottom, 4), ("d", 2, 0, 50.0, 550.0, 300.0, cols)], "doc string, page int, table_no int, x0 double, x1 double, y1 double, cols int")
    assert [r.page for r in chunking.table_continuation(rows).collect()] == want


def test_title(spark):
    chunks = spark.createDataFrame([("d", p, p, False) for p in (1, 4, 5)], "doc string, page int, chunk long, forced boolean")
    heads = spark.createDataFrame([("d", 1, 0, "one"), ("d", 4, 9, "four")], "doc string, page int, ord int, title string")
    assert [r.title for r in chunking.titles(chunks, heads).orderBy("chunk").collect()] == [DEFAULT.default_title, "one", "four"]


def test_layers_and_overrides(spark):
    rows = spark.createDataFrame([("d", "x", "A", 0), ("d", "x", "B", 1), ("d", "x", "", 1), ("d", "y", None, 1), ("d", "x", "C", 3)], "doc string, id string, zh string, priority int")
    merged = overlay.merge_layers(rows)
    assert [(r.id, r.zh) for r in merged.collect()] == [("x", "C")]
    base = spark.createDataFrame([("d", "x", "foo "), ("d", "e", "")], "doc string, id string, zh string")
    over = spark.createDataFrame([("d", "x", None, "bar"), ("d", "y", None, "bar"), ("d", "e", None, "q")], "doc string, id string, set_to string, append string")
    assert sorted((r.id, r.zh) for r in overlay.apply_overrides(base, over).collect()) == [("e", "q"), ("x", "foobar")]


def test_line_shift(spark):
    got = one(spark, overlay.shift_lines(F.array(F.lit(10.0), F.lit(20.0)), F.array(F.lit(0.0), F.lit(-10.0)), F.lit(8.0), F.lit(30.0)))
    assert (got.ys, got.y0, got.y1) == ([10.0, 10.0], -2.0, 30.0)


def test_seeds_are_not_transitive():
    assert columns.first_fit([10, 12, 14, 10.5, 16.4]) == [0, 0, 1, 0, 1]
    rng = random.Random(2)
    for _ in range(50):
        ys, seeds, want = [rng.choice([rng.uniform(0, 60), rng.randint(0, 24) * 2.5]) for _ in range(80)], [], []
        for y in ys:
            near = [i for i, s in enumerate(seeds) if abs(s - y) <= 2.5]
            if not near:
                near = [len(seeds)]
                seeds.append(y)
            want.append(near[0])
        assert columns.first_fit(ys) == want


@pytest.mark.parametrize(("x", "want"), [(52.5, 1), (51.5, 0)])
def test_column_gap(spark, x, want):
    rows = spark.createDataFrame([("d", "b", 0, "l", 10.0, 50.0, 5.0), ("d", "b", 1, "r", x, 90.0, 5.0)], "doc string, id string, line_no int, text string, x0 double, x1 double, y double")
    assert columns.merged_columns(rows, columns.row_clusters(rows)).count() == want


def test_rotation(spark):
    d = lambda x, y: F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"))
    assert one(spark, columns.rotation(F.array(d(1, 0)))) is None
    assert one(spark, columns.rotation(F.array(d(0, -1), d(1, 0)))) == 90
    assert one(spark, columns.rotation(F.array(d(0, 1), d(0, -1)))) == 270


@pytest.mark.parametrize(("src", "zh", "flag", "want"), [
    ("⟦N0⟧ ⟦P1⟧", "⟦P1⟧ ⟦N0⟧", "bad_placeholder", False), ("⟦N0⟧ ⟦P1⟧", "⟦N0⟧", "bad_placeholder", True), ("⟦N0⟧ ⟦P1⟧", "⟦N0⟧ ⟦N0⟧ ⟦P1⟧", "bad_placeholder", True),
    ("word " * 20, "x" * 11, "truncated", True), ("word " * 20, "x" * 12, "truncated", False), ("word " * 20, "", "truncated", False), ("a", "b\\n", "escape", True), ("a\\n", "b\\n", "escape", False)])
def test_translation_flags(spark, src, zh, flag, want):
    row = spark.createDataFrame([(src, zh)], "text string, zh string")
    assert row.select(validate.flags()[flag].alias("v")).first()["v"] == want


def test_no_files_do_not_pass(spark):
    none = spark.createDataFrame([], "doc string, chunk long, id string, text string")
    extra = spark.createDataFrame([("d", 1, "a", "x")], "doc string, chunk long, id string, zh string")
    assert [r.passed for r in validate.report(none, extra).collect()] == [False]


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string")


def test_overflow_overlap_tiny(spark):
    rows = spans(spark, [("d", 1, 0, 500.0, 0.0, 570.0, 5.0, 9.0, "a"), ("d", 1, 1, 576.0, 90.0, 600.0, 95.0, 9.0, "b")])
    assert [r.ord for r in qa.overflow(rows).collect()] == [0]
    for box, text, want in (((7.0, 7.0), "标题", 1), ((8.0, 8.0), "标题", 0), ((7.0, 7.0), "正文", 0), ((7.0, 7.0), "ab", 0)):
        rows = spans(spark, [("d", 1, 0, 0.0, 0.0, 10.0, 10.0, 9.0, "正文"), ("d", 1, 1, *box, 20.0, 60.0, 9.0, text)])
        assert qa.overprint(rows).count() == want
    rows = spans(spark, [("d", 1, i, 0.0, 0.0, 9.0, 9.0, 4.4, t) for i, t in enumerate(("中文", "中", "ab"))])
    assert [r.ord for r in qa.tiny(rows).collect()] == [0]


@pytest.mark.parametrize(("missing", "passed"), [(1, True), (2, False)])
def test_coverage_gate(spark, missing, passed):
    cells = spark.range(20).select(F.lit("d").alias("doc"), F.lit(1).alias("page"), F.col("id").cast("int").alias("cell_no"), F.lit(0.0).alias("x0"), (F.col("id") * 30.0).alias("y0"), F.lit(50.0).alias("x1"), (F.col("id") * 30.0 + 9).alias("y1"))
    at = cells.select("doc", "page", F.col("cell_no").alias("ord"), "x0", "y0", "x1", "y1")
    src = at.withColumn("text", F.lit("two words"))
    out = at.withColumn("text", F.when(F.col("ord") < missing, "two words").otherwise("两词"))
    r = qa.cell_coverage(cells, src, out).first()
    assert (r.n_missing, r.passed) == (missing, passed)


@pytest.mark.parametrize(("n", "text", "hit"), [(8, "visit www.x.com", True), (7, "visit www.x.com", False), (8, "visit us soon", False)])
def test_watermark_gate(spark, n, text, hit):
    rows = spark.createDataFrame([("d", p, p, text if p <= n else f"body of page {'x' * p}") for p in range(1, 101)], "doc string, page int, ord int, text string")
    assert (profile.watermarks(rows).count() > 0) == hit


@pytest.mark.parametrize(("empty", "verdict"), [(6, "scanned"), (5, "mixed"), (0, "native")])
def test_text_layer(spark, empty, verdict):
    rows = spark.createDataFrame([("d", p, 0 if p <= empty else 99) for p in range(1, 11)], "doc string, page int, chars long")
    assert profile.text_layer(rows).first()["verdict"] == verdict


def test_page_pick(spark):
    rows = spark.createDataFrame([("d", 10, 9), ("d", 11, 8), ("d", 12, 7), ("d", 13, 6), ("d", 20, 0)], "doc string, page int, score long")
    assert [r.page for r in qa.page_pick(rows, 3).orderBy("pick").collect()] == [10, 13]


def test_render_actions(spark):
    cases = [("This copy", None, "KEEP"), ("Draft 1", "x", "DROP"), ("text here", "译", "DRAW"), ("12.5", None, "VERBATIM"), ("text here", None, "UNTRANSLATED"), ("text here", "__DROP__", "DROP"), ("text here", "a⟦N9⟧", "UNRESOLVED")]
    rows = blocks(spark, [("d", 1, i, f"b{i}", t, 9.0, False, 0.0, 0.0, 1.0, 1.0) for i, (t, _, _) in enumerate(cases)])
    zh = spark.createDataFrame([("d", f"b{i}", z) for i, (_, z, _) in enumerate(cases) if z], "doc string, id string, zh string")
    got = {r.id: r.action for r in overlay.render_action(rows, zh, ("This copy",), ("Draft",)).collect()}
    assert got == {f"b{i}": a for i, (_, _, a) in enumerate(cases)}


def test_baseline_and_drift(spark):
    kind = "doc string, page int, x1 double"
    found = spark.createDataFrame([("d", 3, 581.0)], kind)
    assert qa.baseline_diff(found, spark.createDataFrame([("d", 3, 575.0)], kind)).count() == 0
    assert qa.baseline_diff(found, spark.createDataFrame([("d", 3, 560.0)], kind)).count() == 1
    rows = spark.createDataFrame([("d", "a", "验船师"), ("d", "b", "验船")], "doc string, id string, text string")
    assert [r.id for r in terms.drift(rows, {"验船": ("验船师",)}).collect()] == ["b"]


def test_acronyms(spark):
    rows = spark.createDataFrame([("d", 1, 0, "The MDMT and PWHT2 of Ab")], "doc string, page int, ord int, text string")
    assert sorted(r.acronym for r in terms.acronyms(rows).collect()) == ["MDMT", "PWHT2"]


def test_canonical_order(spark):
    rows = spark.createDataFrame([("d", "Nicht.", "Nicht.", "Nicht.", "Nicht.", 3, 0), ("d", "", "12", "⟦N0⟧", "#", 3, 1), ("d", "Zz", "Zz here", "Zz here", "Zz here", 3, 2)], "doc string, norm_key string, text string, template string, sig string, n long, seen long")
    got = {r.norm_key: (r.rule, r.zh) for r in canonical.resolve(rows).collect()}
    assert got == {"Nicht.": ("skip", None), "": ("signature", "⟦N0⟧"), "Zz": ("missing", None)}


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_units(spark):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = archive({"xl/sharedStrings.xml": f"<sst {s}><si><t>Total</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1"><f>SUM(A1)</f><v>3</v></c><c r="A2" t="s"><v>0</v></c><c r="A3"><v>12</v></c></row></sheetData></worksheet>'})
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/header1.xml": f"<w:hdr {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>"})
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    pptx = archive({"ppt/slides/slide1.xml": f"<sld {a}><a:p><a:r><a:t>Slide</a:t></a:r></a:p></sld>", "ppt/notesSlides/notesSlide1.xml": f"<n {a}><a:p><a:r><a:t>Note</a:t></a:r></a:p></n>"})
    files = spark.createDataFrame([("a.xlsx", bytearray(xlsx)), ("b.docx", bytearray(docx)), ("c.pptx", bytearray(pptx)), ("d.docx", bytearray(b"no")), ("e.txt", bytearray(b"x"))], "path string, content binary")
    got = sorted((r.path, r.kind, r.text if r.kind != "error" else "") for r in office.office_units(files).collect())
    assert got == [("a.xlsx", "cell", "Total"), ("b.docx", "cell", "Cell"), ("b.docx", "header", "Head"), ("b.docx", "paragraph", "One"), ("c.pptx", "note", "Note"), ("c.pptx", "paragraph", "Slide"), ("d.docx", "error", "")]


def test_markdown_round_trip(spark):
    rows = spark.createDataFrame([("d", "Use `x = 1` at https://a.b/c\n```\nno\n```\n")], "doc string, md string")
    r = markdown.segments(rows, "doc", "md").withColumn("back", markdown.unmasked(F.col("text"), F.col("kept"))).collect()
    assert [(x.text, x.back) for x in r] == [("Use ⟦K0⟧ at ⟦K1⟧", "Use `x = 1` at https://a.b/c")]


def test_pdf_plug_in(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"Hello|World")

    def parser(path, data):
        for i, word in enumerate(data.decode().split("|")):
            yield ("a", 1, 0, i, 0, 10.0, 10.0 * i, 60.0, 10.0 * i + 9, 1.0, 0.0, 9.0, 16, 0, "F", word)

    r = pdf.spans_to_blocks(pdf.read_spans(spark, str(tmp_path), parser)).first()
    assert (r.id, r.text, r.bold, r.nlines, r.align, r.rot) == ("p1b0", "Hello\nWorld", True, 2, "c", None)


def test_translation_files(spark, tmp_path):
    (tmp_path / "a_b_c01.json").write_text('{"p1b0": "x", "p1b1": null}')
    (tmp_path / "a_b_c02.json").write_text("{broken")
    (tmp_path / "a_b_cZZ.json").write_text('{"p1b0#1": "z"}')
    rows = sorted((r.doc, r.chunk, r.bad, r.id or "", r.zh or "") for r in jsonio.read_translations(spark, f"{tmp_path}/*.json").collect())
    assert rows == [("a_b", 1, False, "p1b0", "x"), ("a_b", 1, False, "p1b1", ""), ("a_b", 2, True, "", "")]
    assert [r.id for r in jsonio.read_translations(spark, f"{tmp_path}/*.json", pseudo=True).collect()] == ["p1b0#1"]
    assert jsonio.read_config(str(tmp_path / "none.json")) == {}


def test_fix_registry(spark):
    t = jsonio.fix_tables(spark, {"d": {"trans_overrides": {"a": "x", "b": {"append": "y"}}, "drop_ids": ["c"], "drop_prefixes": ["p", "q"], "line_splits": {"e": {"line": 0, "new_id": "n"}}, "lys_shift": {"f": [1, 2]}}})
    assert {k: v.count() for k, v in t.items()} == {"overrides": 2, "splits": 1, "drops": 1, "prefixes": 2, "shifts": 1}


def test_layout_metric_is_one(spark):
    text = "中文 Mixed Wm il."
    assert round(one(spark, layout.text_width_sql(F.lit(text), F.lit(10.0))), 6) == round(layout.text_width(text, 10.0), 6)
    lines = layout.wrapped("一二三四五。六七八", 10.0, 50.0)
    assert lines == ["一二三四五。", "六七八"]
    fit = layout.fitted("word " * 60, layout.Box(0, 0, 100, 60, 10.0, nlines=3))
    assert fit.size >= max(4.6, 5.5) and all(layout.text_width(x, fit.size) <= 100.0 for x in fit.lines)


def test_single_line_floors():
    text = "a short label"
    wide = layout.text_width(text, 1.0)
    cell = layout.fitted(text, layout.Box(0, 0, 5.0 * wide + 2.4, 12, 9.0))
    assert cell.lines == [text] and 4.2 <= cell.size <= 5.0
    broad = layout.fitted("x" * 59 + " y", layout.Box(0, 0, 310, 40, 20.0))
    assert len(broad.lines) > 1  # a wide block does not shrink below 78 percent to stay on one line


def test_placement_modes():
    two = layout.Box(10, 0, 200, 30, 10.0, nlines=2, ys=(0.0, 15.0), xs=(10.0, 60.0), widths=(50.0, 50.0), heights=(12.0, 12.0))
    assert [round(x, 1) for x, _, _, _ in layout.place("a\nb", two)] == [11.2, 61.2]
    close = layout.Box(10, 0, 200, 30, 10.0, nlines=2, ys=(0.0, 2.0), xs=(10.0, 60.0), widths=(50.0, 50.0), heights=(12.0, 12.0))
    assert layout.place("a\nb", close)[0][1] == pytest.approx(0 + (12 - 10) / 2 + layout.ASCENT * 10)  # not lifted by the small pitch
    table = layout.Box(10, 0, 200, 100, 10.0, nlines=5, ys=(0.0, 20.0, 40.0, 60.0, 80.0), xs=(30.0, 30.0, 10.0, 30.0, 30.0), widths=(40.0,) * 5, heights=(12.0,) * 5)
    spread = layout.place("a\nb", table)
    assert spread[1][1] - spread[0][1] == pytest.approx(24.0) and spread[0][0] == pytest.approx(31.2)
    right = layout.Box(10, 0, 200, 30, 10.0, align="r")
    (x, _, t, fs), = layout.place("end", right)
    assert x + layout.text_width(t, fs) == pytest.approx(200 - layout.PAD)


def test_contents_lines():
    box = layout.Box(0, 0, 200, 20, 10.0)
    title, dots, number = layout.place_contents("范围 ⟦P12⟧", box)
    assert title[2] == "范围" and number[2] == "12" and set(dots[2]) == {"."}
    assert number[0] + layout.text_width("12", 10.0) == pytest.approx(200)
    assert title[0] + layout.text_width("范围", 10.0) < dots[0] and dots[0] + layout.text_width(dots[2], 10.0) <= number[0] - 2


@pytest.mark.parametrize("rot", [90, 270])
def test_rotated_anchors(rot):
    box = layout.Box(0, 0, 40, 100, 10.0, nlines=2, ys=(0.0, 0.0), xs=(0.0, 20.0), heights=(100.0, 100.0))
    short, long = layout.place_rotated("ab\n" + "m" * 12, box, rot)
    w = layout.text_width("ab", 10.0)
    assert short[1] == pytest.approx(50 + w / 2 - 1.8 if rot == 90 else 50 - w / 2 + 8.5)
    assert long[1] == pytest.approx(99.0 if rot == 90 else 1.0)
    stacked = layout.place_rotated("one line only", box, rot)
    assert len(stacked) == 1 and stacked[0][1] == pytest.approx(99.0 if rot == 90 else 1.0)


def test_pseudo_blocks_take_the_blocks_numbers(spark):
    rows = spark.createDataFrame([("d", "b", 0, "x 1"), ("d", "b", 1, "y 2")], "doc string, id string, line_no int, text string")
    zh = spark.createDataFrame([("d", "b", "a⟦N0⟧\n b⟦N1⟧⟦N7⟧ ")], "doc string, id string, zh string")
    got = columns.pseudo_blocks(rows, rows.select("doc", "id").distinct(), zh).orderBy("line_no").collect()
    assert [(r.id, r.zh) for r in got] == [("b#0", "a1"), ("b#1", "b2")]


def test_draw_twice_when_bold(spark):
    rows = spark.createDataFrame([("d", 1, "b", 0, 1.0, 2.0, "t", 9.0, 0, True, 0)], "doc string, page int, id string, seq int, x double, y double, text string, fs double, rot int, bold boolean, color int")
    assert sorted(round(r.x, 2) for r in layout.draw_ops(rows).collect()) == [1.0, 1.28]


def test_chained_state_and_resume(spark):
    rows = spark.createDataFrame([("d", 1, 0, "a", "x"), ("d", 2, 1, "b", "y"), ("d", 2, 2, "c", "z")], "doc string, chunk long, ord int, id string, text string")
    step = lambda texts, state: ([state + t for t in texts], texts[-1])
    got = incremental.chained(rows, step, "doc string, chunk long, id string, zh string")
    assert sorted((r.id, r.zh) for r in got.collect()) == [("a", "x"), ("b", "xy"), ("c", "xz")]
    assert [r.id for r in incremental.unfinished(rows, rows.where("chunk = 2")).collect()] == ["a"]


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "a", "x")], "doc string, chunk long, id string, text string")
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(2):
        rows.withColumn("id", F.lit(f"i{i}")).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        incremental.stream_translations(stream, str.upper, out, mark).awaitTermination()
    assert sorted((r.id, r.zh) for r in spark.read.parquet(out).collect()) == [("i0", "X"), ("i1", "X")]


def test_gathered_lines_have_the_gaps_of_merged_columns(spark):
    """One pass over a block's own lines finds what the joined rows show: lines in any order, rows met late, no value."""
    rng = random.Random(11)
    spread = lambda: [(i, rng.choice([0.0, 60.0, 61.0, 130.0, None]), rng.choice([50.0, 59.0, 128.5, None]), rng.choice([0.0, 2.4, 2.5, 2.6, 5.0, 12.0])) for i in range(rng.randrange(1, 9))]
    rows = spark.createDataFrame([("d", f"b{b}", *line) for b in range(300) for line in spread()], "doc string, id string, line_no int, x0 double, x1 double, y double").repartition(5)
    want = sorted(r.id for r in columns.merged_columns(rows, columns.row_clusters(rows)).collect())
    packed = columns.gathered(rows)
    assert sorted(r.id for r in packed.where(columns.has_gap(F.col("ls"))).collect()) == want and 30 < len(want) < 270


@pytest.mark.parametrize("name", ["q_column_merge", "q_pseudo_blocks"])
def test_lines_of_a_block_do_not_move(spark, name):
    import contextlib

    from folio.plans import q_overlay

    with contextlib.redirect_stdout(out := io.StringIO()):
        q_overlay.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert "Exchange" not in out.getvalue() and "ArrowEvalPython" in out.getvalue()
