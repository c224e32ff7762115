"""Outline trees, fix registries of either kind, page lists, and the options of commands."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio.__main__ import main
from folio.operators import chunking, qa
from folio.sources import jsonio, pdf


def plain_tree(rows, last):
    """With a stack, heading by heading."""
    out, stack = {}, []
    for ord_, page, level in rows:
        while stack and stack[-1][1] >= level:
            stack.pop()
        end = next((p - 1 for _, p, n in rows if (p, _) > (page, ord_) and n <= level), last)
        out[ord_] = (stack[-1][0] if stack else None, page, max(page, end))
        stack.append((ord_, level))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_outline_trees(spark, seed):
    rng = random.Random(seed)
    page, rows = 1, []
    for i in range(40):
        page += rng.choice([0, 0, 1, 3])
        rows.append((i, page, rng.randint(1, 12)))
    frame = spark.createDataFrame([("d", p, i, f"t{i}", n) for i, p, n in rows], "doc string, page int, ord int, title string, level int")
    pages = spark.createDataFrame([("d", p) for p in range(1, page + 3)], "doc string, page int")
    got = {r.ord: (r.parent, r.first_page, r.last_page) for r in chunking.outline_tree(frame, pages).collect()}
    assert got == plain_tree([(i, p, min(n, chunking.MOST_LEVELS)) for i, p, n in rows], page + 2)
    # the pages of a part lie inside its parent's
    assert all(got[p][1] <= a <= z <= max(got[p][2], a) for p, a, z in got.values() if p is not None)


def test_levels_and_bookmarks(spark):
    titles = ["1 Scope", "1.2 Terms", "1.2.3 Words", "Annex A", "2.1.1.1.1.1.1.1.1.1 deep", "10.1x"]
    rows = spark.createDataFrame([("d", i + 1, i, t) for i, t in enumerate(titles)], "doc string, page int, ord int, title string")
    rows = rows.withColumn("level", chunking.heading_level(F.col("title")))
    assert [r.level for r in rows.orderBy("ord").collect()] == [1, 2, 3, 1, 9, 1]
    tree = chunking.outline_tree(rows, rows.select("doc", "page"))
    zh = spark.createDataFrame([("d", 0, "范围"), ("d", 1, " "), ("d", 2, "a\nb")], "doc string, ord int, zh string")
    assert {r.ord: (r.title, r.parent, r.page) for r in chunking.bookmarks(tree, zh).collect()} == {0: ("范围", None, 1), 1: ("1.2 Terms", 0, 2), 2: ("a b", 1, 3), 3: ("Annex A", None, 4), 4: ("2.1.1.1.1.1.1.1.1.1 deep", 3, 5), 5: ("10.1x", None, 6)}


def test_registries_of_either_kind(spark, tmp_path):
    fixes = {"d": {"trans_overrides": {"a": "x", "b": {"append": "y"}, "c": "12"}, "line_splits": {"e": {"line": 0, "new_id": "n"}, "f": [{"line": 1, "new_id": "m", "size": 8, "dy": -1.5, "color": 255}]}, "drop_ids": ["q"], "lys_shift": {"g": [1, 2.5]}}, "empty": {}, "other": {"drop_prefixes": ["w"], "unknown": 3}}
    (tmp_path / "fixes.json").write_text(json.dumps(fixes, indent=1))
    for t in (jsonio.read_fixes(spark, str(tmp_path / "fixes.json")), jsonio.fix_tables(spark, fixes)):
        got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in t.items()}
        assert got == {"overrides": [("d", "a", "x", None), ("d", "b", None, "y"), ("d", "c", "12", None)], "splits": [("d", "e", 0, "n", None, None, None), ("d", "f", 1, "m", 8.0, 255, -1.5)], "drops": [("d", "q")], "prefixes": [("other", "w")], "shifts": [("d", "g", [1.0, 2.5])]}
    for none in ("", str(tmp_path / "none.json")):
        assert all(v.count() == 0 for v in jsonio.read_fixes(spark, none).values())
    (tmp_path / "bad.json").write_text('{"d": {')
    with pytest.raises(Exception, match="MALFORMED"):
        jsonio.read_fixes(spark, str(tmp_path / "bad.json"))["drops"].collect()


def test_reports_and_page_lists(spark):
    at = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([("d", 1, 0, "abc", 0.0, 0.0, 9.0, 9.0), ("d", 2, 1, "de", 0.0, 0.0, 9.0, 9.0), ("e", 1, 0, "f", 0.0, 0.0, 9.0, 9.0)], at)
    spans = spark.createDataFrame([("d", 1, 0, "⟦N1⟧", 0.0, 0.0, 600.0, 9.0), ("d", 1, 1, "x", 0.0, 0.0, 5.0, 9.0), ("gone", 1, 1, "x", 0.0, 0.0, 600.0, 9.0)], at)
    assert sorted(map(tuple, qa.document_report(blocks, spans).collect())) == [("d", 2, 2, 5, 1, 1), ("e", 1, 1, 1, 0, 0)]
    scores = spark.createDataFrame([("d", p, s) for p, s in ((1, 9), (2, 8), (7, 0), (9, 5))], "doc string, page int, score long")
    got = qa.with_pages(qa.page_pick(scores, 2), scores, [2, 7, 9, 30])
    assert {(r.page, r.pick) for r in got.collect()} == {(1, 0), (9, 1), (2, None), (7, None)}
    cells = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 20.0, 20.0)], "doc string, page int, cell_no int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, qa.cell_coverage(cells, blocks, spans, whole=True).collect())) == [("d", 0, 0, True), ("e", 0, 0, True)]
    assert qa.cell_coverage(cells, blocks, spans).count() == 0


def test_options_of_commands(spark, tmp_path, capsys):
    span = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string"
    rows = [("a", p, 0, 10.0, 0.0, 560.0, 9.0, 9.0, "line") for p in range(1, 4)] + [("a", p, 1, 10.0, 700.0, 50.0, 709.0, 9.0, f"第 {p} 页") for p in range(1, 4)]
    spark.createDataFrame(rows, span).write.parquet(str(tmp_path / "spans"))
    run = lambda *more: main(["qa", str(tmp_path / "spans"), *more])
    assert run() == 0 and run("--margin", "550") == 1 and run("--footer", "^第 [0-9]+ 页$") == 0 and run("--footer", "^Seite") == 1 and run("--min-size", "9.5") == 1
    assert "'n_overflow': 3" in capsys.readouterr().out
    at = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 50.0, 20.0)], "doc string, page int, cell_no int, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([("d", 1, 0, "two words", 0.0, 0.0, 50.0, 20.0)], at).write.parquet(f"{tmp_path}/source")
    spark.createDataFrame([("d", 1, 0, "两个词", 0.0, 30.0, 50.0, 40.0)], at).write.parquet(f"{tmp_path}/far")
    run = lambda *more: main(["coverage", *(f"{tmp_path}/{n}" for n in ("cells", "source", "far")), *more])
    assert run() == 1 and run("--tolerance", "16") == 0 and run("--min-words", "3") == 0
    spark.createDataFrame([("d", p, p, 0, 0) for p in range(1, 9)], pdf.RECORDS["marks"]).write.parquet(f"{tmp_path}/marks")
    assert main(["pick", f"{tmp_path}/marks", f"{tmp_path}/picked", "--pages", "1", "--also", "2", "--also", "8"]) == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/picked").collect()) == ['{"doc":"d","page":2}', '{"doc":"d","page":8,"pick":0}']


def test_a_projects_rules(spark, tmp_path):
    block = lambda i, text: {"ord": i, "id": f"p{i}b0", "text": text, "bbox": [50.0, 20.0, 350.0, 32.0], "size": 10.0, "bold": False}
    pages = [{"page": i + 1, "blocks": [block(i, f"Sheet {i}")]} for i in range(4)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text(json.dumps({"doc": "a", "npages": 4, "pages": pages}))
    (tmp_path / "rules.json").write_text(json.dumps({"signatures": {"Sheet #": "Blatt #"}, "patterns": [["^Old", None]]}))
    assert main(["canonical", str(tmp_path / "x"), str(tmp_path / "out"), "--rules", str(tmp_path / "rules.json")]) == 0
    assert [r.template for r in spark.read.parquet(f"{tmp_path}/out/recurring").collect()] == ["Blatt ⟦N0⟧"]
