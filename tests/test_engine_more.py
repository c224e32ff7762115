"""Cases of the engine that whole tables do not show: odd files, fixes, layers, commands."""

import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_fixtures import archive

from folio.__main__ import main
from folio.functions import grams
from folio.functions import text as T
from folio.operators import chunking, overlay, profile, qa, terms
from folio.plans.engine import Engine
from folio.sources import jsonio, office, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx(body):
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_runs_in_links_insertions_and_boxes():
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    box = lambda t: f"<w:txbxContent><w:p>{run(t)}</w:p></w:txbxContent>"
    body = (f"<w:p>{run('a')}<w:hyperlink>{run('link')}</w:hyperlink><w:ins>{run('new')}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:sdt><w:sdtContent>{run('field')}</w:sdtContent></w:sdt></w:p>"
            f"<w:p><w:r><mc:AlternateContent><mc:Choice>{box('boxed')}</mc:Choice><mc:Fallback>{box('boxed')}</mc:Fallback></mc:AlternateContent></w:r>{run('after')}</w:p>"
            f"<w:p><w:r><mc:AlternateContent><mc:Fallback>{box('only here')}</mc:Fallback></mc:AlternateContent></w:r></w:p>")
    got = [(kind, text) for _, _, kind, _, text in office.docx_units(docx(body))]
    assert got == [("paragraph", "a"), ("paragraph", "link"), ("paragraph", "new"), ("paragraph", "field"), ("paragraph", "after"), ("box", "boxed"), ("box", "only here")]


def test_ngrams_of_short_texts(spark):
    rows = spark.createDataFrame([("good morning",), ("Good  morning",), ("red blue green",), ("één schöne Straße",), ("one",), ("",), (None,)], "text string")
    got = {(r.size, r.gram): r.n for r in terms.ngrams(rows, stop=("blue",), least=1).collect()}
    assert got == {(2, "good morning"): 2, (3, "red blue green"): 1, (2, "één schöne"): 1, (2, "schöne straße"): 1, (3, "één schöne straße"): 1}


def plain_grams(texts, sizes, stop, least):
    found = Counter()
    for text in texts:
        words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
        found.update((n, " ".join(words[i:i + n])) for n in sizes for i in range(len(words) - n + 1) if not {words[i], words[i + n - 1]} & set(stop))
    return {k: n for k, n in found.items() if n >= least}


def in_pieces(run, piece):
    def within(batches):
        usual, grams.PIECE = grams.PIECE, piece
        try:
            yield from run(batches)
        finally:
            grams.PIECE = usual  # a worker serves other tests too

    return within


@pytest.mark.parametrize(("sizes", "stop", "least"), [((2, 3, 4), ("the", "of"), 3), ((1, 5), (), 2), ((2,), ("the",), 40)])
def test_frequent_ngrams(spark, monkeypatch, sizes, stop, least):
    rng = random.Random(5)
    words = ["the", "of", "é", "ß", "Straße", "x" * 300, "日本", "𝒜𝒷", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    texts = [rng.choice(["", " ", "--"]) + rng.choice([" ", "\n", "1, "]).join(rng.choices(words, range(len(words), 0, -1), k=rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(200)]
    texts += [None, "", " 12 ", "the", "b a " * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = plain_grams(texts, sizes, stop, least)
    assert want
    for piece in (grams.PIECE, 1000):
        with monkeypatch.context() as m:
            for name in ("tallied", "counted"):
                m.setattr(grams, name, lambda *a, f=getattr(grams, name), piece=piece: in_pieces(f(*a), piece))
            got = terms.ngrams(rows, sizes, stop, least)
        assert got.dtypes == [("size", "int"), ("gram", "string"), ("n", "bigint")]
        assert {(r.size, r.gram): r.n for r in got.collect()} == want


def test_ngrams_that_share_a_key(spark, monkeypatch):
    """A key for all: nothing is ruled out, and the words decide."""
    same = lambda hashes, size, at: np.zeros(len(at), np.uint32)
    monkeypatch.setattr(grams, "_keys", same)
    texts = pa.array(["a b c a b", "b c d", None, ""])
    block = next(grams.tallied((2, 3), ("d",), 2)([pa.record_batch([texts], ["w"])]))
    assert block.to_pydict()["n"] == [2]
    cells = grams.whole_map((r["range"], r["cells"]) for r in grams.frequent(2)(pa.table(block)).to_pylist())
    often = type("Sent", (), {"value": cells})
    got = [tuple(r.values()) for b in grams.counted((2, 3), ("d",), often)([pa.record_batch([texts], ["w"])]) for r in b.to_pylist()]
    assert sorted(got) == [(2, "a b", 2), (2, "b c", 2), (2, "c a", 1), (3, "a b c", 1), (3, "b c a", 1), (3, "c a b", 1)]


def test_rare_ngrams_are_not_shuffled(spark):
    """Of words that meet once, what is shuffled is less than three bytes a run (their strings took some twenty)."""
    letters = [chr(97 + i) for i in range(26)]
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices(letters, k=5)) for _ in range(2000)) + " so it goes" for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(4)
    written = lambda: sum(s.shuffleWriteBytes() for s in stages(spark))
    before = written()
    got = {(r.size, r.gram): r.n for r in terms.ngrams(rows, least=20).collect()}
    assert got == {(2, "so it"): 100, (2, "it goes"): 100, (3, "so it goes"): 100}
    assert 0 < written() - before < 3 * 600_000


def stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_first_expansion_on_any_line(spark):
    rows = spark.createDataFrame([("d", 0, "line one\nMIT here"), ("d", 1, "MIT again"), ("e", 0, "éMIT no, MIT yes")], "doc string, ord int, text string")
    got = {(r.doc, r.ord): r.text for r in terms.expand_first(rows, {"MIT": "a $1 \\ place"}).collect()}
    assert got == {("d", 0): "line one\na $1 \\ place (MIT) here", ("d", 1): "MIT again", ("e", 0): "éMIT no, a $1 \\ place (MIT) yes"}
    quoted = terms.expand_first(spark.createDataFrame([("d", 0, "see C++ and C")], "doc string, ord int, text string"), {"C++": "language"}).first()
    assert quoted.text == "see language (C++) and C"


def test_characters_that_mean_something_in_patterns(spark):
    rows = spark.createDataFrame([("d", 1, "a]b^c-d\\e[f&g")], "doc string, page int, text string")
    got = {r.ch: r.stands_for for r in profile.character_audit(rows, {c: c * 2 for c in "]^-\\[&"}).collect()}
    assert got == {c: c * 2 for c in "]^-\\[&"}
    pages = spark.createDataFrame([("d", p, "ﬁ") for p in range(1, 181)], "doc string, page int, text string")
    assert profile.character_audit(pages, T.LIGATURES, 60).first().n == 60
    assert profile.operator_balance(pages.withColumn("text", F.lit("q Q")), k=30).first().n_open == 30


def plain_fold(chars, safe, target, hard):
    """The fold as told: pages one by one, closing before an open page or after a full one."""
    out, chunk, size, held = [], 1, 0, []
    for i, (n, ok) in enumerate(zip(chars, safe)):
        if held and size >= target and ok:
            chunk, size, held = chunk + 1, n, [i]
            out.append((chunk, False))
            continue
        size, held = size + n, held + [i]
        full = size >= hard and i > 0
        out.append((chunk, full))
        if full:
            chunk, size, held = chunk + 1, 0, []
    return [k for k, _ in out], [f for _, f in out]


@pytest.mark.parametrize("seed", range(20))
def test_fold_pages(seed):
    rng = random.Random(seed)
    chars = [rng.choice([0, 10, 40, 99, 250]) for _ in range(rng.randint(0, 60))]
    safe = [rng.random() < 0.6 for _ in chars]
    assert chunking.fold_pages(chars, safe, 100, 180) == plain_fold(chars, safe, 100, 180)


def test_page_pick_needs_few_rows(spark):
    rng = random.Random(3)
    scores = [(p, rng.randint(0, 30)) for p in rng.sample(range(1000), 400)]
    picked = []
    for page, score in sorted(scores, key=lambda x: (-x[1], -x[0])):
        if score and len(picked) < 6 and all(abs(page - q) > 2 for q in picked):
            picked.append(page)
    rows = spark.createDataFrame([("d", p, s) for p, s in scores], "doc string, page int, score long")
    assert [r.page for r in qa.page_pick(rows, 6).orderBy("pick").collect()] == picked


def test_records_of_every_kind(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    samples = {"cells": ("a", 1, 0, 0, 0, 1.0, 2.0, 30.0, 40.0, 3), "fonts": ("a", 1, "Type3", "F"), "boxes": ("a", 1, *map(float, range(8)), 90), "streams": ("a", 1, b"q\xe9 Q"), "marks": ("a", 1, 2, 3, 4)}
    for kind, record in samples.items():
        row = pdf.read_records(spark, str(tmp_path), kind, lambda path, data, record=record: [record]).first()
        assert list(row) == [x.decode("latin-1") if isinstance(x, bytes) else x for x in record]
    tables = pdf.tables_of(spark.createDataFrame([samples["cells"], ("a", 1, 0, 0, 1, 30.0, 2.0, 90.0, 40.0, 3)], pdf.RECORDS["cells"])).first()
    assert (tables.x0, tables.x1, tables.y1, tables.cols) == (1.0, 90.0, 40.0, 3)


def test_layers_and_recurring_tables(spark, tmp_path):
    rows = lambda zh: spark.createDataFrame([("d", "b", zh)], "doc string, id string, zh string")
    path = str(tmp_path / "layers")
    for layer, zh in (("c00", "old"), ("cZZ", "split"), ("c00", "base")):
        jsonio.write_layer(rows(zh), path, layer)
    got = jsonio.read_layers(spark, path, ["c00", "cZZ"])
    assert sorted((r.zh, r.priority) for r in got.collect()) == [("base", 1), ("split", 2)]
    assert overlay.merge_layers(got).first().zh == "split"
    table = spark.createDataFrame([("d", "Page ", "Seite ⟦N0⟧"), ("e", "", "⟦N0⟧")], "doc string, norm_key string, template string")
    jsonio.write_recurring(table, str(tmp_path / "rec"))
    assert sorted(map(tuple, jsonio.read_recurring(spark, str(tmp_path / "rec")).collect())) == sorted(map(tuple, table.collect()))


def test_names_and_redactions(spark):
    names = spark.createDataFrame([("d1", "Show", "own.pdf"), ("d2", "Show", "gone.pdf"), ("d3", None, None), ("d4", "", "x.pdf")], "doc string, display string, given string")
    files = spark.createDataFrame([("own.pdf",), ("Show.pdf",), ("d3.pdf",)], "name string")
    got = {r.doc: (r.output, r.source) for r in overlay.source_name(F.col("given"), F.col("display"), F.col("doc"), files, names).collect()}
    assert got == {"d1": ("Show", "own.pdf"), "d2": ("Show", "Show.pdf"), "d3": ("d3", "d3.pdf"), "d4": ("d4", None)}
    blocks = spark.createDataFrame([("d", 1, i, 10.0, 20.0, 30.0, 40.0) for i in "abc"], "doc string, page int, id string, x0 double, y0 double, x1 double, y1 double")
    actions = spark.createDataFrame([("d", "a", "DRAW"), ("d", "b", "DROP"), ("d", "c", "KEEP")], "doc string, id string, action string")
    assert sorted((r.id, r.x0, r.y1) for r in overlay.redactions(blocks, actions).collect()) == [("a", 9.5, 40.5), ("b", 10.0, 40.0)]


@pytest.fixture(scope="module")
def extracts(tmp_path_factory):
    path = tmp_path_factory.mktemp("more")
    block = lambda i, text, n=1, **k: {"ord": i, "id": f"p1b{i}", "text": text, "bbox": [50.0, 20.0 * i, 350.0, 20.0 * i + 12.0 * n], "size": 10.0, "bold": False, "align": "l", "nlines": n, "line_ys": [20.0 * i + 12 * j for j in range(n)], "line_x0s": [50.0] * n, "line_ws": [100.0] * n, "line_hs": [12.0] * n, **k}
    side = block(3, "left 1\nright 2", 2, line_ys=[60.0, 60.5], line_x0s=[50.0, 200.0])
    pages = [{"page": 1, "blocks": [block(0, "Draft copy"), block(1, "first\nsecond", 2), block(2, "moved"), side, block(4, "gone")]}]
    (path / "a.json").write_text(json.dumps({"doc": "a", "npages": 1, "pages": pages}))
    return path


FIXES = {"a": {"drop_ids": ["p1b4"], "drop_prefixes": ["Draft"], "line_splits": {"p1b1": [{"line": 0, "new_id": "n0", "size": 8.0}, {"line": 1, "new_id": "n1", "dy": 3.0}]}, "lys_shift": {"p1b2": [5.0]}}}


def test_project_fixes(spark, extracts):
    blocks = jsonio.read_extracts(spark, str(extracts))
    got = {r.id: r for r in Engine().prepare(blocks, jsonio.fix_tables(spark, FIXES)).collect()}
    assert set(got) == {"n0", "n1", "p1b2", "p1b3"}
    assert (got["p1b2"].line_ys, got["p1b2"].y0, got["p1b2"].y1) == ([45.0], 40.0, 57.0)
    assert (got["n0"].text, got["n0"].size, got["n0"].nlines, got["n0"].line_ys, got["n0"].y0) == ("first", 8.0, 1, [20.0], 19.0)
    assert (got["n1"].text, got["n1"].size, got["n1"].line_ys, got["n1"].y1) == ("second", 10.0, [35.0], 48.0)


def test_commands_that_build(spark, extracts, tmp_path):
    (tmp_path / "trans").mkdir()
    (tmp_path / "trans" / "a_c01.json").write_text(json.dumps({"p1b2": "Moved text", "p1b3": "L ⟦N0⟧\nR ⟦N1⟧", "n0": "One"}))
    (tmp_path / "fixes.json").write_text(json.dumps(FIXES))
    trans = f"{tmp_path}/trans/*.json"
    assert main(["columns", str(extracts), trans, f"{tmp_path}/layers"]) == 0
    assert sorted((r.id, r.zh) for r in jsonio.read_layers(spark, f"{tmp_path}/layers/layer", ["cZZ"]).collect()) == [("p1b3#0", "L 1"), ("p1b3#1", "R 2")]
    split = {r.id: r for r in jsonio.read_extracts(spark, f"{tmp_path}/layers/extracts").collect()}
    assert set(split) == {"p1b0", "p1b1", "p1b2", "p1b3#0", "p1b3#1", "p1b4"}
    assert [(split[i].text, split[i].nlines, split[i].x0, split[i].line_ys) for i in ("p1b3#0", "p1b3#1")] == [("left 1", 1, 50.0, [60.0]), ("right 2", 1, 200.0, [60.5])]
    assert main(["build", f"{tmp_path}/layers/extracts", trans, f"{tmp_path}/lines", "--layer", f"{tmp_path}/layers/layer"]) == 0
    assert {(r.id, r.text) for r in spark.read.parquet(f"{tmp_path}/lines/draw").collect()} >= {("p1b3#0", "L 1"), ("p1b3#1", "R 2"), ("p1b2", "Moved text")}
    assert main(["build", str(extracts), trans, f"{tmp_path}/out", "--fixes", f"{tmp_path}/fixes.json"]) == 0
    actions = {r.id: r.action for r in spark.read.parquet(f"{tmp_path}/out/actions").collect()}
    assert actions == {"n0": "DRAW", "n1": "UNTRANSLATED", "p1b2": "DRAW", "p1b3": "DRAW"}
    drawn = spark.read.parquet(f"{tmp_path}/out/draw").collect()
    assert {(r.id, r.text) for r in drawn} >= {("p1b2", "Moved text"), ("n0", "One"), ("p1b3", "L 1"), ("p1b3", "R 2")}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/out/redactions").collect()} == {"n0", "p1b2", "p1b3"}


def test_commands_that_look(spark, tmp_path):
    at = "doc string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    box = (0.0, 0.0, 50.0, 20.0)
    spark.createDataFrame([("d", 1, 0, *box)], "doc string, page int, cell_no int, x0 double, y0 double, x1 double, y1 double").write.parquet(f"{tmp_path}/cells")
    spark.createDataFrame([("d", 1, 0, "two words", *box)], at).write.parquet(f"{tmp_path}/source")
    spark.createDataFrame([("d", 1, 0, "两个词", *box)], at).write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([("d", 1, 0, "two words", *box)], at).write.parquet(f"{tmp_path}/bad")
    assert main(["coverage", f"{tmp_path}/cells", f"{tmp_path}/source", f"{tmp_path}/good"]) == 0
    assert main(["coverage", f"{tmp_path}/cells", f"{tmp_path}/source", f"{tmp_path}/bad"]) == 1
    spark.createDataFrame([("d", p, p, 0, 0) for p in range(1, 9)], pdf.RECORDS["marks"]).write.parquet(f"{tmp_path}/marks")
    assert main(["pick", f"{tmp_path}/marks", f"{tmp_path}/picked", "--pages", "2"]) == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/picked").collect()) == ['{"doc":"d","page":5,"pick":1}', '{"doc":"d","page":8,"pick":0}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"Hello")
    assert main(["extract", f"{tmp_path}/in", f"{tmp_path}/extract", "--parser", "one_word_parser:spans"]) == 0
    assert [r.text for r in jsonio.read_extracts(spark, f"{tmp_path}/extract").collect()] == ["Hello"]
