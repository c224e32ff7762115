"""The stages together, from JSON files to draw commands."""

import json

import pytest
from pyspark.sql import functions as F

from folio.__main__ import main
from folio.operators import canonical
from folio.plans.engine import Engine
from folio.sources import jsonio


@pytest.fixture(scope="module")
def extracts(tmp_path_factory):
    path = tmp_path_factory.mktemp("extract")
    block = lambda p, n, t, **k: {"id": f"p{p}b{n}", "text": t, "bbox": [50.0, 40.0 + 20 * n, 350.0, 55.0 + 20 * n], "size": 10.0, "bold": False, "nlines": 1, "line_ys": [40.0 + 20 * n], "line_x0s": [50.0], "line_ws": [300.0], "line_hs": [15.0], **k}
    pages = [{"page": p, "blocks": [block(p, 0, f"Page {p} of 9", size=9.0), block(p, 1, "Body text that goes on. " * 300), block(p, 2, "Scope ........ 12"), block(p, 3, "(x ≥ 2)"), block(p, 4, "This copy of the document is private", keep=True)]} for p in range(1, 5)]
    (path / "a.json").write_text(json.dumps({"doc": "a", "source": "a.pdf", "npages": 4, "table_cont_pages": [], "pages": pages}))
    return path


def test_ingest_to_draw(spark, extracts):
    blocks = jsonio.read_extracts(spark, str(extracts)).withColumns({"align": F.lit("l"), "color": F.lit(0), "rot": F.lit(None).cast("int")})
    engine = Engine(rules=canonical.RuleBook(signatures={"Page # of #": "Seite # von #"}))
    done = engine.ingest(blocks)
    items = {r.id: r for r in done.items.collect()}
    assert items["p1b0"].text == "Page ⟦N0⟧ of 9" and items["p1b2"].text == "Scope ⟦P12⟧"
    assert not {"p1b3", "p1b4"} & set(items)
    assert {r.chunk for r in done.chunks.collect()} == {1, 2}
    table, missing = engine.canonicalise(blocks)
    assert {r.norm_key for r in table.collect()} >= {"Page  of "} and missing.count() > 0
    assert "p1b0" not in {r.id for r in engine.slim(done, table).collect()}
    out = done.items.select("doc", "chunk", "id", F.col("text").alias("zh"))
    assert all(r.passed for r in engine.validate(done.items, out).collect())
    layer = out.where("id like '%b1'").select("doc", "id", F.lit("Text").alias("zh"), F.lit(1).alias("priority"))
    actions = engine.build(blocks, table, layer)
    got = {r.id: (r.action, r.zh) for r in actions.collect()}
    assert got["p3b0"] == ("DRAW", "Seite 3 von 9") and got["p3b1"] == ("DRAW", "Text") and got["p3b3"] == ("DRAW", "(x ≥ 2)") and got["p3b4"][0] == "KEEP"
    ops = engine.draw(blocks, actions).collect()
    assert {r.id for r in ops} >= {"p3b0", "p3b1", "p3b3"} and "p3b4" not in {r.id for r in ops}
    assert set(engine.profile(blocks)) == {"text_layer", "characters", "watermarks"}


def test_commands(spark, extracts, tmp_path):
    out = str(tmp_path / "out")
    assert main(["chunk", str(extracts), out]) == 0 and spark.read.parquet(f"{out}/items").count() > 0
    assert main(["canonical", str(extracts), out]) == 0
    assert main(["profile", str(extracts), out]) == 0
    chunk = {"doc": "a", "chunk": 1, "title": "t", "pages": [1, 1], "context_before": "", "context_after": "", "first_abbrevs": [], "items": [{"id": "p1b0", "page": 1, "text": "A ⟦N0⟧"}]}
    for name, body in (("chunks", chunk), ("good", {"p1b0": "B ⟦N0⟧"}), ("bad", {"p1b0": "B"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a_c01.json").write_text(json.dumps(body))
    assert main(["validate", f"{tmp_path}/chunks/*.json", f"{tmp_path}/good/*.json"]) == 0
    assert main(["validate", f"{tmp_path}/chunks/*.json", f"{tmp_path}/bad/*.json"]) == 1
    spans = spark.createDataFrame([("a", 1, 0, 10.0, 0.0, 600.0, 9.0, 9.0, "wide")], "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    spans.write.parquet(str(tmp_path / "spans"))
    assert main(["qa", str(tmp_path / "spans")]) == 1
    assert main(["qa", str(tmp_path / "spans"), "--allow", "^wide"]) == 0
