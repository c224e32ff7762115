"""q_draw_ops lays out every block."""

import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_every_block_with_text_is_drawn(spark):
    sf = "/root/testdata/sf0.001"
    drawn = {(r.doc, r.id) for r in entry.queries()["q_draw_ops"](spark, sf).select("doc", "id").distinct().collect()}
    blocks = entry.queries()["q_blocks"](spark, sf).where(F.trim("text") != "").select("doc", "id").collect()
    assert drawn == {(r.doc, r.id) for r in blocks}
