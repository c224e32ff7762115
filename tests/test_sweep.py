"""The plane sweep against comparing all pairs, and on a crowded band."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import columns, qa, sweep

BOX = "doc string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"


def boxes(seed, n, wide=60.0, high=30.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(0, 300), float(rng.randrange(0, 300, 24))]), rng.choice([rng.uniform(-40, 200), float(rng.randrange(0, 192, 48))])
        out.append((rng.choice("ab"), rng.randint(1, 2), i, x, y, x + rng.choice([0.0, 2.0, rng.uniform(0, wide), 500.0]), y + rng.choice([0.0, 2.0, rng.uniform(0, high), 150.0]), rng.choice(["one", "two", "xx"])))
    return [*out, ("a", 1, n, None, 0.0, 1.0, 1.0, "null"), ("a", 1, n + 1, 50.0, 0.0, 10.0, 90.0, "turned")]


def overlap(p, q):
    return min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])


@pytest.mark.parametrize(("seed", "n", "batch", "band"), [(1, 150, 10_000, 48.0), (2, 150, 7, 48.0), (3, 150, 1, 5.0), (4, 60, 10_000, 1000.0)])
def test_all_pairs_once(spark, seed, n, batch, band):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    a, b = boxes(seed, n), boxes(seed + 100, n)
    fine = lambda rows: [r for r in rows if r[3] is not None and r[3] <= r[5]]
    try:
        spark.conf.set(name, batch)
        one, two = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
        for least in (0.0, 2.0):
            meet = lambda p, q: p[:2] == q[:2] and min(overlap(p, q)) >= least
            got = sorted((r.doc, r.page, *sorted((r.a_ord, r.b_ord))) for r in sweep.meeting(one, least=least, band=band).collect())
            assert got == sorted((p[0], p[1], p[2], q[2]) for p in fine(a) for q in fine(a) if p[2] < q[2] and meet(p, q))
            got = sorted((r.doc, r.page, r.a_ord, r.b_ord, r.b_text) for r in sweep.meeting(one, two, least=least, band=band).collect())
            assert got == sorted((p[0], p[1], p[2], q[2], q[7]) for p in fine(a) for q in fine(b) if meet(p, q))
    finally:
        spark.conf.set(name, old)


def test_overprint_of_all_pairs(spark):
    rows = boxes(9, 200)
    got = sorted(map(tuple, qa.overprint(spark.createDataFrame(rows, BOX), wide=False).collect()))
    assert got == sorted((p[0], p[1], p[2], q[2]) for p in rows for q in rows if p[2] < q[2] and p[:2] == q[:2] and None not in (p[3], q[3]) and min(overlap(p, q)) > 2 and p[7] != q[7])


def test_a_crowded_band(spark):
    """Ten thousand small rectangles in one row of a page: the pairs are those of neighbours, and time stays that of a walk."""
    rows = [("d", 1, i, i * 0.05, 10.0, i * 0.05 + 2.06, 20.0, f"t{i}") for i in range(10_000)]
    frame = spark.createDataFrame(rows, BOX).repartition(1).cache()
    frame.count()
    began = time.time()
    assert qa.overprint(frame, wide=False).count() == 9_999
    stacked = spark.createDataFrame([("d", 1, i, 0.0, i * 0.004, 50.0, i * 0.004 + 0.003, "t") for i in range(10_000)], BOX)
    assert sweep.meeting(stacked).count() == 0
    assert time.time() - began < 30


def test_first_cells(spark):
    cells = [("d", 1, k, float(x), float(y), x + 40.0, y + 20.0) for k, (x, y) in enumerate([(0, 0), (0, 0), (40, 0), (0, 20), (400, 470)])]
    blocks = [("d", 1, "in", 5.0, 5.0, 20.0, 15.0), ("d", 1, "edge", 41.0, 1.0, 79.0, 19.0), ("d", 1, "out", 30.0, 1.0, 60.0, 9.0), ("d", 1, "far", 402.0, 471.0, 420.0, 480.0), ("d", 2, "other", 5.0, 5.0, 20.0, 15.0)]
    found = columns.cell_expand(spark.createDataFrame(blocks, "doc string, page int, id string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(cells, "doc string, page int, cell_no int, x0 double, y0 double, x1 double, y1 double"))
    assert {r.id: (r.x0, r.x1) for r in found.collect()} == {"in": (2.0, 38.0), "edge": (41.0, 79.0), "far": (402.0, 438.0)}


def test_coverage_of_all_pairs(spark):
    rng = random.Random(4)
    cells = [("d", 1, k, x, y, x + rng.uniform(5, 80), y + rng.uniform(5, 60)) for k, (x, y) in enumerate((rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(60))]
    texts = boxes(6, 120)[:-2]
    target = [(*r[:7], r[7] if r[2] % 3 else "中文") for r in texts]
    frame = lambda rows: spark.createDataFrame(rows, BOX).withColumns({"doc": F.lit("d"), "page": F.lit(1), "text": F.concat("text", F.lit(" word here"))})
    source, out = frame(texts), spark.createDataFrame(target, BOX).withColumns({"doc": F.lit("d"), "page": F.lit(1)})
    found = qa.cell_coverage(spark.createDataFrame(cells, "doc string, page int, cell_no int, x0 double, y0 double, x1 double, y1 double"), source, out).collect()
    middle = lambda r: ((r[3] + r[5]) / 2, (r[4] + r[6]) / 2)
    inside = lambda c, r, s: c[3] - s <= middle(r)[0] <= c[5] + s and c[4] - s <= middle(r)[1] <= c[6] + s
    n = miss = 0
    for c in cells:
        if any(inside(c, r, 0) for r in texts):
            exact = " ".join(r[7] for r in sorted(target, key=lambda r: r[2]) if inside(c, r, 0))
            near = " ".join(r[7] for r in target if inside(c, r, 7))
            n, miss = n + 1, miss + ("中" not in (exact or near))
    assert [(r.n_cells, r.n_missing) for r in found] == [(n, miss)] and n > 20
