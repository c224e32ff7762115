"""Scans of laid-out pages: overflow, overlap, tiny text, residue, feet, table cells, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import automaton as A
from ..functions import text as T
from . import sweep


def _overflows(allow: tuple[str, ...], cfg: EngineConfig) -> Column:
    hit = (F.col("x1") > cfg.right_margin) & (F.col("x0") < cfg.right_margin + 10)
    for pattern in allow:
        hit = hit & ~F.col("text").rlike(pattern)
    return hit


def overflow(spans: DataFrame, allow: tuple[str, ...] = (), cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Lines that start before the right margin and end beyond it; texts that match an allowed pattern are exempt."""
    return spans.where(_overflows(allow, cfg))


def _is_tiny(spans: DataFrame, cfg: EngineConfig, wide: bool) -> Column:
    least = F.when(F.col("x1") - F.col("x0") < 60, cfg.narrow_text_size).otherwise(cfg.min_text_size) if "narrow_cells" in spans.columns else F.lit(cfg.min_text_size)
    script = T.has_wide_cjk(F.col("text")) if wide else F.lit(True)
    return (F.col("size") < least) & script & (F.length(T.strip(F.col("text"))) > 1)


def tiny(spans: DataFrame, cfg: EngineConfig = DEFAULT, wide: bool = True) -> DataFrame:
    """CJK text (``wide``; else any) of two characters or more below the smallest size; narrow cells have their own."""
    return spans.where(_is_tiny(spans, cfg, wide))


def residue(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("text").contains("⟦"))


def bad_footers(feet: DataFrame, pattern: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Foot texts of pages from the third on that have CJK and do not match."""
    s = T.strip(F.col("text"))
    return feet.where((F.col("page") > 2) & (s != "") & T.has_wide_cjk(F.col("text")) & ~F.col("text").rlike(pattern))


def overprint(spans: DataFrame, cfg: EngineConfig = DEFAULT, wide: bool = True) -> DataFrame:
    """``doc, page, i, j``: pairs on a page that overlap by more than the tolerance each way, with other texts.

    A plane sweep compares a rectangle with those it can touch.  Only texts of two characters or
    more count, and only CJK ones if ``wide``; one text drawn twice is bold print.
    """
    spans = spans.where(F.length(T.strip(F.col("text"))) > 1)
    if wide:
        spans = spans.where(T.has_wide_cjk(F.col("text")))
    near = sweep.meeting(spans.select("doc", "page", "ord", "x0", "y0", "x1", "y1", "text"), least=cfg.overlap)
    over = lambda p, q: F.least(f"a_{q}", f"b_{q}") - F.greatest(f"a_{p}", f"b_{p}") > cfg.overlap
    hit = over("x0", "x1") & over("y0", "y1") & (F.col("a_text") != F.col("b_text")) & (F.col("a_ord") != F.col("b_ord"))
    return near.where(hit).select("doc", "page", F.least("a_ord", "b_ord").alias("i"), F.greatest("a_ord", "b_ord").alias("j"))


def cell_coverage(cells: DataFrame, source: DataFrame, target: DataFrame, cfg: EngineConfig = DEFAULT, whole: bool = False) -> DataFrame:
    """``doc, n_cells, n_missing, passed``: source cells with enough words whose place in the target has no CJK, exactly or nearby.

    ``whole``: a row for every document, those without such cells have passed.
    A plane sweep brings each cell, with the tolerance around it, together with the middles of the texts inside.
    """
    t = cfg.coverage_tolerance
    middle = ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")
    texts = source.select("doc", "page", "ord", "text", *middle, F.lit(False).alias("out")).unionByName(target.select("doc", "page", "ord", "text", *middle, F.lit(True).alias("out")))
    points = texts.select("doc", "page", "ord", "text", "out", F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.col("cx").alias("x1"), F.col("cy").alias("y1"))
    boxes = cells.select("doc", "page", "cell_no", *[F.col(c).cast("double").alias(f"c{c}") for c in sweep.EDGES], *[(F.col(c) + d).alias(c) for c, d in zip(sweep.EDGES, (-t, -t, t, t), strict=True)])
    met = sweep.meeting(boxes, points)
    rows = met.select("doc", "page", F.col("a_cell_no").alias("cell_no"), *[F.col(f"a_c{c}").alias(c) for c in sweep.EDGES], F.col("b_ord").alias("ord"), F.col("b_text").alias("text"), F.col("b_out").alias("out"), F.col("b_x0").alias("cx"), F.col("b_y0").alias("cy"))
    inside = lambda s: (F.col("cx") >= F.col("x0") - s) & (F.col("cx") <= F.col("x1") + s) & (F.col("cy") >= F.col("y0") - s) & (F.col("cy") <= F.col("y1") + s)
    rows = rows.where(inside(t))
    kept = lambda cond: T.collapse_blanks(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "text")))), lambda v: v["text"]), " "))
    out = F.col("out")
    got = rows.groupBy("doc", "page", "cell_no").agg(kept(~out & inside(0.0)).alias("src"), kept(out & inside(0.0)).alias("exact"), kept(out).alias("near"))
    asked = got.where(F.regexp_count("src", F.lit("[A-Za-z]{3,}")) >= cfg.coverage_min_words)
    found = asked.groupBy("doc").agg(F.count("*").alias("n_cells"), F.count_if(~T.has_cjk(F.coalesce(F.nullif("exact", F.lit("")), "near"))).alias("n_missing"))
    if whole:  # a document without such cells has missed none
        none = F.lit(0).cast("long")
        found = cells.select("doc").unionByName(source.select("doc")).distinct().join(found, "doc", "left").select("doc", F.coalesce("n_cells", none).alias("n_cells"), F.coalesce("n_missing", none).alias("n_missing"))
    return found.withColumn("passed", F.col("n_missing") <= cfg.coverage_max_miss * F.col("n_cells"))


def baseline_diff(found: DataFrame, source: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Overflows of the output that the source has not at the same place."""
    s = source.select("doc", "page", F.col("x1").alias("sx"))
    near = (found["doc"] == s["doc"]) & (found["page"] == s["page"]) & (F.abs(found["x1"] - s["sx"]) <= cfg.baseline_tolerance)
    return found.join(s, near, "left_anti")


def residual_language(spans: DataFrame, pattern: str, allowed: DataFrame, phrases: A.Terms | None = None) -> DataFrame:
    """``doc, page, ord, word``: source-language words left in the output, minus a list of allowed words.

    ``phrases``: names of several words that may stay; words inside them do not count.
    """
    if phrases is not None:
        spans = spans.withColumn("text", A.mask_terms(F.col("text"), phrases))
    words = spans.select("doc", "page", "ord", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).distinct()
    return words.join(allowed.select("word").distinct(), "word", "left_anti").select("doc", "page", "ord", "word")


def page_number_gaps(feet: DataFrame, pattern: str = "([0-9]+)") -> DataFrame:
    """``doc, page, number, continuous``: numbers in feet must grow by one from page to page."""
    rows = feet.select("doc", "page", F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")).cast("long").alias("number")).where("number is not null")
    w = Window.partitionBy("doc").orderBy("page")
    return rows.withColumn("continuous", F.coalesce(F.col("number") - F.lag("number").over(w) == F.col("page") - F.lag("page").over(w), F.lit(True)))


def summary(spans: DataFrame, allow: tuple[str, ...] = (), wide: bool = True, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row a document: counts of each scan and whether all are zero."""
    flag = lambda c, n: F.count_if(c).alias(n)
    per = spans.groupBy("doc").agg(flag(_overflows(allow, cfg), "n_overflow"), flag(F.col("text").contains("⟦"), "n_residue"), flag(_is_tiny(spans, cfg, wide), "n_tiny"))
    pairs = overprint(spans, cfg, wide).groupBy("doc").agg(F.count("*").alias("n_overprint"))
    names = ["n_overflow", "n_residue", "n_tiny", "n_overprint"]
    out = per.join(pairs, "doc", "left").withColumn("n_overprint", F.coalesce("n_overprint", F.lit(0).cast("long")))
    return out.select("doc", *names).withColumn("passed", sum((F.col(n) for n in names), F.lit(0)) == 0)


def document_report(blocks: DataFrame, spans: DataFrame, allow: tuple[str, ...] = (), cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, n_blocks, n_pages, chars, n_overflow, n_residue``: sizes and findings of each document with blocks, by one aggregate over both tables."""
    zero = F.lit(0).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    a = blocks.select("doc", F.lit(1).cast("long").alias("n_blocks"), F.col("page").alias("n_pages"), F.length("text").cast("long").alias("chars"), zero.alias("n_overflow"), zero.alias("n_residue"))
    b = spans.select("doc", zero.alias("n_blocks"), F.lit(None).cast("int").alias("n_pages"), zero.alias("chars"), one(_overflows(allow, cfg)).alias("n_overflow"), one(F.col("text").contains("⟦")).alias("n_residue"))
    total = a.unionByName(b).groupBy("doc").agg(F.sum("n_blocks").alias("n_blocks"), F.max("n_pages").alias("n_pages"), *[F.sum(c).alias(c) for c in ("chars", "n_overflow", "n_residue")])
    return total.where("n_blocks > 0")


def page_scores(pages: DataFrame) -> DataFrame:
    """``doc, page, score``: 2 a drawing, 3 an image, 1 a short line."""
    return pages.select("doc", "page", (F.col("drawings") * 2 + F.col("images") * 3 + F.col("short_lines")).cast("long").alias("score"))


def page_pick(scores: DataFrame, k: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, pick``: best pages first (later page of equals), none near one already picked, none without score."""
    # a picked page hides at most so many, itself included: the best rows decide, whatever the number of pages
    enough = k * (2 * cfg.page_suppression + 1)
    best = scores.where("score > 0").withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), F.desc("page")))).where(F.col("r") <= enough)
    per = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("score", "page")), asc=False).alias("ps"))
    zero = F.array().cast("array<int>")
    step = lambda z, x: F.when((F.size(z) < k) & ~F.exists(z, lambda q: F.abs(q - x["page"]) <= cfg.page_suppression), F.concat(z, F.array(x["page"].cast("int")))).otherwise(z)
    return per.select("doc", F.posexplode(F.aggregate("ps", zero, step)).alias("pick", "page")).select("doc", "page", "pick")


def with_pages(picked: DataFrame, pages: DataFrame, also: list[int]) -> DataFrame:
    """The picked pages and those that were asked for, each page of a document once; the latter have no ``pick``."""
    wanted = pages.where(F.col("page").isin(also)).select("doc", "page", F.lit(None).cast("int").alias("pick"))
    return picked.unionByName(wanted).groupBy("doc", "page").agg(F.min("pick").alias("pick"))


def crop_pixels(spec: Column, dpi: Column, width: Column, height: Column) -> Column:
    """A crop in points as whole pixels inside the image."""
    s = T.crop_spec(spec)
    px = lambda v: F.floor(v * dpi / 72).cast("int")
    return F.struct(F.greatest(F.lit(0), px(s["x0"])).alias("x0"), F.greatest(F.lit(0), px(s["y0"])).alias("y0"), F.least(width, px(s["x1"])).alias("x1"), F.least(height, px(s["y1"])).alias("y1"))


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of two documents with one number: ``page`` and both columns."""
    return a.select("page", F.col("doc").alias("doc_a")).join(b.select("page", F.col("doc").alias("doc_b")), "page")
