"""Source profiling before work starts: text layer, boxes, balance, characters, fonts, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def stride_sample(pages: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Every ``max(1, n div k)``-th page of a document; ``counts``: ``doc, n``."""
    return pages.join(counts.select("doc", "n"), "doc").where(F.expr(f"pmod(page - 1, greatest(1, n div {k})) = 0")).drop("n")


def sampled(rows: DataFrame, k: int | None) -> DataFrame:
    """``rows(doc, page, ...)`` of the sampled pages; all where ``k`` is none."""
    return rows if k is None else stride_sample(rows, rows.groupBy("doc").agg(F.max("page").alias("n")), k)


def text_layer(page_chars: DataFrame, k: int = 40, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, sampled, empty, verdict`` from ``doc, page, chars``."""
    counts = page_chars.groupBy("doc").agg(F.max("page").alias("n"))
    rows = stride_sample(page_chars, counts, k).groupBy("doc").agg(F.count("*").alias("sampled"), F.count_if(F.col("chars") < cfg.empty_page_chars).alias("empty"))
    return rows.withColumn("verdict", F.when(F.col("empty") * 2 > F.col("sampled"), "scanned").when(F.col("empty") > 0, "mixed").otherwise("native"))


def box_mismatch(boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``doc, affected, samples``: pages whose crop box leaves the media box's origin or size."""
    off = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        off = off | (F.abs(F.col(f"crop_{c}") - F.col(f"media_{c}")) > tolerance)
    rows = boxes.where(off)
    return rows.groupBy("doc").agg(F.count("*").alias("affected"), F.slice(F.array_sort(F.collect_list("page")), 1, 5).alias("samples"))


# fixed values: the operators that save and restore a page's graphics state
SAVE, RESTORE = r"(?:^|[\s>\]])q(?=[\s<\[]|$)", r"(?:^|[\s>\]])Q(?=[\s<\[]|$)"


def operator_balance(streams: DataFrame, opens: str = SAVE, closes: str = RESTORE, k: int | None = None) -> DataFrame:
    """``doc, n_open, n_close, balanced`` of two patterns in ``text``; ``k``: on sampled pages."""
    rows = sampled(streams, k).groupBy("doc").agg(F.sum(F.regexp_count("text", F.lit(opens))).cast("long").alias("n_open"), F.sum(F.regexp_count("text", F.lit(closes))).cast("long").alias("n_close"))
    return rows.withColumn("balanced", F.col("n_open") == F.col("n_close"))


def character_audit(texts: DataFrame, suspects: dict[str, str], k: int | None = None) -> DataFrame:
    """``ch, n, stands_for`` of suspect characters, in one pass over the texts; ``k``: on sampled pages."""
    found = sampled(texts, k).select(F.explode(F.regexp_extract_all("text", F.lit("[" + "".join(map(T.class_member, suspects)) + "]"), F.lit(0))).alias("ch"))
    meaning = F.create_map(*[F.lit(x) for kv in suspects.items() for x in kv])
    return found.groupBy("ch").agg(F.count("*").alias("n")).withColumn("stands_for", meaning[F.col("ch")])


def suspect_fonts(fonts: DataFrame, n: int = 10) -> DataFrame:
    """``doc, names``: the first type-3 or logo-like fonts by name."""
    # fixed value: what names of logo fonts hold
    hit = (F.col("ftype") == "Type3") | F.col("name").rlike("(?i)logo|brand|mark")
    return fonts.where(hit).groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("name")), 1, n).alias("names"))


def watermarks(spans: DataFrame, hint: str | None = None, top: int = 10, share: float | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, text, occurrences, pages, frac``: short texts that recur with a hint of a site or slogan.

    Texts are grouped without their numbers; the commonest variant of a group is counted.
    """
    # one aggregate, first by page, carries all that is asked for; texts of other lengths only count pages
    s = T.strip(F.col("text"))
    rows = spans.select("doc", "page", "ord", s.alias("s")).select("doc", "page", "ord", F.when((F.length("s") > cfg.watermark_min_len) & (F.length("s") < cfg.watermark_max_len), F.col("s")).alias("text"))
    by_page = rows.groupBy("doc", "text", "page").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    by_text = by_page.groupBy("doc", "text").agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.min("seen").alias("seen"), F.max("page").alias("last"))
    pages = by_text.groupBy("doc").agg(F.max("last").alias("all_pages"))
    best = F.max_by(F.struct("text", "n", "pages", "seen"), F.struct("n", -F.col("seen"))).alias("x")
    modal = by_text.where("text is not null").groupBy("doc", T.digit_mask(F.col("text")).alias("mask")).agg(best).select("doc", "x.*").join(pages, "doc")
    share = cfg.watermark_share if share is None else share
    out = modal.where((F.col("n") >= F.greatest(F.lit(cfg.watermark_min_count).cast("double"), F.col("all_pages") * share)) & F.col("text").rlike(hint or cfg.hint_pattern))
    out = out.select("doc", "text", F.col("n").alias("occurrences"), "pages", (F.col("n") / F.col("all_pages")).alias("frac"), "seen")
    from .validate import samples

    return samples(out, ["doc"], [F.desc("occurrences"), "seen"], top).drop("seen")


def rotated_top(spans: DataFrame, least: int = 10, top: int = 5) -> DataFrame:
    """``doc, text, n``: the commonest rotated texts, then those that are common enough."""
    from .validate import samples

    s = T.strip(F.col("text"))
    rows = spans.where(F.col("rotated") & (s != "")).groupBy("doc", F.left(s, F.lit(40)).alias("text")).agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    return samples(rows, ["doc"], [F.desc("n"), "seen"], top).where(F.col("n") >= least).drop("seen")


def route(files: DataFrame) -> DataFrame:
    """``route`` of ``path`` (and ``verdict`` of its text layer)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumns({"ext": ext, "route": F.when((ext == "pdf") & (F.col("verdict") == "native"), "pdf").when(ext == "pdf", "ocr").when(ext.isin("docx", "pptx", "xlsx"), "office").when(ext.isin("md", "html", "htm", "txt"), "markup").otherwise("unknown")})
