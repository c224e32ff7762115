"""Page boundaries, the greedy chunk fold, chunk items, contexts, titles and abbreviations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def body(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Blocks that are neither kept marks nor running heads or feet."""
    return blocks.where(~T.is_kept(F.col("text"), cfg) & (F.col("size") > cfg.header_max_size) & ~T.strip(F.col("text")).rlike(cfg.running_head_pattern))


def items(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, ord, id, text``: what goes to translation, contents lines marked."""
    rows = blocks.where(~T.is_kept(F.col("text"), cfg) & ~T.is_symbolic(F.col("text")))
    return rows.select("doc", "page", "ord", "id", T.toc_mark(F.col("text"), cfg.toc_parity).alias("text"))


def _edge(cfg: EngineConfig) -> tuple[Column, Column]:
    """What a boundary looks at in a body block, and where it stands (null: no body block)."""
    inner = ~T.is_kept(F.col("text"), cfg) & (F.col("size") > cfg.header_max_size) & ~T.strip(F.col("text")).rlike(cfg.running_head_pattern)
    return F.struct("text", "size", "bold", (F.col("x1") - F.col("x0")).alias("width")), F.when(inner, F.col("ord"))


def _chars(cfg: EngineConfig) -> Column:
    n = F.when(~T.is_kept(F.col("text"), cfg) & ~T.is_symbolic(F.col("text")), F.length(T.toc_mark(F.col("text"), cfg.toc_parity))).otherwise(0)
    return F.sum(n).cast("long").alias("chars")


def pages(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, chars, first, last`` in one aggregate: item characters, first and last body block of every page."""
    edge, at = _edge(cfg)
    return blocks.groupBy("doc", "page").agg(_chars(cfg), F.min_by(edge, at).alias("first"), F.max_by(edge, at).alias("last"))


def page_chars(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, chars``: every page, also those without items."""
    return blocks.groupBy("doc", "page").agg(_chars(cfg))


def table_continuation(tables: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page`` whose first table goes on from the last of the page before.

    ``tables``: ``doc, page, table_no, x0, x1, y1, cols``.
    """
    shape = F.struct(F.round("x0").alias("x0"), F.round("x1").alias("x1"), "cols")
    per = tables.groupBy("doc", "page").agg(F.min_by(shape, "table_no").alias("first"), F.max_by(F.struct(shape.alias("shape"), "y1"), "table_no").alias("last"))
    w = Window.partitionBy("doc").orderBy("page")
    prev = per.withColumns({"lp": F.lag("page").over(w), "ll": F.lag("last").over(w)})
    return prev.where((F.col("lp") == F.col("page") - 1) & (F.col("ll.y1") > cfg.bottom_limit) & (F.col("ll.shape") == F.col("first"))).select("doc", "page")


def _reason(pages_: DataFrame, continued: DataFrame | Column | None, cfg: EngineConfig) -> DataFrame:
    """``pages`` with ``reason`` why no chunk may end before the page (empty: it may; null: a document's first).

    ``continued``: the pages that go on with a table, as rows or as a condition.
    """
    w = Window.partitionBy("doc").orderBy("page")
    rows, cont = pages_, F.lit(False) if continued is None else continued
    if isinstance(continued, DataFrame):
        rows = pages_.join(continued.select("doc", "page", F.lit(True).alias("cont")), ["doc", "page"], "left")
        cont = F.coalesce("cont", F.lit(False))
    rows = rows.withColumns({"prev": F.lag("last").over(w), "nth": F.row_number().over(w)})
    first, prev = F.col("first"), F.col("prev")
    opens = T.is_heading(first["text"], first["bold"], first["size"], cfg) | (first["bold"] & (first["size"] >= cfg.heading_min_size))
    flows = F.coalesce(~T.ends_sentence(prev["text"], cfg) & ~opens & (prev["width"] > cfg.full_width), F.lit(False))
    return rows.withColumn("reason", F.when(F.col("nth") > 1, F.when(cont, "table goes on").when(flows, "paragraph goes on").otherwise("")))


def safe_boundary(blocks: DataFrame, continued: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, safe, reason`` for every page but a document's first."""
    edge, at = _edge(cfg)
    pages_ = blocks.groupBy("doc", "page").agg(F.min_by(edge, at).alias("first"), F.max_by(edge, at).alias("last"))
    return _reason(pages_, continued, cfg).where("reason is not null").select("doc", "page", (F.col("reason") == "").alias("safe"), "reason")


def fold_pages(chars: list[int], safe: list[bool], target: int, hard: int) -> tuple[list[int], list[bool]]:
    """(chunk, whether the hard limit ended it) of each page, folded greedily in order."""
    chunk, size, held = 1, 0, 0
    chunks_, forced = [], []
    for i, (n, ok) in enumerate(zip(chars, safe, strict=True)):
        cut = held > 0 and size >= target and ok
        chunk += cut
        size, held = (n, 1) if cut else (size + n, held + 1)
        # the hard limit is looked at when a page is added to a chunk, not when it opens a document or follows a cut
        end = not cut and i > 0 and size >= hard
        chunks_.append(chunk)
        forced.append(end)
        if end:
            chunk, size, held = chunk + 1, 0, 0
    return chunks_, forced


def _folded(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    target, hard, kind = cfg.chunk_target, cfg.chunk_hard, dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fold_pages(c, s, target, hard) for c, s in zip(b.column("chars").to_pylist(), b.column("safe").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("page"), pa.array([k for k, _ in out], pa.list_(pa.int64())), pa.array([f for _, f in out], pa.list_(pa.bool_()))], names=["doc", "page", "chunk", "forced"])

    per = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "chars", F.coalesce("safe", F.lit(True)).alias("safe")))).alias("ps"))
    found = per.select("doc", "ps.page", "ps.chars", "ps.safe").mapInArrow(run, f"doc {kind['doc']}, page array<{kind['page']}>, chunk array<long>, forced array<boolean>")
    return found.select("doc", F.explode(F.arrays_zip("page", "chunk", "forced")).alias("r")).select("doc", "r.page", "r.chunk", "r.forced")


def chunks(pages_: DataFrame, boundaries: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, chunk, forced``: pages folded greedily in order; three numbers a page are gathered for a document."""
    return _folded(pages_.join(boundaries.select("doc", "page", "safe"), ["doc", "page"], "left"), cfg)


def chunks_of(pages_: DataFrame, continued: DataFrame | Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``chunks`` from ``pages`` alone: characters and boundaries come from the same rows."""
    return _folded(_reason(pages_, continued, cfg).select("doc", "page", "chars", (F.coalesce("reason", F.lit("")) == "").alias("safe")), cfg)


def chunk_items(items_: DataFrame, chunks_: DataFrame) -> DataFrame:
    """``doc, chunk, page, ord, id, text``."""
    return items_.join(chunks_.select("doc", "page", "chunk"), ["doc", "page"]).select("doc", "chunk", "page", "ord", "id", "text")


def chunk_summary(chunks_: DataFrame, pages: DataFrame, items_: DataFrame) -> DataFrame:
    """``doc, n_chunks, n_forced, n_items, mean_chars`` (whole characters a chunk)."""
    a = chunks_.groupBy("doc").agg(F.count_distinct("chunk").alias("n_chunks"), F.count_if("forced").alias("n_forced"))
    b = pages.groupBy("doc").agg(F.sum("chars").alias("chars"))
    c = items_.groupBy("doc").agg(F.count("*").alias("n_items"))
    out = a.join(b, "doc").join(c, "doc", "left")
    return out.select("doc", "n_chunks", "n_forced", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.expr("chars div n_chunks").alias("mean_chars"))


def contexts(chunk_items_: DataFrame, chunks_: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, chunk, first_page, last_page, context_before, context_after``."""
    pages_ = chunks_.groupBy("doc", "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    # a chunk is bounded by the hard limit, and of its items only as much is gathered as a context can show
    shown = F.array_sort(F.collect_list(F.struct("ord", F.left("text", F.lit(cfg.after_chars)).alias("head"), F.right("text", F.lit(cfg.before_chars)).alias("tail"))))
    joined = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), cfg.joiner)
    ends = chunk_items_.groupBy("doc", "chunk").agg(shown.alias("x"))
    last = F.reverse(F.slice(F.reverse("x"), 1, cfg.before_items))
    text = ends.select("doc", "chunk", joined(F.slice("x", 1, cfg.after_items), "head").alias("lead"), joined(last, "tail").alias("trail"))
    w = Window.partitionBy("doc").orderBy("chunk")
    rows = pages_.join(text, ["doc", "chunk"], "left").withColumns({"b": F.lag("trail").over(w), "a": F.lead("lead").over(w)})
    return rows.select("doc", "chunk", "first_page", "last_page", F.right(F.coalesce("b", F.lit("")), F.lit(cfg.before_chars)).alias("context_before"), F.left(F.coalesce("a", F.lit("")), F.lit(cfg.after_chars)).alias("context_after"))


def headings(blocks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, page, ord, title`` of heading blocks."""
    rows = blocks.where(T.is_heading(F.col("text"), F.col("bold"), F.col("size"), cfg))
    return rows.select("doc", "page", "ord", F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")).alias("title"))


def titles(chunks_: DataFrame, headings_: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, chunk, title``: the last heading on a page before the chunk's first page."""
    first = chunks_.groupBy("doc", "chunk").agg(F.min("page").alias("page"))
    rows = first.select("doc", "page", F.lit(0).alias("kind"), F.lit(-1).alias("ord"), "chunk", F.lit(None).cast("string").alias("title")).unionByName(
        headings_.select("doc", "page", F.lit(1).alias("kind"), "ord", F.lit(None).cast("long").alias("chunk"), "title"))
    # a page's chunk row comes before its headings, so only earlier pages are seen
    seen = Window.partitionBy("doc").orderBy("page", "kind", "ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("t", F.last("title", ignorenulls=True).over(seen)).where("kind = 0").select("doc", "chunk", F.coalesce("t", F.lit(cfg.default_title)).alias("title"))


def first_abbreviations(chunk_items_: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc, chunk, abbrevs``: known abbreviations in the chunk where they first appear, sorted and comma-joined."""
    known = F.array_compact(F.array(*[F.when(T.has_word(F.col("text"), a), F.lit(a)) for a in cfg.abbreviations]))
    rows = chunk_items_.select("doc", "chunk", F.explode(known).alias("abbrev")).groupBy("doc", "abbrev").agg(F.min("chunk").alias("chunk"))
    return rows.groupBy("doc", "chunk").agg(F.array_join(F.array_sort(F.collect_list("abbrev")), ",").alias("abbrevs"))


def outline(headings_: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, ord, title, first_page, last_page``: each heading with the pages up to the next."""
    w = Window.partitionBy("doc").orderBy("page", "ord")
    last = pages.groupBy("doc").agg(F.max("page").alias("end"))
    rows = headings_.withColumn("next", F.lead("page").over(w)).join(last, "doc")
    return rows.select("doc", "ord", "title", F.col("page").alias("first_page"), F.greatest("page", F.coalesce(F.col("next") - 1, F.col("end"))).alias("last_page"))


#: Levels that an outline may have; deeper headings count as the last.
MOST_LEVELS = 9


def heading_level(title: Column, numbered: str = r"^([0-9]+(?:\.[0-9]+)*)\b") -> Column:
    """A numbered heading's level is that of its number (``2.1.3``: 3); all others are on the first."""
    number = F.regexp_extract(title, numbered, 1)
    return F.when(number == "", 1).otherwise(F.least(F.size(F.split(number, r"\.")), F.lit(MOST_LEVELS)))


def outline_tree(headings_: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, ord, title, level, parent, first_page, last_page`` for headings with a ``level`` from 1 on.

    The parent (its ``ord``) is the last heading before that has a smaller level; a heading reaches to
    the page before the next one that is not below it, so the pages of a part lie inside its parent's.
    """
    ahead, behind = (Window.partitionBy("doc").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (("page", "ord"), (F.desc("page"), F.desc("ord"))))
    level = F.least("level", F.lit(MOST_LEVELS))
    of = lambda n, c: F.when(level == n, F.col(c))
    above = F.greatest(F.lit(None).cast("int"), *[F.when(level > n, F.last(of(n, "ord"), ignorenulls=True).over(ahead)) for n in range(1, MOST_LEVELS)])
    # seen from the end, the last heading of a level is the next one
    after = F.least(F.lit(None).cast("int"), *[F.when(level >= n, F.last(of(n, "page"), ignorenulls=True).over(behind)) for n in range(1, MOST_LEVELS + 1)])
    rows = headings_.withColumns({"parent": above, "next": after}).join(pages.groupBy("doc").agg(F.max("page").alias("end")), "doc")
    return rows.select("doc", "ord", "title", level.cast("int").alias("level"), "parent", F.col("page").alias("first_page"), F.greatest("page", F.coalesce(F.col("next") - 1, F.col("end"))).alias("last_page"))


def bookmarks(tree: DataFrame, translated: DataFrame) -> DataFrame:
    """``doc, ord, level, parent, title, page``: an outline with its titles as ``translated(doc, ord, zh)`` has them, else as they are."""
    rows = tree.join(translated.select("doc", "ord", "zh"), ["doc", "ord"], "left")
    title = F.coalesce(F.nullif(T.strip(F.replace("zh", F.lit("\n"), F.lit(" "))), F.lit("")), "title")
    return rows.select("doc", "ord", "level", "parent", title.alias("title"), F.col("first_page").alias("page"))
