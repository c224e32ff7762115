"""The stages of a document project as one object: profile, ingest, canonicalise, validate, build, check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..operators import canonical, chunking, layout, overlay, profile, qa, recurring, validate


@dataclass(frozen=True)
class Ingested:
    """Tables of one ingest; all are lazy."""

    blocks: DataFrame
    items: DataFrame
    chunks: DataFrame
    headers: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Engine:
    cfg: EngineConfig = DEFAULT
    rules: canonical.RuleBook = canonical.RuleBook()

    def profile(self, blocks: DataFrame, boxes: DataFrame | None = None, fonts: DataFrame | None = None, streams: DataFrame | None = None) -> dict[str, DataFrame]:
        """Reports by check; each has a row a document (or character)."""
        chars = blocks.groupBy("doc", "page").agg(F.sum(F.length("text")).cast("long").alias("chars"))
        cfg = self.cfg
        out = {"text_layer": profile.text_layer(chars, cfg.sample_text, cfg), "characters": profile.character_audit(blocks, T.LIGATURES, cfg.sample_characters), "watermarks": profile.watermarks(blocks, cfg=cfg)}
        if boxes is not None:
            out["boxes"] = profile.box_mismatch(boxes)
        if fonts is not None:
            out["fonts"] = profile.suspect_fonts(fonts)
        if streams is not None:
            out["balance"] = profile.operator_balance(streams, k=cfg.sample_streams)
        return out

    def ingest(self, blocks: DataFrame, continued: DataFrame | None = None) -> Ingested:
        """Blocks to chunks: items with varying numbers as holes, and a header a chunk."""
        pages = chunking.pages(blocks, self.cfg)
        chunks = chunking.chunks_of(pages, continued, self.cfg)
        vary = recurring.varying_digits(blocks, self.cfg).groupBy("doc", "norm_key").agg(F.collect_set("pos").alias("only"))
        # templates come before contents marks, so that page numbers in marks are not numbered again
        short = F.when(F.length("text") < self.cfg.recurring_max_len, T.norm_key(F.col("text"), self.cfg.key_length))
        numbered = blocks.withColumn("norm_key", short).join(vary, ["doc", "norm_key"], "left")
        numbered = numbered.withColumn("text", F.when(F.col("only").isNotNull(), T.number_runs(F.col("text"), F.col("only"))).otherwise(F.col("text")))
        items = chunking.chunk_items(chunking.items(numbered, self.cfg), chunks)
        headers = chunking.contexts(items, chunks, self.cfg).join(chunking.titles(chunks, chunking.headings(blocks, self.cfg), self.cfg), ["doc", "chunk"])
        headers = headers.join(chunking.first_abbreviations(items, self.cfg), ["doc", "chunk"], "left")
        return Ingested(blocks, items, chunks, headers, chunking.chunk_summary(chunks, pages, items))

    def canonicalise(self, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The table of recurring templates, and the signatures that no rule answers."""
        found = canonical.resolve(recurring.templates(blocks, self.cfg), self.rules)
        table = found.where("zh is not null").select("doc", "norm_key", F.col("zh").alias("template"))
        return table, canonical.missing_signatures(found)

    def slim(self, done: Ingested, table: DataFrame) -> DataFrame:
        """Items that the recurring table does not answer already."""
        covered = recurring.apply_recurring(done.blocks, table, self.cfg).select("doc", "id")
        return done.items.join(covered, ["doc", "id"], "left_anti")

    def validate(self, items: DataFrame, out: DataFrame) -> DataFrame:
        return validate.report(items, out, self.cfg)

    def build(self, blocks: DataFrame, table: DataFrame, layers: DataFrame, overrides: DataFrame | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
        """``doc, id, action, zh``: recurring texts under the translation layers, then overrides and decisions."""
        base = recurring.apply_recurring(blocks, table, self.cfg).withColumn("priority", F.lit(-1))
        merged = overlay.merge_layers(base.unionByName(layers.select("doc", "id", "zh", "priority")))
        if overrides is not None:
            merged = overlay.apply_overrides(merged, overrides)
        return overlay.render_action(blocks, merged, self.cfg.keep_prefixes, drop)

    def prepare(self, blocks: DataFrame, fixes: dict[str, DataFrame], drop: tuple[str, ...] = ()) -> DataFrame:
        """Blocks after a project's fixes: dropped ids and prefixes, moved lines, split blocks (``jsonio.fix_tables``).

        A document's own prefixes and ``drop`` both hold.
        """
        own = fixes["prefixes"].join(blocks.select("doc", "id", "text"), "doc").where(T.strip(F.col("text")).startswith(F.col("prefix"))).select("doc", "id")
        rows = overlay.drop_blocks(blocks, fixes["drops"].unionByName(own), drop).join(fixes["shifts"], ["doc", "id"], "left")
        moved = overlay.shift_lines(F.col("line_ys"), F.col("shift"), F.col("y0"), F.col("y1"))
        has = F.col("shift").isNotNull() & (F.size("line_ys") > 0)
        rows = rows.withColumn("m", F.when(has, moved)).withColumns({"line_ys": F.when(has, F.col("m.ys")).otherwise(F.col("line_ys")), "y0": F.when(has, F.col("m.y0")).otherwise(F.col("y0")), "y1": F.when(has, F.col("m.y1")).otherwise(F.col("y1"))}).drop("m", "shift")
        at = lambda c, i, other: F.coalesce(F.try_element_at(c, i + 1), other)
        line = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(
            F.try_element_at("line_ys", i + 1).alias("y"), at(F.col("line_x0s"), i, F.col("x0")).alias("x0"), at(F.col("line_ws"), i, F.col("x1") - F.col("x0")).alias("w"), at(F.col("line_hs"), i, F.col("size") * 1.2).alias("h"), t.alias("text")))
        rows = rows.withColumn("lines", F.filter(line, lambda x: x["y"].isNotNull()))
        return overlay.split_lines(rows, fixes["splits"]).drop("lines")

    def draw(self, blocks: DataFrame, actions: DataFrame) -> DataFrame:
        """Draw commands of the blocks to be drawn."""
        text = actions.where("action in ('DRAW', 'VERBATIM')").select("doc", "id", "zh")
        return layout.draw_ops(layout.plan_lines(blocks.join(text, ["doc", "id"]), self.cfg))

    def check(self, spans: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
        return qa.summary(spans, allow, cfg=self.cfg)
