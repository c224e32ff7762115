"""python -m folio COMMAND ...: the engine's stages over JSON documents and Parquet tables.

    extract FILES OUT               blocks of PDF files as extracts (JSON); --parser module:function
    profile EXTRACTS OUT            text layer, characters and watermarks (JSON)
    chunk EXTRACTS OUT              extracts to chunk items and headers (Parquet) and a summary (JSON)
    canonical EXTRACTS OUT          recurring templates (Parquet, JSON), unanswered signatures (TSV), chunk items without what templates answer
    validate CHUNKS TRANS           exit code 1 unless every chunk passes
    columns EXTRACTS TRANS OUT      column-merged blocks as blocks a line: new extracts (JSON) and their layer (Parquet)
    build EXTRACTS TRANS OUT        actions, redactions and draw commands (Parquet); --layer, --fixes, --recurring, --drop
    qa SPANS                        a Parquet table of laid-out spans; exit code 1 unless every document passes
    coverage CELLS SOURCE TARGET    Parquet tables of cells and spans; exit code 1 unless every document passes
    pick MARKS OUT                  the pages to look at, by their marks (JSON)
"""

from __future__ import annotations

import argparse
import importlib
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import canonical, columns, overlay, qa
from .plans.engine import Engine
from .plans.shipping import ship_package
from .sources import jsonio, paged, pdf

#: The name of the layer that holds translations of single lines.
PSEUDO = "cZZ"
PATHS = {"extract": 2, "profile": 2, "chunk": 2, "canonical": 2, "validate": 2, "columns": 3, "build": 3, "qa": 1, "coverage": 3, "pick": 2}


#: Options and the settings they stand for.
KNOBS = {"margin": "right_margin", "min-size": "min_text_size", "tolerance": "coverage_tolerance", "min-words": "coverage_min_words"}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folio", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=list(PATHS))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--allow", action="append", default=[], help="qa: pattern of texts that may cross the margin")
    parser.add_argument("--parser", help="extract: module:function that yields a file's spans, or module:class of a page parser, which reads large files in ranges")
    parser.add_argument("--layer", help="build: the layer that columns wrote")
    parser.add_argument("--fixes", default="", help="build: JSON file of a project's fixes")
    parser.add_argument("--recurring", help="build: Parquet table of recurring templates")
    parser.add_argument("--drop", action="append", default=[], help="build: prefix of texts to drop")
    for name, knob in KNOBS.items():
        parser.add_argument(f"--{name}", type=type(getattr(DEFAULT, knob)), default=getattr(DEFAULT, knob), help=f"qa, coverage: {knob} of the configuration")
    parser.add_argument("--footer", help="qa: pattern that a page's lowest text has to match from the third page on")
    parser.add_argument("--rules", help="canonical: JSON file of a project's rules (signatures, patterns, identity, identity_prefix, skip)")
    parser.add_argument("--also", type=int, action="append", default=[], help="pick: page to look at besides the picked ones")
    parser.add_argument("--pages", type=int, default=8, help="pick: pages a document")
    opts = parser.parse_args(args)
    if len(opts.paths) != PATHS[opts.command]:
        parser.error(f"{opts.command} takes {PATHS[opts.command]} paths")
    spark = SparkSession.builder.appName("folio").getOrCreate()
    ship_package(spark)
    engine = Engine(replace(DEFAULT, **{knob: getattr(opts, name.replace("-", "_")) for name, knob in KNOBS.items()}), canonical.read_rules(spark, opts.rules) if opts.rules else canonical.SAMPLE)
    return globals()[f"_{opts.command}"](spark, engine, opts, *opts.paths)


def _extract(spark, engine, opts, files: str, out: str) -> int:
    module, _, name = (opts.parser or "").partition(":")
    if not name:
        raise SystemExit("extract needs --parser module:function")
    found = getattr(importlib.import_module(module), name)
    spans = paged.read_pages(spark, files, "spans", opts.parser) if isinstance(found, type) else pdf.read_spans(spark, files, found)
    jsonio.write_extracts(pdf.spans_to_blocks(spans, engine.cfg), out)
    return 0


def _profile(spark, engine, opts, extracts: str, out: str) -> int:
    for name, report in engine.profile(jsonio.read_extracts(spark, extracts)).items():
        jsonio.write_json_report(report, f"{out}/{name}")
    return 0


def _chunk(spark, engine, opts, extracts: str, out: str) -> int:
    done = engine.ingest(jsonio.read_extracts(spark, extracts))
    jsonio.write_chunks(done.items, f"{out}/items")
    done.headers.write.mode("overwrite").parquet(f"{out}/headers")
    jsonio.write_json_report(done.summary, f"{out}/summary")
    return 0


def _canonical(spark, engine, opts, extracts: str, out: str) -> int:
    blocks = jsonio.read_extracts(spark, extracts)
    table, missing = engine.canonicalise(blocks)
    table.write.mode("overwrite").parquet(f"{out}/recurring")
    jsonio.write_recurring(table, f"{out}/recurring_json")
    jsonio.write_missing(missing, f"{out}/missing")
    jsonio.write_chunks(engine.slim(engine.ingest(blocks), table), f"{out}/items")
    return 0


def _translations(spark, path: str) -> DataFrame:
    return jsonio.read_translations(spark, path).where("not bad and id is not null").select("doc", "chunk", "id", "zh")


def _validate(spark, engine, opts, chunks: str, trans: str) -> int:
    items = jsonio.read_chunks(spark, chunks).select("doc", F.col("chunk").cast("int").alias("chunk"), "id", "text")
    return _verdict(engine.validate(items, _translations(spark, trans)))


def _columns(spark, engine, opts, extracts: str, trans: str, out: str) -> int:
    blocks = jsonio.read_extracts(spark, extracts)
    at = lambda c, other: F.coalesce(F.try_element_at(c, F.col("line_no") + 1), other)
    lines = blocks.where("nlines >= 2").select("*", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc", "id", "line_no", F.col("line").alias("text"), at("line_ys", F.col("y0")).alias("y"), at("line_x0s", F.col("x0")).alias("x0"), (at("line_x0s", F.col("x0")) + at("line_ws", F.lit(0.0))).alias("x1"))
    merged = columns.merged_columns(lines, columns.row_clusters(lines, engine.cfg), engine.cfg)
    zh = _translations(spark, trans).groupBy("doc", "id").agg(F.max_by("zh", F.coalesce("chunk", F.lit(-1))).alias("zh"))
    pseudo = columns.pseudo_blocks(lines, merged, zh, blocks.where("rot is not null"))
    jsonio.write_layer(pseudo.where("zh is not null"), f"{out}/layer", PSEUDO)
    jsonio.write_extracts(columns.split_blocks(blocks, pseudo), f"{out}/extracts")
    return 0


def _build(spark, engine, opts, extracts: str, trans: str, out: str) -> int:
    fixes = jsonio.read_fixes(spark, opts.fixes)
    blocks = engine.prepare(jsonio.read_extracts(spark, extracts), fixes, tuple(opts.drop))
    layers = _translations(spark, trans).select("doc", "id", "zh", F.coalesce("chunk", F.lit(0)).alias("priority"))
    layers = layers.unionByName(jsonio.read_translations(spark, trans, pseudo=True).where("not bad and id is not null").select("doc", "id", "zh", F.lit(2**31 - 1).alias("priority")))
    if opts.layer:
        layers = layers.unionByName(jsonio.read_layers(spark, opts.layer, [PSEUDO]).withColumn("priority", F.lit(2**31 - 1)))
    table = spark.read.parquet(opts.recurring) if opts.recurring else spark.createDataFrame([], "doc string, norm_key string, template string")
    actions = engine.build(blocks, table, layers, fixes["overrides"], tuple(opts.drop))
    # the write itself counts
    seen = Observation("actions")
    counted = actions.observe(seen, *[F.count_if(F.col("action") == a).alias(a) for a in overlay.ACTIONS])
    counted.write.mode("overwrite").parquet(f"{out}/actions")
    actions = spark.read.parquet(f"{out}/actions")
    overlay.redactions(blocks, actions).write.mode("overwrite").parquet(f"{out}/redactions")
    engine.draw(blocks, actions).write.mode("overwrite").parquet(f"{out}/draw")
    for action, n in sorted(seen.get.items()):
        if n:
            print(action, n)
    return 0


def _qa(spark, engine, opts, spans: str) -> int:
    rows = spark.read.parquet(spans)
    report = engine.check(rows, tuple(opts.allow))
    if opts.footer:
        # the lowest text of a page is its foot
        feet = rows.groupBy("doc", "page").agg(F.max_by("text", F.struct("y1", "ord")).alias("text"))
        bad = qa.bad_footers(feet, opts.footer, engine.cfg).groupBy("doc").agg(F.count("*").alias("n_footer"))
        report = report.join(bad, "doc", "left").withColumn("n_footer", F.coalesce("n_footer", F.lit(0).cast("long"))).withColumn("passed", F.col("passed") & (F.col("n_footer") == 0))
    return _verdict(report)


def _coverage(spark, engine, opts, cells: str, source: str, target: str) -> int:
    return _verdict(qa.cell_coverage(*(spark.read.parquet(x) for x in (cells, source, target)), engine.cfg, whole=True))


def _pick(spark, engine, opts, marks: str, out: str) -> int:
    scores = qa.page_scores(spark.read.parquet(marks))
    jsonio.write_json_report(qa.with_pages(qa.page_pick(scores, opts.pages, engine.cfg), scores, opts.also), out)
    return 0


def _verdict(report: DataFrame) -> int:
    """Print the rows that fail, 20 at most; nothing to check is a failure too.  One job: the rows are counted on their way."""
    seen = Observation("verdict")
    keys = [F.to_json(F.struct(*report.columns))]
    failed = report.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("passed")).alias("failed")).where("not passed").orderBy(*keys).limit(20).collect()
    for row in failed:
        print(row.asDict())
    if (n := seen.get["failed"]) > len(failed):
        print(f"{n} rows fail")
    return int(bool(failed) or not seen.get["rows"])


if __name__ == "__main__":
    sys.exit(main())
