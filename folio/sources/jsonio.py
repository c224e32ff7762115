"""Readers and writers of the engine's JSON documents: extracts, chunks, translations, tables, configs."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import VersionedTable

BLOCK = "struct<ord:int,id:string,text:string,bbox:array<double>,size:double,bold:boolean,italic:boolean,color:int,align:string,nlines:int,line_ys:array<double>,line_x0s:array<double>,line_ws:array<double>,line_hs:array<double>,rot:int,keep:boolean>"
EXTRACT = f"doc string, source string, npages int, table_cont_pages array<int>, pages array<struct<page:int,blocks:array<{BLOCK}>>>"
CHUNK = "doc string, chunk int, title string, pages array<int>, context_before string, context_after string, first_abbrevs array<string>, items array<struct<id:string,page:int,text:string>>"


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    return flatten_extracts(spark.read.schema(EXTRACT).json(path, multiLine=True))


def flatten_extracts(docs: DataFrame) -> DataFrame:
    """One row a block; ``ord`` is the block's, or else its place in the document."""
    whole = F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: F.struct(p["page"].alias("page"), b.alias("b")))))
    pages = docs.select("doc", F.posexplode(whole).alias("place", "x")).select("doc", "place", "x.page", "x.b")
    at = lambda i: F.try_element_at("b.bbox", F.lit(i))
    return pages.select("doc", "page", F.coalesce("b.ord", "place").alias("ord"), "b.id", "b.text", "b.size", "b.bold", "b.italic", "b.color", "b.align", "b.nlines",
                        at(1).alias("x0"), at(2).alias("y0"), at(3).alias("x1"), at(4).alias("y1"), "b.line_ys", "b.line_x0s", "b.line_ws", "b.line_hs", "b.rot", F.coalesce("b.keep", F.lit(False)).alias("keep"))


def as_extracts(blocks: DataFrame) -> DataFrame:
    """Blocks as one extract a document, passed through JSON text."""
    b = F.struct("ord", "id", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "size", "bold")
    pages = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(b)).alias("blocks"))
    docs = pages.groupBy("doc").agg(F.max("page").alias("npages"), F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))
    text = docs.select("doc", F.to_json(F.struct("npages", "pages")).alias("j"))
    return text.select("doc", F.from_json("j", EXTRACT).alias("x")).select("doc", "x.npages", "x.table_cont_pages", "x.pages")


def read_chunks(spark: SparkSession, glob: str) -> DataFrame:
    """``doc, chunk, title, ..., id, page, text`` with the file's name."""
    rows = spark.read.schema(CHUNK).json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return rows.select("file", "doc", "chunk", "title", "pages", "context_before", "context_after", "first_abbrevs", F.posexplode("items").alias("ord", "i")).select("*", "i.id", "i.page", "i.text").drop("i")


def read_translations(spark: SparkSession, glob: str, pseudo: bool = False) -> DataFrame:
    """``doc, chunk, id, zh, bad`` of translation maps named ``doc_cNN.json``; ``_cZZ`` files only if asked for.

    A malformed file is one row with ``bad`` true.
    """
    raw = spark.read.text(glob, wholetext=True).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("label"))
    raw = raw.where(F.col("label").endswith("_cZZ") == F.lit(pseudo))
    rows = raw.select("label", F.from_json("value", "map<string,string>").alias("m"))
    doc, chunk = F.regexp_extract("label", "^(.*)_c([^_]*)$", 1), F.regexp_extract("label", "^(.*)_c([^_]*)$", 2)
    return rows.select(doc.alias("doc"), F.when(chunk.rlike("^[0-9]+$"), chunk).cast("int").alias("chunk"), F.col("m").isNull().alias("bad"), F.explode_outer("m").alias("id", "zh"))


def write_chunks(items: DataFrame, path: str) -> None:
    """Chunk items partitioned by document; only the documents written are replaced."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(path)


def write_extracts(blocks: DataFrame, path: str) -> None:
    """One extract a document as a line of JSON, characters as they are."""
    b = F.struct("ord", "id", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), *[c for c in ("size", "bold", "italic", "color", "align", "nlines", "line_ys", "line_x0s", "line_ws", "line_hs", "rot", "keep") if c in blocks.columns])
    pages = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(b)).alias("blocks"))
    docs = pages.groupBy("doc").agg(F.max("page").alias("npages"), F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))
    docs.select(F.to_json(F.struct("doc", "npages", "pages")).alias("value")).write.mode("overwrite").text(path)


def read_recurring(spark: SparkSession, path: str) -> DataFrame:
    """``doc, norm_key, template`` of a JSON document that maps documents to keys and templates."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return raw.select(F.explode("m").alias("doc", "t")).select("doc", F.explode("t").alias("norm_key", "template"))


def write_recurring(table: DataFrame, path: str) -> None:
    """A line of JSON a document, which ``read_recurring`` reads."""
    per = table.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm_key", "template")))).alias("t"))
    per.select(F.to_json(F.create_map(F.col("doc").cast("string"), "t")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def layers(spark: SparkSession, path: str) -> VersionedTable:
    """The versioned table of translation layers under ``path``."""
    return VersionedTable(spark, path, ("doc", "id"), by="layer")


def write_layer(rows: DataFrame, path: str, layer: str) -> int:
    """Translations ``doc, id, zh`` as the whole of a layer from now on: a new version, in which no other layer is touched."""
    return layers(rows.sparkSession, path).overwrite(rows.select("doc", "id", "zh", F.lit(layer).alias("layer")), layer)


def read_layers(spark: SparkSession, path: str, order: list[str], version: int | None = None) -> DataFrame:
    """``doc, id, zh, priority`` of layers, later names in ``order`` before earlier ones; the last version, or a given one."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer")).cast("int")
    return layers(spark, path).read(version, only=order).select("doc", "id", "zh", rank.alias("priority"))


def write_missing(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def read_config(path: str) -> dict:
    """A small driver-side JSON file; missing is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _entries(v: Column, kind: str) -> Column:
    """Entries of a JSON object whose values are of ``kind``; none where it is missing."""
    return F.map_entries(F.coalesce(F.try_variant_get(v, "$", f"map<string,{kind}>"), F.expr(f"cast(map() as map<string,{kind}>)")))


def fixes_of(registry: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """Fix registries (JSON objects by document) as tables: ``overrides``, ``splits``, ``drops``, ``prefixes`` and ``shifts``.

    Values that may be of two kinds (an override is a text or ``{append}``, a split one line or a
    list of them) are taken apart as variants, in tasks.  Malformed JSON fails the job.
    """
    part = lambda v, name, kind: F.try_variant_get(v, f"$.{name}", kind)
    docs = registry.select(F.explode(_entries(F.parse_json(F.col(column)), "variant")).alias("e")).select(F.col("e.key").alias("doc"), F.col("e.value").alias("x"))
    by_id = lambda name, kind: docs.select("doc", F.explode(_entries(part(F.col("x"), name, "variant"), kind)).alias("e")).select("doc", F.col("e.key").alias("id"), F.col("e.value").alias("v"))
    listed = lambda name, to: docs.select("doc", F.explode(part(F.col("x"), name, "array<string>")).alias(to))
    over = by_id("trans_overrides", "variant")
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    lines = by_id("line_splits", "variant")
    lines = lines.select("doc", "id", F.explode(F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))).alias("s"))
    fields = [part(F.col("s"), c, k).alias(c) for c, k in (("line", "int"), ("new_id", "string"), ("size", "double"), ("color", "int"), ("dy", "double"))]
    return {
        "overrides": over.select("doc", "id", text.alias("set_to"), part(F.col("v"), "append", "string").alias("append")),
        "splits": lines.select("doc", "id", *fields),
        "drops": listed("drop_ids", "id"), "prefixes": listed("drop_prefixes", "prefix"),
        "shifts": by_id("lys_shift", "array<double>").select("doc", "id", F.col("v").alias("shift")),
    }


def read_fixes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``fixes_of`` JSON files; without a path, or where nothing is there, the tables are empty."""
    try:
        return fixes_of(spark.read.text(path, wholetext=True)) if path else fix_tables(spark, {})
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fix_tables(spark, {})


def fix_tables(spark: SparkSession, fixes: dict) -> dict[str, DataFrame]:
    """``fixes_of`` a registry that the driver holds."""
    return fixes_of(spark.createDataFrame([(json.dumps(fixes),)], "value string"))
