"""Terminology: n-grams, acronyms, definitions, glossaries, logs and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import automaton as A
from ..functions import grams
from ..functions import text as T


def ngrams(texts: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), stop: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """``size, gram, n``: runs of lower-case words that neither begin nor end with a stop word.

    For a bound above 1 a first job counts hashed runs, and only those that can reach it are counted by their words.
    """
    words = texts.select(F.regexp_replace(F.lower("text"), r"\P{L}+", " ").alias("w"))
    often = None
    if least > 1:
        parts = words.mapInArrow(grams.tallied(sizes, stop, least), grams.TALLY).groupBy("range").applyInArrow(grams.frequent(least), grams.MAP)
        often = texts.sparkSession.sparkContext.broadcast(grams.whole_map(parts.collect()))
    found = words.mapInArrow(grams.counted(sizes, stop, often), grams.COUNT)
    return found.groupBy("size", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def acronyms(blocks: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """``doc, acronym, n, page, ord, sample``: count and first place in the document."""
    rows = blocks.select("doc", "page", "ord", "text", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\b[A-Z]{2,}[0-9]*\b"), F.lit(0))).alias("acronym")).where(~F.col("acronym").isin(*stop))
    return rows.groupBy("doc", "acronym").agg(F.count("*").alias("n"), F.min_by("page", "ord").alias("page"), F.min("ord").alias("ord"), F.min_by(F.left("text", F.lit(40)), "ord").alias("sample"))


def definitions(blocks: DataFrame, pattern: str) -> DataFrame:
    """``doc, ord, term, meaning`` where the pattern's two groups match."""
    return blocks.where(F.col("text").rlike(pattern)).select("doc", "ord", F.regexp_extract("text", pattern, 1).alias("term"), F.regexp_extract("text", pattern, 2).alias("meaning"))


def domain_vote(texts: DataFrame, evidence: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """``doc, domain, score, tied``: weighted evidence; all best domains are returned, tied ones marked."""
    rows = [F.struct(F.lit(d).alias("domain"), sum((F.regexp_count("text", F.lit(p)) * w for p, w in pairs), F.lit(0)).cast("long").alias("score")) for d, pairs in evidence.items()]
    score = texts.select("doc", F.explode(F.array(*rows)).alias("x")).groupBy("doc", F.col("x.domain").alias("domain")).agg(F.sum("x.score").alias("score"))
    best = score.withColumn("r", F.rank().over(Window.partitionBy("doc").orderBy(F.desc("score")))).where("r = 1 and score > 0")
    return best.withColumn("tied", F.count("*").over(Window.partitionBy("doc")) > 1).drop("r")


def verified_share(glossary: DataFrame, top: int = 50, gate: float = 0.70) -> DataFrame:
    """``industry, share, passed`` of the most frequent terms."""
    w = Window.partitionBy("industry").orderBy(F.desc("n"), "term")
    rows = glossary.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return rows.groupBy("industry").agg(F.avg((F.col("tier") == "verified").cast("double")).alias("share")).withColumn("passed", F.col("share") >= gate)


def merge_glossary(library: DataFrame, new: DataFrame) -> DataFrame:
    """The library and those new terms that it lacks in their industry."""
    return library.unionByName(new.join(library.select("industry", "term").distinct(), ["industry", "term"], "left_anti").select(*library.columns))


def best_terms(glossary: DataFrame) -> DataFrame:
    """One row a term: verified before consistent before original, then the better source, then the text."""
    tier = F.when(F.col("tier") == "verified", 0).when(F.col("tier") == "consistent", 1).otherwise(2)
    w = Window.partitionBy("industry", "term").orderBy(tier, "source_rank", "zh")
    return glossary.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def conflicts(log: DataFrame) -> DataFrame:
    """``doc, term, first, n_variants`` of terms that lanes translated differently; the first seen wins."""
    rows = log.groupBy("doc", "term").agg(F.min_by("zh", "seq").alias("first"), F.count_distinct("zh").alias("n_variants"))
    return rows.where("n_variants > 1")


def backfill(log: DataFrame, glossary: DataFrame, least: int) -> DataFrame:
    """``term, zh, n``: frequent log terms that the glossary lacks, with the first translation seen."""
    rows = log.groupBy("term").agg(F.count("*").alias("n"), F.min_by("zh", "seq").alias("zh")).where(F.col("n") >= least)
    return rows.join(glossary.select("term").distinct(), "term", "left_anti").select("term", "zh", "n")


def drift(texts: DataFrame, variants: dict[str, tuple[str, ...]]) -> DataFrame:
    """``doc, id, variant``: forbidden variants outside their legal superstrings; one pass, however many variants."""
    return texts.select("doc", "id", F.explode(A.forbidden(F.col("text"), variants)).alias("variant"))


def marked_terms(texts: DataFrame, glossary: A.Terms) -> DataFrame:
    """``doc, id, start, end, term``: whole-word occurrences of glossary terms, longest first."""
    return texts.select("doc", "id", F.explode(A.find_terms(F.col("text"), glossary)).alias("m")).select("doc", "id", "m.*")


def apply_glossary(texts: DataFrame, glossary: A.Terms) -> DataFrame:
    """``texts`` with every glossary term as its translation."""
    return texts.withColumn("text", A.replace_terms(F.col("text"), glossary))


def modal_counts(pairs: DataFrame, verbs: dict[str, str]) -> DataFrame:
    """``verb, n_source, n_output``: how often each modal verb and its fixed translation occur."""
    rows = [F.struct(F.lit(v).alias("verb"), F.regexp_count("text", F.lit(T.word_pattern(v))).alias("a"), F.regexp_count("zh", F.lit(T.word_pattern(o))).alias("b")) for v, o in verbs.items()]
    return pairs.select(F.explode(F.array(*rows)).alias("x")).groupBy(F.col("x.verb").alias("verb")).agg(F.sum("x.a").cast("long").alias("n_source"), F.sum("x.b").cast("long").alias("n_output"))


def expand_first(items: DataFrame, meanings: dict[str, str]) -> DataFrame:
    """Items with each abbreviation spelled out in the document's first item that has it, on whatever line."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = F.col("text")
    for a, full in meanings.items():
        seen = F.coalesce(F.max(T.has_word(F.col("text"), a)).over(w), F.lit(False))
        out = F.when(~seen, F.regexp_replace(out, rf"(?s)^(.*?){T.word_pattern(a)}", f"$1{T.literal(f'{full} ({a})')}")).otherwise(out)
    return items.withColumn("text", out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """``doc, ord, style, text``: neighbouring runs of one style as one."""
    w = Window.partitionBy("doc").orderBy("ord")
    new = F.coalesce(F.lag("style").over(w) != F.col("style"), F.lit(True))
    rows = runs.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc", "island").agg(F.min("ord").alias("ord"), F.min("style").alias("style"), joined.alias("text")).drop("island")


def concat_spans(rows: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """Texts of a group in order, joined, without white space at the ends."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), sep)
    return rows.groupBy(*keys).agg(T.strip(joined).alias("text"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(None).cast("double")).otherwise(a / b)
