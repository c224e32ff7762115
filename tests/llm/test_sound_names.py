"""Names of rows and lines: texts that a fast hash confuses stay apart; copies of one payload do not move."""

import brute
import pytest
from pyspark.sql import functions as F

from folio.llm import decontaminate, line_dedup, near_dedup, store, substring_dedup, suffix_dedup, warc

# two lines that xxhash64 gives one value, whatever its seed
A = "apirhgw!prrpmuehueqmxavycfysbjya?1job~%kiptxmwznmxzsoeldbepgivny"
B = "apirhgw#prrpmuehueqmxavycfysbjya?1jh?^6uiptxmwznmxzsoeldbepgivny"


@pytest.fixture(scope="module")
def twins(spark):
    """Two rows with one id and alike-hashed texts."""
    return spark.createDataFrame([(1, A), (1, B)], "doc_id long, text string")


def test_the_lines_collide(spark):
    row = spark.range(1).select(*(F.xxhash64(*seed, F.lit(x)) for x in (A, B) for seed in ((), (F.lit("line"),)))).first()
    assert row[0] == row[2] and row[1] == row[3]


def test_lines_are_counted_apart(spark):
    docs = [(i, f"{A if i % 2 else B}\nrest {i}") for i in range(10)]
    kept = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(kept) == 10 and all(r.n_dropped == 0 and r.text == docs[r.doc_id][1] for r in kept)
    both = [(i, f"{A}\n{B}") for i in range(10)]
    assert {(r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(both, "doc_id long, text string")).collect()} == {(2, "")}


def test_rows_are_named_apart(spark, twins):
    assert twins.select(*store.row_key()).distinct().count() == 2
    assert sorted(r.kept_sha256 for r in substring_dedup.dedup_substrings(twins).collect()) == sorted(map(brute.sha, (A, B)))
    assert near_dedup.one_of_each(twins).count() == 2
    assert sorted(r.kept_sha256 for r in suffix_dedup.remove_repeats(twins).collect()) == sorted(map(brute.sha, (A, B)))
    items = spark.createDataFrame([(7, "apirhgw prrpmuehueqmxavycfysbjya 1job kiptxmwznmxzsoeldbepgivny")], "item_id long, text string")
    assert sorted(r.n_hit for r in decontaminate.contamination(twins, items).collect()) == [0, 4]


def test_copies_of_a_payload_do_not_move(spark, tmp_path):
    """One page 100,000 times: a row a task is shuffled with its payload, not one a page."""
    page = "<p>not found</p>" * 128
    pages = spark.range(100_000).repartition(4).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.lit(page).alias("html"))
    group, context = "one-payload", spark.sparkContext
    context.setJobGroup(group, group)
    try:
        warc.write_archive(pages, str(tmp_path / "a"))
        seen, found = context.statusTracker(), context._jsc.sc().statusStore()
        stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
        written = [found.lastStageAttempt(s).shuffleWriteBytes() for s in stages if seen.getStageInfo(s)]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sum(written) < 100_000 * len(page) / 20  # ids and headers alone
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == 1
    rows = warc.parsed(warc.read_archive(spark, str(tmp_path / "a"))).groupBy("record_type", "refers_to", "payload_bytes").count().collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("response", None, len(page), 1), ("revisit", 0, len(page), 99_999)], key=str)


def test_payloads_are_stored_deflated(spark, tmp_path):
    """Payloads move twice, so their size decides about disk: they move and lie deflated, and come back whole."""
    pages = spark.createDataFrame([(1, "u", "<p>line of a page</p>" * 500), (2, "u", None), (3, "u", "é")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/payloads")).selectExpr("max(length(payload)) as n").first().n < 10_500 / 20
    rows = {r.page_id: bytes(r.payload) for r in warc.parsed(warc.read_archive(spark, str(tmp_path / "d"))).collect()}
    assert rows == {1: b"<p>line of a page</p>" * 500, 2: b"", 3: "é".encode()}
