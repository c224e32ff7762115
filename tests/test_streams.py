"""Versions and chained streams: replays, restarts in the middle, gaps, readers during writes."""

import threading

import pytest
from pyspark.sql import functions as F

from folio.sources import jsonio, versions
from folio.streaming import chain

ROW = "doc string, id string, zh string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def values(frame):
    return {(r.doc, r.id): r.zh for r in frame.collect()}


def test_upserts_and_pinned_readers(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), buckets=3)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.upsert(rows(spark, ("a", "1", "x"), ("b", "1", "y")), ("s", 0)) == 1
    old = table.read(1)
    lazily = old.select("zh")
    assert table.upsert(rows(spark, ("a", "1", "new"), ("c", "9", "z")), ("s", 1)) == 2
    assert values(table.read()) == {("a", "1"): "new", ("b", "1"): "y", ("c", "9"): "z"}
    # a replay changes nothing; a reader of the first version still sees it
    assert table.upsert(rows(spark, ("a", "1", "x"), ("b", "1", "y")), ("s", 0)) == 2 and table.upsert(rows(spark, ("d", "1", "q")), ("s", 1)) == 2
    assert values(old) == {("a", "1"): "x", ("b", "1"): "y"} and sorted(r.zh for r in lazily.collect()) == ["x", "y"]
    # folders of parts that a write does not touch are the same
    one, two = table.manifest(1).parts, table.manifest(2).parts
    assert {p for p in one if one[p] == two[p]} == {p for p in one if p not in {r.part for r in rows(spark, ("a", "1", ""), ("c", "9", "")).select(table._part().alias("part")).collect()}}
    assert table.overwrite(rows(spark, ("e", "1", "only"))) == 3 and values(table.read()) == {("e", "1"): "only"}
    table.clean(keep=2)
    assert table.versions() == [2, 3] and values(table.read(2))[("a", "1")] == "new"


def test_writers_at_once(spark, tmp_path):
    """Both writers' rows are there: the one who was slower writes again on what the other left."""
    table = versions.VersionedTable(spark, str(tmp_path / "t"), buckets=1)
    table.upsert(rows(spark, ("a", "0", "start")))
    meet = threading.Barrier(2)
    written = table._written

    def together(frame):
        found = written(frame)
        try:
            meet.wait(6)
        except threading.BrokenBarrierError:
            pass  # the second try of the slower one
        return found

    table._written = together
    work = [threading.Thread(target=table.upsert, args=(rows(spark, ("a", str(i), f"w{i}")),)) for i in (1, 2)]
    for w in work:
        w.start()
    meet_again = threading.Timer(60, meet.abort)
    meet_again.start()
    for w in work:
        w.join()
    meet_again.cancel()
    assert values(table.read()) == {("a", "0"): "start", ("a", "1"): "w1", ("a", "2"): "w2"} and table.versions() == [1, 2, 3]


def test_stream_into_versions(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), by="layer", buckets=2)
    kind = "layer string, " + ROW
    source = str(tmp_path / "in")
    put = lambda *data: spark.createDataFrame(list(data), kind).coalesce(1).write.mode("append").parquet(source)
    run = lambda: versions.upsert_stream(spark.readStream.schema(kind).parquet(source), table, "s", str(tmp_path / "mark")).awaitTermination()
    put(("c01", "a", "1", "x"), ("c02", "a", "1", "other"))
    run()
    put(("c01", "a", "1", "y"), ("c01", "a", "1", "b"))
    run()
    assert {(r.layer, r.zh) for r in table.read().collect()} == {("c01", "y"), ("c02", "other")}
    assert {r.zh for r in table.read(only=["c02"]).collect()} == {"other"} and table.manifest().batches == {"s": 1}
    run()
    assert table.versions() == [1, 2]


def test_layers_are_versioned(spark, tmp_path):
    path = str(tmp_path / "layers")
    jsonio.write_layer(rows(spark, ("d", "b", "old")), path, "c00")
    before = jsonio.read_layers(spark, path, ["c00", "cZZ"])
    jsonio.write_layer(rows(spark, ("d", "b", "split")), path, "cZZ")
    jsonio.write_layer(rows(spark, ("d", "c", "base")), path, "c00")
    assert [(r.id, r.zh, r.priority) for r in before.collect()] == [("b", "old", 1)]
    assert sorted((r.id, r.zh, r.priority) for r in jsonio.read_layers(spark, path, ["c00", "cZZ"]).collect()) == [("b", "split", 2), ("c", "base", 1)]


def step(texts, carried):
    """Each text behind the last text of the chunk before."""
    return [f"{carried}>{t}" for t in texts], texts[-1]


def test_chain_goes_on_in_the_middle(spark, tmp_path):
    """Chunks arrive in three runs, early, twice and with one missing; every run goes on from the checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    items = lambda *data: spark.createDataFrame(list(data), "doc string, chunk int, ord int, id string, text string")
    schema = chain.chunk_rows(items()).schema

    def run(*data, **options):
        chain.chunk_rows(items(*data)).coalesce(1).write.mode("append").parquet(source)
        chain.run_chain(spark.readStream.schema(schema).parquet(source), step, out, str(tmp_path / "mark"), **options).awaitTermination()
        return {(r.doc, r.chunk, r.id): (r.zh, r.after_gap) for r in spark.read.parquet(out).collect()}

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        got = run(("d", 0, 1, "b", "two"), ("d", 0, 0, "a", "one"), ("d", 2, 0, "e", "early"), ("x", 0, 0, "a", "other"), patience_ms=10_000_000)
        assert got == {("d", 0, "a"): (">one", False), ("d", 0, "b"): (">two", False), ("x", 0, "a"): (">other", False)}
        got = run(("d", 1, 0, "c", "three"), ("d", 0, 0, "a", "again"), patience_ms=10_000_000)
        assert got[("d", 1, "c")] == ("two>three", False) and got[("d", 2, "e")] == ("three>early", False) and len(got) == 5
        # chunk 1 of x never comes
        run(("x", 2, 0, "z", "late"), patience_ms=0)
        got = run(("d", 3, 0, "f", "last"), patience_ms=0)
        assert got[("d", 3, "f")] == ("early>last", False) and got[("x", 2, "z")] == ("other>late", True)
        assert spark.read.parquet(out).count() == len(got) == 7
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
