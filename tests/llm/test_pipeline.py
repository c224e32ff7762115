"""The pipeline's stages against brute force, each on its own input."""

import zlib

import brute
import corpus_pipeline

from folio.llm import langid
from folio.llm.store import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        pairs = [(i, r.text) for i, r in before.items()]
        docs = saved(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
            assert all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            want = {r[0]: r[3] for r in brute.lines(pairs)}
            assert all(brute.sha(r.text) == want[i] and r.n_chars == len(r.text) for i, r in after.items())
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute.components(pairs, corpus_pipeline.NEAR_PERCENT).items() if i == c}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in brute.contamination(pairs, items) if not r[5]}
        else:
            assert set(after) == set(before)


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in entry.queries() if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert entry.queries()["pipeline"](spark, sf).count() > 0


def test_labels_with_long_rows_alone_are_learned(spark):
    docs = [(i, "the cat and the dog of the house", "en") for i in range(9)] + [(i, "der hund und die katze im haus " * i, "de") for i in range(900, 930)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = langid.training_rows(frame, 120, 300).collect()
    assert sorted({r.lang for r in rows}) == ["de", "en"] and [len(r.text) for r in rows if r.lang == "de"] == [min(len(t) for i, t, x in docs if x == "de" and not held(i))]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_run_of_nothing(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
