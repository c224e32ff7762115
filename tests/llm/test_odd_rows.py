"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from conftest import rows as odd_rows
from pyspark.sql import functions as F

from folio.llm import ann, decontaminate, langid, line_dedup, near_dedup, packing, queries, secret_scan, store, substring_dedup, suffix_dedup

TEXTS = [(r[0], r[1]) for r in odd_rows()]
key = lambda t: tuple((x is not None, x) for x in t)


def same(frame, cols, want):
    assert sorted((tuple(r) for r in frame.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_lines(odd, none):
    cols = ["doc_id", "n_lines", "n_dropped", F.sha2("text", 256)]
    same(line_dedup.dedup_lines(odd), cols, brute.lines(TEXTS))
    assert line_dedup.dedup_lines(none).count() == 0


def test_contamination(spark, odd, none):
    items = [(1, " ".join(TEXTS[0][1].split()[:12])), (2, None), (3, "!!"), (4, "eins"), (5, "drei vier fünf sechs sieben acht"), (6, TEXTS[6][1][:5000]), (1, "zwei")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, near string")
    found = decontaminate.contamination(odd, bench)
    cols = ["doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0]
    same(found, cols, brute.contamination(TEXTS, items))
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


def test_suffixes(odd, none):
    same(suffix_dedup.remove_repeats(odd), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeats(TEXTS))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_chunks(odd, none):
    found = substring_dedup.dedup_substrings(odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in TEXTS)
    by = {r.doc_id: r for r in found}
    assert by[6].n_removed < by[6].n_repeated and by[6].n_repeated > 400_000 and by[7].n_removed > 400_000
    assert len({(r.n_removed, r.kept_sha256) for r in found if r.doc_id == 1}) == 1
    assert by[3].n_bytes == by[2].n_bytes == 0
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_near(odd, none):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(TEXTS)
    by = {(r.doc_id, r.n_shingles): r for r in found}
    assert sorted(r.component_id for r in found if r.doc_id in (2, 3, 4)) == [2, 3, 4]
    assert all(r.kept and r.component_id == r.doc_id for r in found if r.n_shingles == 0)
    size = len(brute.shingles(TEXTS[6][1]))
    assert by[(6, size)].component_id == 6 and by[(7, size + 1)].component_id == 6
    assert {r.component_id for r in found if r.doc_id in (8, 9) and r.n_shingles == 1} == {8}
    assert near_dedup.near_duplicates(none).count() == 0
    with pytest.raises(ValueError, match="radius"):
        near_dedup.near_duplicates(none, percent=70)


def test_one_of_each(spark, odd):
    left = near_dedup.one_of_each(odd)
    assert left.columns == odd.columns
    kept = left.collect()
    assert Counter(r.doc_id for r in kept)[1] == 1 and 7 not in {r.doc_id for r in kept} and {2, 3, 4} <= {r.doc_id for r in kept}
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    assert near_dedup.one_of_each(alone).count() == 2


def test_packing(odd, none):
    found = packing.pack(odd, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    want = brute.pieces(TEXTS, packing.encoder(queries.tokenizer_path("byte_bpe_50k.json")))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    assert packing.pack(none, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_language(odd, none):
    model = langid.train(odd)
    found = langid.identify(odd, model, ["doc_id"]).collect()
    assert len(found) == len(TEXTS)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {2, 3, 4, 5, 10, 12} <= und and not {1, 6, 7, 8, 11, 13} & und
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.identify(odd, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and not {2, 3, 4, 5, 10, 12} & {r.doc_id for r in kept.collect()}


def test_secrets(odd, none):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    found = secret_scan.secret_spans(odd, path)
    got = [(r.doc_id, *(sum(x.kind == k for x in r.spans) for k in secret_scan.KINDS[:3]), secret_scan.base_digest([x.asDict() for x in r.spans])) for r in found.collect()]
    assert sorted(got, key=key) == sorted(brute.secrets(TEXTS), key=key)
    assert secret_scan.secret_spans(none, path).count() == 0


def test_neighbours_beside_other_columns(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)], "a", 1, None, 0.5) for i in range(60)], "vec_id long, embedding array<double>, tab string, bucket int, v string, score double")
    found = ann.search(rows, rows.where("vec_id % 20 = 0"))
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 30
    assert ann.search(rows.limit(0), rows).count() == ann.search(rows, rows.limit(0)).count() == 0


def test_intermediate_tables_need_a_shared_folder():
    class Session:
        class conf:
            set_ = {"spark.master": "spark://host:7077"}
            get = staticmethod(lambda k, other=None: Session.conf.set_.get(k, other))

    with pytest.raises(ValueError, match="shares"):
        store.shared_dir(Session)
    Session.conf.set_["spark.checkpoint.dir"] = "hdfs://host/tmp/"
    assert store.shared_dir(Session) == "hdfs://host/tmp"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, odd, none, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, none):
        out = stage(spark, docs, sf)
        out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
