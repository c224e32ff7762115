"""Substring dedup against a chunker that goes byte by byte, and random secrets against plain expressions."""

import random
import re

import brute
import numpy as np
import pytest

from folio.llm import bytesops, queries, secret_scan, substring_dedup

GEAR, CUT = substring_dedup._GEAR, int(substring_dedup._CUT)
cdc = lambda raw: brute.chunks(raw, GEAR, CUT, substring_dedup.MIN_CHUNK, substring_dedup.MAX_CHUNK)
COLUMNS = ("n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256")


def test_op1_is_the_plain_chunker(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.substrings(docs, cdc)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op1_substring_dedup(spark, sf).collect()} == want
    assert sum(x[2] for x in want.values()) > 10_000


def test_first_copies_and_ties(spark):
    rng = random.Random(11)
    passage = ["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (300, 90, 60)]
    docs = [(i, "".join(rng.choice([*passage, str(rng.random()) * 4, "x" * 200]) for _ in range(rng.randint(0, 7)))) for i in (5, 3, -2, 9, 40, 41, 42)]
    docs += [(1000, None), (1001, ""), (1002, passage[0]), (1003, passage[0]), (1004, passage[2]), (1005, passage[2]), (1003, passage[0])]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute.substrings(docs, cdc)
    assert len(found) == len(docs) and all(tuple(r[c] for c in COLUMNS) == want[r.doc_id] for r in found)
    assert want[1005][2] == 0 and want[1003][2] == 300  # below min_run; the first copy is elsewhere


@pytest.mark.parametrize("seed", range(6))
def test_chunk_ends(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 100 + seed, rng.integers(0, 900)).astype(np.uint8)).decode() for _ in range(12)] + ["", "y" * 700]
    monkeypatch.setattr(bytesops, "SLICE", 100)
    _, raw, starts = next(bytesops.slices(texts))
    found = [[z - int(a) for z in ends] for a, ends in zip(starts, substring_dedup.chunk_ends(raw, starts))]
    assert found == [cdc(t.encode()) for t in texts]


def test_random_spans(spark, sf):
    """Runs and offsets by plain expressions over code points; the ratio by the operator's own test of one run."""
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    encode = secret_scan.encoding(path).encode_ordinary
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6, "é xK9vQ2mZ7pLw4RtY8sNb, \U0001f600 q8Zr3tVw1xYk5nMb7cJd9f\nzqxwvkjhgfdpbrtwzx"), (10**6 + 1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = 0
    for r in secret_scan.secret_spans(frame, path).collect():
        text = dict(docs)[r.doc_id] or ""
        want = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text) if secret_scan.is_random(m[0].encode(), encode, 2.0)]
        assert [(s.start, s.end) for s in r.spans if s.kind == "random"] == want
        found += len(want)
    assert found == 3  # those added above
