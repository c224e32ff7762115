"""Near copies of 0.80 to below 0.85, which the pipeline's stage has to find."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from test_contracts import assert_owned_once

from folio.llm import near_dedup


def pairs_between():
    rng, out = random.Random(8), []
    while len(out) < 160:
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        own = list(base)
        for _ in range(rng.choice((2, 3, 4))):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        a, b = brute.shingles(" ".join(base)), brute.shingles(" ".join(own))
        if 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b):
            out += [(len(out), " ".join(base)), (len(out) + 1, " ".join(own))]
    return out


@pytest.mark.parametrize("rows", [1, 1024])
def test_stage_links_pairs_from_eighty_percent(spark, rows, monkeypatch):
    docs = pairs_between()
    want = {i for i, (_, c) in brute.components(docs, 80).items() if i == c}
    assert len(want) == len(docs) // 2 and len(brute.components(docs)) == len(docs)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame, "").collect()} == want


def test_wide_keys_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    radius, edges = near_dedup.reach(80)
    assert radius // (len(edges) - 1) == 1 and near_dedup.reach(85)[0] == near_dedup.RADIUS
    a = rng.integers(0, 65536, (500, near_dedup.HASHES)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.HASHES, radius, replace=False)] ^= 1
    assert_owned_once(a, b, edges, radius)
