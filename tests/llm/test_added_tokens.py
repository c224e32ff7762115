"""Texts that hold added tokens of the tokenizer file."""

import brute
import pytest

from folio.llm import packing, queries

END = "<|endoftext|>"
TEXTS = [f"hello {END} world", END, f"{END}{END}b  {END}  c {END[:-2]}", f" {END}\n\n y", f"x {END.upper()} don't", f"日本{END}é"]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder(exact):
    encode = packing.encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    assert encode(TEXTS[0]) == [31373, 220, 50256, 995]
    assert [encode(x) for x in TEXTS] == [exact(x) for x in TEXTS]


def test_packed(spark, exact):
    docs = list(enumerate(TEXTS))
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(brute.pieces(docs, exact))
