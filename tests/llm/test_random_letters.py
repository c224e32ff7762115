"""Random strings without digits."""

import random
import string

import pytest

from folio.llm import queries, secret_scan


@pytest.mark.parametrize(("alphabet", "least"), [(string.ascii_letters, 0.98), (string.ascii_letters + "+/", 0.98), (string.ascii_uppercase, 0.95), (string.ascii_lowercase, 0.88), (string.ascii_letters + string.digits, 0.98)])
@pytest.mark.parametrize("size", [16, 20, 40])
def test_random_strings_are_found(alphabet, least, size):
    encode = secret_scan.encoding(queries.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    rng = random.Random(6)
    keys = ["".join(rng.choices(alphabet, k=size)).encode() for _ in range(500)]
    assert sum(secret_scan.is_random(x, encode, 2.0) for x in keys) >= least * len(keys)


@pytest.mark.parametrize("clean", ["internationalisation", "Rechtsschutzversicherungen", "RESPONSIBILITIES", "getElementsByTagName", "some/path/of/words", "a/b/c/d/e/f/g/h/i", "----------------", "eineinkeitkeitge", "1234567890123456"])
def test_words_are_not(clean):
    encode = secret_scan.encoding(queries.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    assert not secret_scan.is_random(clean.encode(), encode, 2.0)
