import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, keep string, n_lines int, sequence_id string, root int, c0 string"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards mix quite odd potions of jade vivid zinc"
LONG = " ".join(f"{SENTENCE} {i}" for i in range(4000))


def rows():
    """Nulls in every column, empty, blank, symbols only, very long, repeated rows, repeated ids, null ids."""
    texts = [(1, SENTENCE + "\nCommon line"), (1, SENTENCE + "\nCommon line"), (2, None), (3, ""), (4, " \t "), (5, "!!! ... 123"), (6, LONG), (7, LONG + " tail"), (None, SENTENCE), (None, None), (8, "eins zwei"), (9, "eins zwei"),
             (9, "drei vier fünf sechs sieben acht"), (10, "\n\n"), (11, "日本語 のテキスト"), (12, "…—"), (13, "x" * 3000), (14, "a\x00b c\x01d")]
    texts += [(100 + i, f"word{i} common tail here\nCommon line  \n") for i in range(12)]
    return [(i, t, None if (i or 0) % 3 == 0 else ("de" if t and "eins" in t else "en"), None, None if t is None else len(t), "k", None, 5, "s", 1, "c") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
