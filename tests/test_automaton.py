"""Many terms in one pass give what the operators for few terms give."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import automaton as A
from folio.functions import text as T
from folio.operators import canonical, qa, terms


@pytest.mark.parametrize(("text", "spans"), [
    ("steel beam", [(0, 10, "steel beam")]), ("steel beams", [(0, 5, "steel")]), ("a steel.", [(2, 7, "steel")]), ("steelé", []), ("stee", []), ("beam beam", [(0, 4, "beam"), (5, 9, "beam")]),
    ("beam of steel beam", [(0, 13, "beam of steel"), (14, 18, "beam")]), ("_beam", []), ("Fig. 3", [(0, 4, "Fig.")]), ("Fig.3", [(0, 4, "Fig.")]), ("", []),
])
def test_leftmost_longest_words(text, spans):
    assert A.Terms(dict.fromkeys(["steel", "beam", "steel beam", "beam of steel", "Fig."])).spans(text) == spans


def test_same_as_word_by_word(spark):
    """Glossaries whose words do not touch each other: the automaton and nested replacements agree, borders of all scripts included."""
    rng = random.Random(3)
    letters = ["ab", "é", "ñ", "q3", "_", "日", "x́", "½", "-", " ", ".", "\n", "9", "‍", "²"]
    texts = ["".join(rng.choices(letters, k=25)) for _ in range(400)] + [None, ""]
    words = {"ab": "A", "é": "E$1", "日": "\\D", "q3": "Q"}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(A.replace_terms(F.col("text"), A.Terms(words)).alias("a"), T.replace_words(F.col("text"), words).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_thousands_of_terms(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    glossary = {w: w.upper() for w in words}
    texts = [" ".join(rng.choices([*words, "other", "and"], k=40)) for _ in range(200)]
    rows = spark.createDataFrame([(1, str(i), t) for i, t in enumerate(texts)], "doc int, id string, text string")
    found = terms.apply_glossary(rows, A.Terms(glossary))
    assert [r.text for r in found.collect()] == [" ".join(glossary.get(w, w) for w in t.split()) for t in texts]
    table = spark.createDataFrame(list(glossary.items()), "term string, zh string")
    assert A.from_table(table, to="zh").terms == A.Terms(glossary).terms
    with pytest.raises(ValueError, match="more than 10"):
        A.from_table(table, most=10)
    marks = terms.marked_terms(rows, A.from_table(table)).collect()
    assert len(marks) == sum(w in glossary for t in texts for w in t.split()) and all(texts[int(m.id)][m.start : m.end] == m.term for m in marks)


def drift_by_plan(texts, variants):
    rest = {v: F.regexp_replace("text", "|".join(T._quoted(s) for s in legal), "") if legal else F.col("text") for v, legal in variants.items()}
    hits = F.array_compact(F.array(*[F.when(c.contains(v), F.lit(v)) for v, c in rest.items()]))
    return texts.select("doc", "id", F.explode(hits).alias("variant"))


def test_drift_is_the_same(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("enti.$", k=12)) for _ in range(500)]
    rows = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "doc string, id string, text string")
    variants = {"en": ("ten", "ent.", "e$"), "ti": (), "nn": ("n.n",), "i$": ("ti$", "ni")}
    assert sorted(map(tuple, terms.drift(rows, variants).collect())) == sorted(map(tuple, drift_by_plan(rows, variants).collect()))
    many = {f"e{i}": (f"te{i}",) for i in range(3000)}
    rows = spark.createDataFrame([("d", "a", "e17 te18 e2999"), ("d", "b", "te5 e5")], "doc string, id string, text string")
    # e1 and e2 are in e17, e18 and e29
    assert {(r.id, r.variant) for r in terms.drift(rows, many).collect()} >= {("a", "e17"), ("a", "e2999"), ("b", "e5")} and not any(r.variant == "e18" for r in terms.drift(rows, many).collect())


def test_large_rule_books_resolve_as_small_ones(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("d", k, t, t, s, 3, i) for i, (k, t, s) in enumerate([("Nicht.", "Nicht.", "Nicht."), ("", "⟦N0⟧", "#"), ("Zz", "Zz here", "Zz here"), ("R", "Released under the x", "Released under the x"), ("T", "The end of the day", "The end of the day"),
         ("U", "USA the", "USA the"), ("L", "Les.", "Les."), ("D", "De x", "De x"), ("O", "On the table of Os", "On the table of Os"), ("n", "12", "12"), ("k", None, None), ("C", "Ca+b (x) the", "Ca+b (x) the")])],
        "doc string, norm_key string, text string, template string, sig string, n long, seen long")
    book = canonical.RuleBook(canonical.SAMPLE.signatures, (*canonical.SAMPLE.patterns, (r"Ca\+b", {"the": "T", "T": "(t)", "(x)": "y$"})), canonical.SAMPLE.identity, canonical.SAMPLE.identity_prefix, canonical.SAMPLE.skip)
    small = sorted(map(tuple, canonical.resolve(rows, book).collect()), key=str)
    monkeypatch.setattr(canonical, "PLAN_RULES", 0)
    assert sorted(map(tuple, canonical.resolve(rows, book).collect()), key=str) == small
    monkeypatch.undo()
    many = canonical.RuleBook({f"sig {i} #": f"zh{i} # #" for i in range(3000)}, tuple((f"^word{i} ", {"word": "w", "x": str(i)}) for i in range(3000)), identity_prefix="^$")
    rows = spark.createDataFrame([("d", "a", "", "sig 7 ⟦N0⟧", "sig 7 #", 3, 0), ("d", "b", "", "word29 x", "word29 x", 3, 1), ("d", "c", "", "word2999 x y", "word2999 x y", 3, 2), ("d", "e", "other", "other", "other", 3, 3)], "doc string, norm_key string, text string, template string, sig string, n long, seen long")
    assert {r.norm_key: (r.rule, r.zh) for r in canonical.resolve(rows, many).collect()} == {"a": ("signature", "zh7 ⟦N0⟧ ⟦N1⟧"), "b": ("pattern29", "word29 29"), "c": ("pattern2999", "word2999 2999 y"), "e": ("missing", None)}


def test_allowed_phrases(spark):
    rows = spark.createDataFrame([("d", 1, 0, "保留 Acme Steel Works 和 Steel")], "doc string, page int, ord int, text string")
    none = spark.createDataFrame([], "word string")
    found = lambda phrases: sorted(r.word for r in qa.residual_language(rows, "[A-Za-z]{3,}", none, phrases).collect())
    assert found(None) == ["Acme", "Steel", "Works"] and found(A.Terms({"Acme Steel Works": None})) == ["Steel"]


def test_drift_takes_longer_forms_out_one_after_the_other(spark):
    """Forms that overlap: without ``ten`` the text holds another ``ment``."""
    rows = spark.createDataFrame([(1, "a", "la lementention."), (1, "b", "mtenent"), (1, "c", "mentenen"), (1, "d", "xtenytenx")], "doc int, id string, text string")
    assert sorted((r.id, r.variant) for r in terms.drift(rows, {"en": ("ten", "ment"), "xy": ("ten",)}).collect()) == [("c", "en"), ("d", "xy")]
