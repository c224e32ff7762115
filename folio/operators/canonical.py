"""Rule-driven replacement of recurring texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import automaton as A
from ..functions import text as T


@dataclass(frozen=True)
class RuleBook:
    """A project's rules: exact signatures, ordered patterns (null words: keep as is), identities and skips."""

    signatures: dict[str, str] = field(default_factory=dict)
    patterns: tuple[tuple[str, dict[str, str] | None], ...] = ()
    identity: tuple[str, ...] = ()
    identity_prefix: str = "^$"
    skip: tuple[str, ...] = ()


#: A small neutral book for tests and queries.
SAMPLE = RuleBook(
    signatures={"#": "#", "The.": "Der."},
    patterns=((r"^Released under", {"Released": "Veröffentlicht", "under": "unter"}), (r"^[A-Z]{2,}", None), (r"^(Th|On|An)", {"the": "der", "of": "von"})),
    identity=("Les.",), identity_prefix=r"^(De|La) ", skip=("Nicht.",))


def read_rules(spark: SparkSession, path: str) -> RuleBook:
    """A project's book from a JSON file: ``signatures``, ``patterns`` (pairs of pattern and words or null), ``identity``, ``identity_prefix``, ``skip``."""
    x = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return RuleBook(x.get("signatures", {}), tuple((p, w) for p, w in x.get("patterns", [])), tuple(x.get("identity", [])), x.get("identity_prefix", "^$"), tuple(x.get("skip", [])))


#: Rules and words that a plan holds as ``CASE`` arms and nested replacements; larger books run as one function.
PLAN_RULES = 64


def _renumbered(zh: str) -> str:
    """A signature's fixed text, its ``#`` numbered again."""
    pieces = zh.split("#")
    return pieces[0] + "".join(f"⟦N{i}⟧{p}" for i, p in enumerate(pieces[1:]))


def _planned(norm_key: Column, sig: Column, template: Column, book: RuleBook) -> Column:
    rule, zh = F.when(norm_key.isin(*book.skip), "skip"), F.when(norm_key.isin(*book.skip), F.lit(None).cast("string"))
    for s, to in book.signatures.items():
        rule, zh = rule.when(sig == s, "signature"), zh.when(sig == s, F.lit(_renumbered(to)))
    for i, (pattern, words) in enumerate(book.patterns):
        found = sig.rlike(f"^(?:{pattern})")
        rule, zh = rule.when(found, f"pattern{i}"), zh.when(found, template if words is None else T.replace_words(template, words))
    return F.struct(rule.alias("rule"), zh.alias("zh"))


class _Book:
    """A rule book as a function of one template; built once a task."""

    def __init__(self, book: RuleBook):
        self.skip, self.signatures = set(book.skip), {s: _renumbered(zh) for s, zh in book.signatures.items()}
        self.words = [w for _, w in book.patterns]
        # plain beginnings are looked up by length; the rest is tried in order up to the best plain one
        plain = [re.fullmatch(r"\^?([\w\s]*)", p) for p, _ in book.patterns]
        self.begins: dict[str, int] = {}
        for i, m in enumerate(plain):
            if m:
                self.begins.setdefault(m[1], i)
        self.lengths = sorted({len(b) for b in self.begins})
        self.others = [(i, re.compile(f"(?:{p})")) for i, (p, _) in enumerate(book.patterns) if not plain[i]]

    def first(self, sig: str) -> int | None:
        best = min((self.begins[sig[:n]] for n in self.lengths if sig[:n] in self.begins), default=None)
        for i, pattern in self.others:
            if best is not None and i > best:
                break
            if pattern.match(sig):
                return i
        return best

    def answer(self, norm_key: str | None, sig: str | None, template: str | None) -> dict[str, str | None]:
        if norm_key in self.skip:
            return {"rule": "skip", "zh": None}
        if sig in self.signatures:
            return {"rule": "signature", "zh": self.signatures[sig]}
        at = None if sig is None else self.first(sig)
        if at is None:
            return {"rule": None, "zh": None}
        return {"rule": f"pattern{at}", "zh": template if template is None or self.words[at] is None else replaced_in_order(template, self.words[at])}


def replaced_in_order(text: str, words: dict[str, str]) -> str:
    """``text.replace_words`` for one text: whole words, one after the other."""
    for word, to in words.items():
        if word in text:
            text = A.Terms({word: to}).replaced(text)
    return text


def _run(norm_key: Column, sig: Column, template: Column, book: RuleBook) -> Column:
    kind = pa.struct([("rule", pa.string()), ("zh", pa.string())])

    def run(keys: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = _Book(book)
        for cols in keys:
            yield pa.array([own.answer(*r) for r in zip(*(c.to_pylist() for c in cols), strict=True)], kind)

    return F.arrow_udf(run, "struct<rule:string,zh:string>")(norm_key, sig, template)


def resolve(rows: DataFrame, book: RuleBook = SAMPLE) -> DataFrame:
    """``doc, norm_key, n, seen, sig, text, zh, rule`` for templates; ``zh`` is null where no rule answers.

    The order is fixed: skipped key, signature, first pattern, identity prefix, identity, text with
    no Latin word or symbols only.  Small books are a short ``CASE``, which stops at the first match;
    larger ones one function, so that the plan does not grow with them.  Their patterns have to mean
    the same to Python and Java.
    """
    size = len(book.signatures) + len(book.patterns) + sum(len(w or ()) for _, w in book.patterns)
    answer = (_planned if size <= PLAN_RULES else _run)(F.col("norm_key"), F.col("sig"), F.col("template"), book)
    rows = rows.withColumn("answer", answer)
    rule, zh, sig = F.col("answer.rule"), F.col("answer.zh"), F.col("sig")
    same = rule.isNull() & (sig.rlike(book.identity_prefix) | sig.isin(*book.identity) | ~sig.rlike("[A-Za-z]{2,}") | T.is_symbolic(F.col("text"), runs=True))
    return rows.select("doc", "norm_key", "n", "seen", "sig", "text", F.when(same, F.col("template")).otherwise(zh).alias("zh"), F.when(same, "identity").otherwise(F.coalesce(rule, F.lit("missing"))).alias("rule"))


def missing_signatures(resolved: DataFrame) -> DataFrame:
    """``doc, sig, sample``: unanswered signatures, each once over all documents, with the first text seen."""
    first = Window.partitionBy("sig").orderBy("doc", "seen")
    rows = resolved.where("rule = 'missing'").withColumn("r", F.row_number().over(first)).where("r = 1")
    return rows.select("doc", "sig", F.left("text", F.lit(70)).alias("sample"))
