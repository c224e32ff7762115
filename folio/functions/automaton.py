"""Many terms in one pass over a text: an automaton in Arrow batches, whatever the number of terms.

Terms are found leftmost first and of those the longest, without overlap; ``whole`` asks for a word's
border beside the word characters that a term begins or ends with, as ``text.word_pattern`` does.
A glossary travels with the task as plain strings and is built once a worker process.

Terms come from the driver (a project's rules) or from a table whose size is checked (``from_table``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that a task may hold.
MOST_TERMS = 1 << 20
_MATCHES = "array<struct<start:int,end:int,term:string>>"
_built: dict[tuple, Terms] = {}


@lru_cache(maxsize=1 << 16)
def is_word(ch: str) -> bool:
    """Letters, marks, digits and connectors of all scripts, as Unicode regular expressions see them."""
    kind = unicodedata.category(ch)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or ch in "‌‍"


class Terms:
    """Terms with what takes their place (none: they are only found)."""

    def __init__(self, terms: dict[str, str | None], whole: bool = True):
        self.terms = {t: to for t, to in terms.items() if t}
        self.whole = whole

    def __reduce__(self):
        return _known, (tuple(self.terms.items()), self.whole)

    @cached_property
    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in self.terms:
            found.add_word(term, term)
        if self.terms:
            found.make_automaton()
        return found

    def all_spans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of every occurrence between borders, overlapping ones too."""
        if not self.terms:
            return
        n = len(text)
        for last, term in self._automaton.iter(text):
            end = last + 1
            start = end - len(term)
            if self.whole:
                if start and is_word(term[0]) and is_word(text[start - 1]):
                    continue
                if end < n and is_word(term[-1]) and is_word(text[end]):
                    continue
            yield start, end, term

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost, then longest occurrences that do not overlap."""
        longest: dict[int, tuple[int, str]] = {}
        for start, end, term in self.all_spans(text):
            longest[start] = (end, term)  # of one start, longer terms end later
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                at, term = longest[start]
                out.append((start, at, term))
        return out

    def replaced(self, text: str) -> str:
        out, at = [], 0
        for start, end, term in self.spans(text):
            to = self.terms[term]
            out += [text[at:start], term if to is None else to]
            at = end
        return "".join([*out, text[at:]]) if at else text

    def masked(self, text: str) -> str:
        """``text`` with a blank for each character of a term."""
        out, at = [], 0
        for start, end, _ in self.spans(text):
            out += [text[at:start], " " * (end - start)]
            at = end
        return "".join([*out, text[at:]]) if at else text


def _known(terms: tuple, whole: bool) -> Terms:
    """The same object for the same terms in one process, so that its automaton is built once."""
    key = (terms, whole)
    if key not in _built:
        if len(_built) >= 8:
            _built.clear()
        _built[key] = Terms(dict(terms), whole)
    return _built[key]


def from_table(rows: DataFrame, term: str = "term", to: str | None = None, whole: bool = True, most: int = MOST_TERMS) -> Terms:
    """The terms of a table (of one term with several values: the least); more than ``most`` are refused, since every task holds them."""
    value = F.min(to) if to else F.lit(None).cast("string")
    found = rows.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(value.alias("to")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms; split the table")
    return Terms({r["term"]: r["to"] for r in sorted(found)}, whole)


def _mapped(work: Callable[[str], object], kind: pa.DataType, c: Column, sql: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else work(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, sql)(c)


def replace_terms(c: Column, terms: Terms) -> Column:
    """Each term as what takes its place; null stays null."""
    return _mapped(lambda t: terms.replaced(t), pa.string(), c, "string")


def mask_terms(c: Column, terms: Terms) -> Column:
    return _mapped(lambda t: terms.masked(t), pa.string(), c, "string")


def find_terms(c: Column, terms: Terms) -> Column:
    """``start, end, term`` of each occurrence, in code points."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
    return _mapped(lambda t: [{"start": a, "end": z, "term": x} for a, z, x in terms.spans(t)], kind, c, _MATCHES)


def forbidden(c: Column, variants: dict[str, tuple[str, ...]]) -> Column:
    """The variants that a text has once its legal longer forms are taken out, in the order given.

    Longer forms are taken out one after the other, so what the first leaves may hold the next.  One
    automaton finds variants and longer forms together; a text is only looked at again for
    variants whose longer forms it holds.
    """
    def rest(text: str, forms: tuple[str, ...]) -> str:
        for f in forms:
            text = text.replace(f, "")
        return text

    every = Terms(dict.fromkeys([*variants, *(f for forms in variants.values() for f in forms)]), whole=False)
    of_form: dict[str, list[str]] = {}
    for v, forms in variants.items():
        for f in forms:
            of_form.setdefault(f, []).append(v)
    order = {v: i for i, v in enumerate(variants)}

    def found(text: str) -> list[str]:
        seen = {term for _, _, term in every.all_spans(text)}
        held = {v for f in seen for v in of_form.get(f, ())}
        hits = {v for v in seen if v in order and v not in held} | {v for v in held if v in rest(text, variants[v])}
        return sorted(hits, key=order.__getitem__)

    return _mapped(found, pa.list_(pa.string()), c, "array<string>")
