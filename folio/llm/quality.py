"""Line-first quality rules: lines are cleaned first, then documents that lose too much go.

Every line with a word is held against three groups of rules:

* ``punctuation``: it does not end in a terminal mark (closing quotes, brackets and blanks may follow), or
  has more than one symbol for every ten words;
* ``navigation``: it is a menu (two or more separators, one for every four words at least), most of
  its letters are capitals, or it has no letter at all;
* ``boilerplate``: it has at most thirty words, with a phrase of licences, policies, consent banners,
  log-in and sharing bars.

A line that fails any rule is removed; lines without a word stay.  A document is kept when it has
enough words, repeats few of them in runs of ``WINDOW`` words, and the removed lines hold at most
``max_loss`` percent of the characters of its words.

Words are ``[^\\x20\\x09-\\x0D]+``.  Runs are compared exactly: hashes choose those
that may be equal, their words decide.

Defined cases: a null or empty text has no words and is not kept; repeated rows and null ids each
get a row; an empty table gives no rows; extra columns are ignored.  Of a text of more than a
megabyte a number for each word is held instead of the words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from .store import keyed

WINDOW, LONG = 5, 1 << 20
RULES = ("punctuation", "navigation", "boilerplate")
# characters and phrases of the rules
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|›•·>"
TERMINAL, CLOSING, BLANK = ".!?…。！？", "\"'“”’»)]", "\x20\x09\x0b\x0c\x0d"
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "cookie settings", "use cookies", "uses cookies", "accept cookies",
    "accept all cookies", "javascript", "lorem ipsum", "licensed under", "licenced under", "released under the", "available under the", "distributed under the", "copyright (c)", "copyright ©",
    "copyright 19", "copyright 20", "sign in", "log in", "login", "sign up", "subscribe", "newsletter", "click here", "read more", "share this", "share on", "follow us", "skip to content",
    "skip to main content", "back to top", "powered by",
)
SYMBOLS_PERCENT, MENU_WORDS, PHRASE_WORDS = 10, 4, 30
_word, _phrases = re.compile(WORD.encode()), [p.encode() for p in PHRASES]
_capitals = bytes(range(65, 91))
_letters = _capitals + bytes(range(97, 123))
_places = np.random.default_rng(12).integers(0, 2**64, 8, np.uint64, endpoint=False) | np.uint64(1)
_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed", *(f"n_{r}" for r in RULES), "lost_chars")
_SCHEMA = "k1 long, k2 long, doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", text string"


def _held(line: str, characters: str) -> int:
    return sum(map(line.count, characters))


def failed_rules(line: str, raw: bytes, n_words: int, phrases: list[bytes] = _phrases) -> tuple[bool, bool, bool]:
    """Which groups of ``RULES`` a line with words fails; ``raw``: its bytes, ``phrases``: those that may be in it."""
    end = line.rstrip(BLANK + CLOSING)
    punctuation = not end or end[-1] not in TERMINAL or 100 * _held(line, SYMBOLS) > SYMBOLS_PERCENT * n_words
    separators = _held(line, SEPARATORS)
    capitals, letters = (len(raw) - len(raw.translate(None, kind)) for kind in (_capitals, _letters))
    menu = separators >= 2 and MENU_WORDS * separators >= n_words
    navigation = menu or 2 * capitals > letters or (not letters and raw.isascii())
    lower = raw.lower() if phrases and n_words <= PHRASE_WORDS else b""
    return punctuation, navigation, any(p in lower for p in phrases)


def _covered(at: np.ndarray, n: int, window: int) -> int:
    """How many of ``n`` words stand in the runs that start ``at``."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a run of ``window`` words that is found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    run = sum(hashes[i : i + n] * _places[i % len(_places)] for i in range(window))
    order = np.sort(run)
    if not (order[1:] == order[:-1]).any():
        return 0
    some = np.flatnonzero(np.isin(run, order[1:][order[1:] == order[:-1]])).tolist()
    runs = [tuple(words[i : i + window]) for i in some]  # hashes only choose; words decide
    times = Counter(runs)
    return _covered(np.array([i for i, r in zip(some, runs, strict=True) if times[r] > 1], np.int64), len(words), window)


def repeated_numbers(word: np.ndarray, window: int = WINDOW) -> int:
    """``repeated_words`` for numbers that stand for the words: pairs are numbered again until a number stands for a whole run."""
    if len(word) <= window:
        return 0
    run, size = word, 1
    while size < window:
        # twice as long, or by the one word that is next
        more, step = (run, size) if 2 * size <= window else (word, 1)
        n = len(word) - size - step + 1
        run = np.unique(run[:n] * (int(more.max()) + 1) + more[size : size + n], return_inverse=True)[1]
        size += step
    return _covered(np.flatnonzero(np.bincount(run)[run] > 1), len(word), window)


def _long_line(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((numbers[m.group()] for m in _word.finditer(raw)), np.int64)


def line_report(text: str, long: int = LONG) -> tuple[list[int], str]:
    """The numbers of ``_NUMBERS`` for a text, and the text without its failing lines."""
    whole = text.encode("utf-8", "surrogatepass")
    lower = whole.lower()
    phrases = [p for p in _phrases if p in lower]
    is_long = len(whole) > long
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word gets the next number
    words: list = []
    seen: set[bytes] = set()
    kept, n_lines = [], 0
    removed = dup = chars = lost = 0
    fails = [0] * len(RULES)
    for line, raw in zip(text.split("\n"), whole.split(b"\n"), strict=True):
        n_lines += 1
        own = _long_line(raw, numbers) if is_long else raw.split()  # bytes part at the six blanks alone
        if not len(own):
            kept.append(line)
            continue
        words.append(own) if is_long else words.extend(own)
        dup += raw in seen
        seen.add(raw)
        size = len(line) - _held(line, BLANK)
        chars += size
        rules = failed_rules(line, raw, len(own), phrases)
        if any(rules):
            removed, lost = removed + 1, lost + size
            fails = [n + r for n, r in zip(fails, rules)]
        else:
            kept.append(line)
    word = np.concatenate([np.zeros(0, np.int64), *words]) if is_long else words
    again = repeated_numbers(word) if is_long else repeated_words(word)
    return [len(word), chars, _held(text, SYMBOLS), dup, again, n_lines, removed, *fails, lost], "\n".join(kept)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [line_report(t.as_py()) for t in b.column("text")]
        cols = list(zip(*(r[0] for r in rows))) or [[]] * len(_NUMBERS)
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array([r[1] for r in rows], pa.string())], names=["k1", "k2", "doc_id", *_NUMBERS, "text"])


def clean_lines(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, max_loss: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of numbers for each document, ``text`` without its failing lines, and the verdicts ``base_failed`` and ``kept``."""
    rows = keyed(docs, id_col, text_col).mapInArrow(B.bounded(_reported), _SCHEMA)
    base = f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words"
    return rows.selectExpr("*", f"{base} as base_failed", f"not ({base}) and 100 * lost_chars <= {max_loss} * word_chars as kept")
