"""Texts of a whole batch as arrays: widths, tokens and greedy lines, found for all texts at once.

The metric is a fixed width per character class in whole hundredths of the font size, the same for
wrapping, drawing and SQL, so that sums are exact.  A text is cut at line ends, its parts into
tokens (words, or single characters that may break anywhere), and a line is the longest run of
tokens whose prefix sums differ by no more than the room.  One step finds the next line of every
part by binary search, so the steps are as many as the longest text has lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

# fixed value: marks that may not begin a line
NO_START = "，。、；：？！”’』」〉》】〕〕·…—–-．％‰℃°×"
# fixed values: widths of characters in hundredths of the font size
WIDE, THIN, BROAD, CAPITAL, OTHER = 100, 28, 85, 68, 52
# fixed value: characters besides letters and digits that hold together as a word
HOLDING = "@./%°§[]()-+–—':;,_^<>«»×·≥≤=≈"


def char_units(ch: str) -> int:
    """Hundredths of the font size: 100 for CJK and full-width, about half for Latin."""
    o = ord(ch)
    if 0x2E80 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xFF00 <= o <= 0xFF60:
        return WIDE
    if ch in "iljtf.,:;'|! ":
        return THIN
    if ch in "mwMW@":
        return BROAD
    return CAPITAL if ch.isupper() else OTHER


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: units, whether it holds in a word, is blank, may not begin a line."""
    points = range(0x110000)
    units = np.full(0x110000, OTHER, np.int8)
    for low, high in ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFF60)):
        units[low : high + 1] = WIDE
    others = [o for o in points[:0x20000] if units[o] != WIDE and not 0xD800 <= o < 0xE000]
    units[others] = [char_units(chr(o)) for o in others]
    holds, blank, mark = (np.zeros(0x110000, bool) for _ in range(3))
    holds[[ord(c) for c in HOLDING]] = True
    for low, high in ("az", "AZ", "09"):
        holds[ord(low) : ord(high) + 1] = True
    blank[[o for o in points[:0x3001] if chr(o).isspace()]] = True
    mark[[ord(c) for c in NO_START]] = True
    return units, holds, blank, mark


def units_of(s: str) -> int:
    return int(_tables()[0][np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)].sum(dtype=np.int64))


@dataclass(frozen=True)
class Lines:
    """Lines in the order of texts: the text of each, its characters and its width in hundredths of the size."""

    owner: np.ndarray
    texts: list[str]
    units: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Whether a line is its text's first."""
        return np.append(True, self.owner[1:] != self.owner[:-1])[: len(self.owner)]

    @property
    def place(self) -> np.ndarray:
        """Each line's number in its text."""
        begin = np.flatnonzero(self.first)
        return np.arange(len(self.owner)) - np.repeat(begin, np.diff(np.append(begin, len(self.owner))))


class Texts:
    """A batch of texts, ready to be wrapped at any widths."""

    def __init__(self, texts: list[str]):
        cut = [t.split("\n") for t in texts]
        parts = [p.strip() for ps in cut for p in ps]
        self.n_texts = len(texts)
        self.text = np.repeat(np.arange(len(texts)), [len(ps) for ps in cut]) if texts else np.zeros(0, np.int64)
        self.first_part = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.whole = "".join(parts)
        size = np.array([len(p) for p in parts], np.int64)
        end = np.cumsum(size)
        units, holds, blank, self.mark = _tables()
        points = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = points
        self.sums = np.concatenate([[0], np.cumsum(units[points], dtype=np.int64)])
        word = holds[points]
        new = np.ones(len(points), bool)
        new[1:] = ~(word[1:] & word[:-1])
        new[(end - size)[size > 0]] = True
        self.start = np.append(np.flatnonzero(new), len(points))  # first character of each token, and the end
        self.width = self.sums[self.start]
        self.blank = np.append(blank[points[self.start[:-1]]], False)
        at = np.arange(len(self.blank))
        self.solid = np.minimum.accumulate(np.where(self.blank, len(at), at)[::-1])[::-1]  # the next token that is not blank
        self.begin, self.end = np.searchsorted(self.start, end - size), np.searchsorted(self.start, end)
        self.begin[size == 0] = self.end[size == 0]

    def _parts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``which``, part) of the parts of some texts."""
        n = self.first_part[which + 1] - self.first_part[which]
        owner = np.repeat(np.arange(len(which)), n)
        return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first_part[which], n)

    def _walk(self, begin: np.ndarray, end: np.ndarray, most: np.ndarray):
        """(parts that have a line left, its first token, the token behind it), step by step."""
        at, own = begin.copy(), np.flatnonzero(begin < end)
        while len(own):
            s = at[own]
            stop = np.searchsorted(self.width, self.width[s] + most[own], "right") - 1
            stop = np.minimum(np.maximum(stop, self.solid[s] + 1), end[own])
            yield own, s, stop
            at[own] = stop + (self.blank[stop] & (stop < end[own]))
            own = own[at[own] < end[own]]

    def counts(self, which: np.ndarray, room: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lines of the texts ``which`` at a size in a room each."""
        owner, part = self._parts(which)
        begin, end = self.begin[part], self.end[part]
        n = (begin == end).astype(np.int64)  # an empty part is a line
        for own, _, _ in self._walk(begin, end, _whole(room, size)[owner]):
            n[own] += 1
        return np.bincount(owner, n, len(which)).astype(np.int64)

    def lines(self, which: np.ndarray, room: np.ndarray, size: np.ndarray) -> Lines:
        """The lines themselves; a mark that may not begin a line goes up to the line above, if that has any text."""
        owner, part = self._parts(which)
        begin, end = self.begin[part], self.end[part]
        empty = np.flatnonzero(begin == end)
        found = [(empty, begin[empty], begin[empty])]
        found += self._walk(begin, end, _whole(room, size)[owner])
        of, first, stop = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((first, of))
        of, first, stop = of[order], first[order], stop[order]
        # blanks at a line's end do not count; the token before a break that is not blank ends it
        last = np.maximum(stop - 1, first)
        back = np.maximum.accumulate(np.where(self.blank, -1, np.arange(len(self.blank))))
        a, z = self.start[first], np.where(stop > first, self.start[np.minimum(back[last] + 1, len(self.start) - 1)], self.start[first])
        texts = [self.whole[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
        out = Lines(owner[of], texts, self.sums[z] - self.sums[a])
        starts = self.points[np.minimum(a, max(0, len(self.points) - 1))] if len(self.points) else np.zeros(len(a), np.uint32)
        odd = np.flatnonzero((z > a) & self.mark[starts] & ~out.first)
        return _pulled_up(out, odd) if len(odd) else out


def _pulled_up(lines: Lines, odd: np.ndarray) -> Lines:
    texts, units, first = list(lines.texts), lines.units.copy(), lines.first
    for i in odd.tolist():
        # nothing but the marks may be left of a line, which then has no text for the next one's marks
        head = len(texts[i]) - len(texts[i].lstrip(NO_START))
        if head and not first[i] and texts[i - 1]:
            texts[i - 1], texts[i] = texts[i - 1] + texts[i][:head], texts[i][head:]
            units[i - 1], units[i] = units_of(texts[i - 1]), units_of(texts[i])
    return Lines(lines.owner, texts, units)


def _whole(room: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Room in whole hundredths of the size: sums are whole, so no part of one counts."""
    return np.floor(np.asarray(room) * 100 / np.asarray(size)).astype(np.int64)
