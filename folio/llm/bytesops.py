"""Vectorised work on the UTF-8 bytes of many texts at once.

Texts of an Arrow batch are joined into slices of about ``SLICE`` bytes with one separator byte
behind each, so that no array grows with the batch.  One text longer than that is a slice of its
own; work on words cuts it between words instead (``word_runs``).

Words are hashed in blocks of eight bytes, each mixed into the last, in two lanes that share
nothing; words over ``LONG_WORD`` bytes by BLAKE2.  Runs of words are sums of their words' hashes
times a random odd number for each place, mixed.  Both lanes together make 128 bits.  Spans of bytes
(``spans_hash``) are polynomials modulo 2**64; they only choose places, equality is never read
from them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_seeds = np.random.default_rng(0x5EED)
LANES, LONG_WORD, MOST_GRAM = 2, 64, 32
_LANE = _seeds.integers(0, 2**64, (LANES, 3), np.uint64, endpoint=False) | np.uint64(1)
_PLACE = _seeds.integers(0, 2**64, (LANES, MOST_GRAM + 1), np.uint64, endpoint=False) | np.uint64(1)
# the bytes of a block of eight that belong to a word with so many bytes left
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n; ``inverse``: of the inverse of the (odd) base."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, SLICE + 4096), b, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * SLICE:
            _powers[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(base, len(sums), True)[start])


def slices(texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes with a newline behind each text, start of each text and the end)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, *_joined(held)
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, *_joined(held)


def pieces(texts: list[str], overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``slices`` with the place in the first text where they begin: long texts come in parts that share ``overlap`` bytes."""
    for first, raw, starts in slices(texts):
        if len(starts) > 2 or len(raw) <= 2 * SLICE:
            yield first, 0, raw, starts
            continue
        body = raw[:-1]
        for a in range(0, len(body) - overlap, SLICE):
            part = body[a : a + SLICE + overlap]
            yield first, a, part, np.array([0, len(part) + 1])


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in held], out=starts[1:])
    return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), starts


def table(kept: str | bytes, lower: bool = True) -> np.ndarray:
    """A byte map: 0 for separators, else the byte (A-Z lower-cased) plus 1."""
    out = np.zeros(256, np.uint16)
    for b in kept:
        out[b] = b + 1
    if lower:
        out[65:91] = out[97:123]
    return out


def words(raw: np.ndarray, starts: np.ndarray, classes: np.ndarray, lanes: int = LANES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: (hash of each lane, first byte, end, index of the text); the separators end words."""
    code = classes[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = code > 0
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[0::2], edges[1::2]
    size = end - begin
    plain = np.zeros(len(raw) + 8, np.uint8)
    plain[: len(raw)] = code - np.uint16(1)
    block = np.lib.stride_tricks.sliding_window_view(plain, 8)

    def eight(rows: np.ndarray | slice, k: int) -> np.ndarray:
        """The k-th block of eight bytes of some words, zero behind the word."""
        return block[begin[rows] + 8 * k].view("<u8").ravel() & _HEAD[np.minimum(size[rows] - 8 * k, 8)]

    first = eight(slice(None), 0) if len(begin) else np.zeros(0, np.uint64)
    found = [mix((first ^ (size.astype(np.uint64) * c)) * b + a) for a, b, c in _LANE[:lanes]]
    for k in range(1, LONG_WORD // 8):
        rows = np.flatnonzero(size > 8 * k)
        if not len(rows):
            break
        more = eight(rows, k)
        for h, (a, b, _) in zip(found, _LANE):
            h[rows] = mix((h[rows] * b + a) ^ more)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        name = hashlib.blake2b(plain[begin[i] : end[i]].tobytes(), digest_size=16).digest()
        for h, value in zip(found, np.frombuffer(name, "<u8")):
            h[i] = value
    return found, begin, end, np.searchsorted(starts, begin, "right") - 1


def grams(word: np.ndarray, n: int, lane: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes in one lane of all runs of n consecutive words (across texts too: mask those), or of those that start ``at``."""
    m = max(0, len(word) - n + 1)
    out = np.full(m if at is None else len(at), int(_PLACE[lane, MOST_GRAM]) * n % 2**64, np.uint64)
    if len(out):
        for i in range(n):
            out += (word[i : i + m] if at is None else word[at + i]) * _PLACE[lane, i]
    return mix(out)


def word_runs(texts: list[str], classes: np.ndarray) -> Iterator[tuple[int, bool, bool, list[np.ndarray], np.ndarray]]:
    """(index of the first text, its words go on from the run before, its words end here, hash of each lane, words of each text).

    A text of more than twice ``SLICE`` bytes comes in several runs, cut between words, so memory
    does not grow with it; every other text is whole in one run.
    """
    for first, raw, starts in slices(texts):
        at, stop = 0, len(raw)
        while at < len(raw):
            if len(starts) == 2 and len(raw) - at > 2 * SLICE:
                stop = at + SLICE
                while stop < len(raw):  # behind the last separator, or as far as the word goes
                    blank = np.flatnonzero(classes[raw[at:stop]] == 0)
                    if len(blank):
                        stop = at + int(blank[-1]) + 1
                        break
                    stop = min(stop + SLICE, len(raw))
            else:
                stop = len(raw)
            found, _, _, doc = words(raw[at:stop], np.maximum(starts - at, 0), classes)
            yield first, at > 0, stop == len(raw), found, np.bincount(doc, minlength=len(starts) - 1)
            at = stop


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = w - size
    return np.minimum(have[: len(x) - w + 1], have[rest : rest + len(x) - w + 1])


def bounded(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give freed memory back when a task's batches are done: workers live on and are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
