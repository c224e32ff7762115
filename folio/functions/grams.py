"""Runs of words in Arrow batches of texts: which of them can be frequent, and how often each occurs.

Counting is done twice.  First every run is a 32-bit key, and the keys of a piece of text travel as one
sorted block a range of keys, at one to two bytes each (``tallied``, ``frequent``).  Runs share keys, so
a key may count too much but never too little, and what it rules out cannot be frequent.  Then the runs
that are left are counted by their words (``counted``).

The keys that reach the bound are a map of fixed size, ``CELLS`` bits, 16 keys a bit.  With more runs
than keys by far it rules out less; results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

#: Bytes of text that are counted at once; a longer text is a piece of its own.
PIECE = 1 << 24
#: Ranges of keys, the keys of one, and the keys that share a bit of the map.
RANGES, SPAN, SHARED = 1 << 10, 1 << 22, 1 << 4
CELLS = RANGES * SPAN // SHARED
#: Runs in a batch that goes back to Spark.
ROWS = 1 << 18
_MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)

TALLY = "range int, n int, keys binary"
MAP = "range int, cells binary"
COUNT = "size int, gram string, n long"


class _Words:
    """The words of some texts, which single spaces divide, as places in a list of different words."""

    def __init__(self, texts: pa.Array, stop: tuple[str, ...]):
        split = pc.split_pattern(texts, " ")
        flat, n = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        there = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(there).dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), n)[there.to_numpy(zero_copy_only=False)]
        self.fine = ~pc.is_in(self.words, pa.array(stop, self.words.type)).to_numpy(zero_copy_only=False)[self.codes]

    def starts(self, size: int) -> np.ndarray:
        """Where runs within a text begin that have no stop word at either end."""
        n = max(0, len(self.codes) - size + 1)
        return np.flatnonzero((self.row[:n] == self.row[size - 1:]) & self.fine[:n] & self.fine[size - 1:]) if n else np.zeros(0, np.int64)

    def hashed(self) -> np.ndarray:
        """A number a place, the same for a word wherever it stands."""
        return pd.util.hash_array(self.words.cast(pa.binary()).to_numpy(zero_copy_only=False), categorize=False)[self.codes]

    def counts(self, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of ``at`` for each different run, and how many have it; by the words, not by a hash."""
        ids, bound, n = np.zeros(len(at), np.int64), 1, len(self.words)
        for i in range(size):
            if bound * n >= 1 << 63:
                ids, bound = np.unique(ids, return_inverse=True)[1], len(at)
            ids, bound = ids * n + self.codes[at + i], bound * n
        _, first, times = np.unique(ids, return_index=True, return_counts=True)
        return at[first], times

    def grams(self, size: int, at: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(self.words.take(pa.array(self.codes[at + i])) for i in range(size)), " ")


def _keys(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    h = np.full(len(at), size, np.uint64)
    for i in range(size):
        h = (h ^ hashes[at + i]) * _MIX
        h ^= h >> _HALF
    return (h >> _HALF).astype(np.uint32)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        texts = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1), len(texts)]):
            if a < b:
                yield texts.slice(a, b - a)


def tallied(sizes: tuple[int, ...], stop: tuple[str, ...], least: int) -> Callable:
    """Texts to blocks of keys (``TALLY``): sorted, as differences; a key ``least`` times at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _pieces(batches):
            words = _Words(texts, stop)
            hashes = words.hashed()
            keys = np.sort(np.concatenate([_keys(hashes, n, words.starts(n)) for n in sizes]))
            keys = np.concatenate([keys[:least], keys[least:][keys[least:] != keys[:-least]]])
            cuts = [*np.searchsorted(keys, np.arange(RANGES, dtype=np.uint32) * np.uint32(SPAN)), len(keys)]
            rows = [(r, b - a, _packed(keys[a:b] % np.uint32(SPAN))) for r, (a, b) in enumerate(pairwise(cuts)) if a < b]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int32(), pa.binary()))], ["range", "n", "keys"])

    return run


def _packed(keys: np.ndarray) -> bytes:
    # bytes of one weight side by side, as the upper ones are mostly zero
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(block: bytes, n: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(block, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4")[:, 0], dtype=np.uint32)


def frequent(least: int) -> Callable:
    """The blocks of a range to its part of the map (``MAP``); none where no key comes ``least`` times."""

    def run(blocks: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_unpacked(b, n) for b, n in zip(blocks["keys"].to_pylist(), blocks["n"].to_pylist())]))
        last = keys[least - 1:]
        often = last[last == keys[:len(last)]]
        cells = np.zeros(SPAN // SHARED, bool)
        cells[often // SHARED] = True
        part = pa.table({"range": blocks["range"].slice(0, 1), "cells": pa.array([pa.compress(np.packbits(cells, bitorder="little").tobytes(), "zstd", asbytes=True)], pa.binary())})
        return part.slice(0, min(1, len(often)))

    return run


def whole_map(parts: Iterable[tuple[int, bytes]]) -> bytes:
    n = SPAN // SHARED // 8
    out = bytearray(CELLS // 8)
    for r, cells in parts:
        out[r * n:(r + 1) * n] = pa.decompress(bytes(cells), n, "zstd", asbytes=True)
    return bytes(out)


def counted(sizes: tuple[int, ...], stop: tuple[str, ...], often: Broadcast | None) -> Callable:
    """Texts to the runs that ``often``, a map, leaves, with their number in a piece (``COUNT``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None if often is None else np.frombuffer(often.value, np.uint8)
        for texts in _pieces(batches):
            words = _Words(texts, stop)
            hashes = None if often is None else words.hashed()
            for size in sizes:
                at = words.starts(size)
                if cells is not None:
                    cell = _keys(hashes, size, at) // SHARED
                    at = at[(cells[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) == 1]
                at, times = words.counts(size, at)
                for i in range(0, len(at), ROWS):
                    some = at[i:i + ROWS]
                    yield pa.record_batch([pa.array(np.full(len(some), size, np.int32)), words.grams(size, some), pa.array(times[i:i + ROWS].astype(np.int64))], ["size", "gram", "n"])

    return run
