"""Best-fit-decreasing packing of token sequences.

Documents are tokenised and, only where longer than ``size``, cut into pieces of ``size`` tokens
with the shorter one first.  Packing needs nothing but the number of pieces of each length, at
most ``size`` numbers: a segment tree over remaining capacities finds the tightest open bins for
the longest unpacked length, and all pieces of that length that fit the same kind of bin are
placed at once.  The plan is therefore the exact best-fit-decreasing result for the whole corpus,
small whatever the corpus's size, and every piece finds its place by its rank among the pieces of
its length.

Defined cases: a null text is empty and gives one piece that holds the end token alone; repeated
rows and null ids are packed as rows of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import keyed, saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_tokenizers: dict[str, object] = {}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by bytes of a byte-level BPE file whose ids follow the order of its merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in shown}
    to_byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {bytes(to_byte[c] for c in k): v for k, v in vocab.items() if all(c in to_byte for c in k) and not k.startswith("<|")}


def encoder(path: str):
    """text -> ids; the same ids as the tokenizers library gives for the file, some times faster.

    Added tokens are split off first, as the library does, and the texts between them are encoded on
    their own.  Where an added token asks for more than its exact text, the library itself is used.
    """
    if path not in _tokenizers:
        import public_tokenizers
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_vocabulary(path), special_tokens={}).encode_ordinary
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            _tokenizers[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
        else:
            _tokenizers[path] = _split_on({x["content"]: x["id"] for x in added}, fast) if added else fast
    return _tokenizers[path]


def _split_on(added: dict[str, int], fast):
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return fast(text)
        # every second part is an added token
        return [x for i, part in enumerate(parts) for x in ([added[part]] if i % 2 else fast(part))]

    return encode


def _tokenised(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                cut = len(ids) % size or min(size, len(ids))
                edges = [0, *range(cut, len(ids) + 1, size)]
                for i, (a, z) in enumerate(zip(edges, edges[1:])):
                    out.append((doc, i, a, z - a, zlib.crc32(ids[a:z].tobytes()), task, seen[z - a]))
                    seen[z - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


class _Tree:
    """Which capacities 0..size have an open bin; the tightest that is large enough in log time."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        while not self.open[i]:
            while i & 1:  # a right child: go up
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # wrapped to the next level's first node
                return None
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Rows (length, first rank, first bin, offset), by length and rank: ranks from there on go to
    consecutive bins at that offset.  Bins of one fill level are kept as ranges of bin numbers."""
    tree, bins, rows, n_bins = _Tree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, have = size, n_bins, left
            else:
                first, have = bins[room].pop()
            # the bin just used is the tightest until it is full, so bins fill one after another
            per = room // length
            took, levels = (min(have, left // per), per) if left >= per else (1, left)
            rows += [(length, rank + j * took, first, size - room + j * length) for j in range(levels)]
            if first == n_bins:
                n_bins += took
            else:
                if took < have:
                    bins[room].append((first + took, have - took))
                if not bins[room]:
                    tree.put(room, False)
            if after := room - levels * length:
                if not bins.get(after):
                    tree.put(after, True)
                bins.setdefault(after, []).append((first, took))
            rank, left = rank + levels * took, left - levels * took
    return rows


def _placed(rows: list[tuple[int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for x in rows:
            by.setdefault(x[0], []).append(x)
        ranks = {k: [x[1] for x in v] for k, v in by.items()}
        for b in batches:
            found = []
            for n, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                _, first, place, offset = by[n][bisect_right(ranks[n], rank) - 1]
                found.append((place + rank - first, offset))
            cols = list(zip(*found)) or [[], []]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece."""
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    pieces = saved(rows.mapInArrow(B.bounded(_tokenised(tokenizer, size, end_id)), PIECES), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    # the bases grow with the number of tasks, so they are never broadcast
    ranked = pieces.join(bases.drop("n").hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(B.bounded(_placed(plan(counts, size))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
