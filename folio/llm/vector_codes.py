"""Compression of vectors to codes, with partial-distance search of the nearest codebook entry.

A vector of whole numbers (``floor(scale * x)``) is cut into ``parts`` equal parts; each part's
position has a codebook, and the code is the number of the nearest entry of each.  Codebooks start
as the vectors with the smallest ids and are improved ``rounds`` times: every part goes to its
nearest entry (ties: the lower), and an entry becomes the floor of the mean of its parts.

The nearest entry is found dimension by dimension, those in which the codebook varies most first.
After each dimension a part completes the distance to the entry that is nearest so far, and masks
drop every entry whose accumulated distance is strictly above the best complete one; what is left
at the end holds the nearest entry and all ties.  The codebooks are ``parts * entries`` rows, the
only thing that comes to the driver; tasks return sums and counts for each entry.

Defined cases: null vectors and those with null or non-finite components take no part, nor do
vectors of another length than most (of equally frequent lengths: the shorter); lengths that the
parts do not divide are filled up with zeros; null ids are larger than all others; rows that repeat
an id are rows of their own, ordered by the bytes of their vectors; with fewer rows than entries the
codebooks are smaller; components are held between bounds that keep every distance within 64 bits
(only components beyond 500,000 are ever held, in vectors of 64); a label's sum beyond 64 bits is null; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import saved

#: Rows compared with a codebook at once.
ROWS = 1024


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry of ``book``; both of whole numbers."""
    order = np.argsort(-book.astype(float).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    rows, entries = (i.ravel() for i in np.indices((len(x), len(book))))
    apart, best = np.zeros(len(rows), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for d in range(x.shape[1]):
        apart = apart + np.square(x[rows, d] - book[entries, d])
        first = _firsts(rows, apart, len(x))
        rest = np.square(x[:, d + 1 :] - book[entries[first], d + 1 :]).sum(1)
        best = np.minimum(best, apart[first] + rest)
        stay = apart <= best[rows]
        rows, entries, apart = rows[stay], entries[stay], apart[stay]
    return entries[_firsts(rows, apart, len(x))], best


def _firsts(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows (ascending in ``rows``, none missing) the first place of its least value."""
    start = np.searchsorted(rows, np.arange(n))
    at = np.flatnonzero(values == np.minimum.reduceat(values, start)[rows]) if n else start
    return at[np.searchsorted(rows[at], np.arange(n))]


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, as an array of (part, entry, place)."""

    entries: np.ndarray

    def assigned(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its components, nearest entry, distance) for the rows of ``vectors``."""
        parts, _, wide = self.entries.shape
        for p in range(parts):
            x = vectors[:, p * wide : (p + 1) * wide]
            yield p, x, *nearest(x, self.entries[p])

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, wide = self.entries.shape
        total, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for v in _vectors(batches):
            for p, x, code, _ in self.assigned(v):
                np.add.at(total[p], code, x)
                count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(count[p, e])], names=["part", "entry", "total", "n"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                v = next(_vectors([rows]))
                code, error = np.zeros((len(v), self.entries.shape[0]), np.uint8), np.zeros(len(v), np.int64)
                for p, _, nearest_, apart in self.assigned(v):
                    code[:, p] = nearest_
                    error += apart
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    def improved(self, rows: DataFrame) -> Codebooks:
        found = rows.select("v").mapInArrow(B.bounded(self.sums), "part int, entry int, total array<long>, n long")
        sums = found.select("part", "entry", "n", F.posexplode("total").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))
        new = self.entries.copy()
        for r in sums.collect():  # a number a component of the codebooks
            new[r["part"], r["entry"], r["i"]] = r["total"] // r["n"]
        return Codebooks(new)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            rows = b.column("v").slice(at, ROWS)
            yield np.frombuffer(b"".join(rows.to_pylist()), "<i4").reshape(len(rows), -1).astype(np.int64)


def _whole(scale: float, wide: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, flat = b.num_rows, b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.zeros((n, wide), "<i4")
            if n:
                with np.errstate(over="ignore"):  # the product may leave the doubles; it is held between the bounds
                    x[:, : len(flat) // n] = np.clip(np.floor(flat.reshape(n, -1) * scale), -most, most)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "v"])

    return run


def whole_vectors(rows: DataFrame, parts: int, scale: float, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows that take part, ``v`` as 32-bit whole numbers, and the length of ``v``."""
    kind = dict(rows.dtypes)[vec_col]
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(F.coalesce((F.size("v") > 0) & fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else parts
    wide = -(-d // parts) * parts
    rows = rows.where(F.size("v") == d)
    label = dict(rows.dtypes)["label"]
    return saved(rows.mapInArrow(_whole(scale, wide, isqrt((1 << 62) // wide) // 2), f"vec_id long, label {label}, v binary"), "whole-vectors"), wide


def train(rows: DataFrame, wide: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of ``rows`` (``vec_id, v``): the rows with the smallest ids, improved ``rounds`` times."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("vec_id", "v").collect()
    start = np.stack([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, wide // parts).swapaxes(0, 1)))
    for _ in range(rounds):
        books = books.improved(rows)
    return books


def compress(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error`` of each row that takes part, and the codebooks (None without rows)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte a part")
    whole, wide = whole_vectors(rows, parts, scale, id_col, vec_col, label_col)
    label = dict(whole.dtypes)["label"]
    fields = f"vec_id long, label {label}, code string, error long"
    if whole.isEmpty():
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    books = train(whole, wide, parts, entries, rounds)
    return saved(whole.mapInArrow(B.bounded(books.codes), fields), "vector-codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over equal labels (nulls are equal)."""
    total = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "same")
    # sums are one row a label, so a frequent label is split on the side of the rows
    return codes.join(total, F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
