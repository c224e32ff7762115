"""Pairs of rectangles that meet, by a plane sweep.

Rectangles are dealt over horizontal bands of a page and sorted by their left edge.  A task walks
over them from left to right and holds those that the sweep line crosses, sorted by their top; a
new rectangle is compared with the neighbours it can touch, so the work grows with the rectangles
and the pairs that come out, however many stand in one band.  A pair that shares several bands is
reported in the one where the lower of the two begins.

Rectangles with null coordinates or a right or lower edge before the other meet nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAND = 48.0
EDGES = ["x0", "y0", "x1", "y1"]


class _Crossed:
    """Rectangles under the sweep line, by their top; those it has left go when their number has doubled."""

    def __init__(self) -> None:
        self.rows: list[tuple[float, int]] = []  # (top, row)
        self.high, self.clean = 0.0, 16

    def add(self, row: int, y0: float, y1: float) -> None:
        insort(self.rows, (y0, row))
        self.high = max(self.high, y1 - y0)

    def near(self, y0: float, y1: float) -> list[tuple[float, int]]:
        return self.rows[bisect_left(self.rows, (y0 - self.high,)) : bisect_right(self.rows, (y1, float("inf")))]

    def left_behind(self, x: float, right: list[float]) -> None:
        if len(self.rows) > self.clean:
            self.rows = [r for r in self.rows if right[r[1]] >= x]
            self.clean = max(16, 2 * len(self.rows))


def _pairs(batches: Iterator[pa.RecordBatch], keys: list[str], least: float, two: bool) -> Iterator[tuple[pa.Table, list[int], list[int]]]:
    """(rows, left and right members of pairs as places in them); rows under the line go along from batch to batch."""
    held: pa.Table | None = None
    state: list[_Crossed] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        old = 0 if held is None else held.num_rows
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        cols = {c: rows.column(c).to_pylist() for c in [*keys, "band", "side", "top_band", *EDGES]}
        x0, y0, x1, y1 = (cols[c] for c in EDGES)
        side, band, top = cols["side"], cols["band"], cols["top_band"]
        names = list(zip(*(cols[k] for k in [*keys, "band"])))
        left, right = [], []
        for i in range(old, len(names)):
            if names[i] != last:
                last, state = names[i], [_Crossed(), _Crossed()]
            other = state[1 - side[i]] if two else state[0]
            other.left_behind(x0[i], x1)
            for _, j in other.near(y0[i], y1[i]):
                if min(x1[i], x1[j]) - x0[i] >= least and min(y1[i], y1[j]) - max(y0[i], y0[j]) >= least and max(top[i], top[j]) == band[i]:
                    a, z = (j, i) if side[i] or not two else (i, j)
                    left.append(a)
                    right.append(z)
            state[side[i]].add(i, y0[i], y1[i])
        yield rows, left, right
        # what the line still crosses, under new numbers
        line = x0[-1]
        stay = sorted(r for s in state for _, r in s.rows if x1[r] >= line)
        number = {r: n for n, r in enumerate(stay)}
        held = rows.take(pa.array(stay, pa.int64())).combine_chunks()
        for s in state:
            s.rows = [(t, number[r]) for t, r in s.rows if r in number]
            s.clean = max(16, 2 * len(s.rows))


def meeting(a: DataFrame, b: DataFrame | None = None, keys: tuple[str, ...] = ("doc", "page"), least: float = 0.0, band: float = BAND) -> DataFrame:
    """``keys``, then the other columns of both as ``a_...`` and ``b_...`` for rectangles ``x0, y0, x1, y1`` that overlap by ``least`` each way or more.

    Without ``b`` pairs are within ``a``, each once, in no particular order.
    """
    keys = list(keys)
    sides = [a] if b is None else [a, b]
    own = [[c for c in s.columns if c not in keys] for s in sides]
    kinds = [dict(s.dtypes) for s in sides]
    parts = []
    for n, (s, cols) in enumerate(zip(sides, own, strict=True)):
        boxes = [F.struct(*cols).alias(f"p{m}") if m == n else F.lit(None).cast("struct<" + ",".join(f"`{c}`:{kinds[m][c]}" for c in own[m]) + ">").alias(f"p{m}") for m in range(len(sides))]
        edges = [F.col(c).cast("double").alias(c) for c in EDGES]
        rows = s.select(*keys, F.lit(n).alias("side"), *edges, *boxes).where("x0 <= x1 and y0 <= y1")
        bands = F.sequence(F.floor(F.col("y0") / band).cast("int"), F.floor(F.col("y1") / band).cast("int"))
        parts.append(rows.withColumn("top_band", F.floor(F.col("y0") / band).cast("int")).withColumn("band", F.explode(bands)))
    rows = parts[0] if b is None else parts[0].unionByName(parts[1])
    dealt = rows.repartition(*keys, "band").sortWithinPartitions(*keys, "band", "x0")
    second, two = len(sides) - 1, b is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right in _pairs(batches, keys, least, two):
            if not left:
                continue
            one, other = pa.array(np.array(left)), pa.array(np.array(right))
            cols = [rows.column(k).take(one).combine_chunks() for k in keys]
            cols += [rows.column(name).take(at).combine_chunks() for name, at in (("p0", one), (f"p{second}", other))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "a", "b"])

    shape = lambda m: "struct<" + ",".join(f"`{c}`:{kinds[m][c]}" for c in own[m]) + ">"
    fields = ", ".join([*(f"`{k}` {kinds[0][k]}" for k in keys), f"a {shape(0)}", f"b {shape(second)}"])
    found = dealt.mapInArrow(run, fields)
    return found.select(*keys, *[F.col(f"a.{c}").alias(f"a_{c}") for c in own[0]], *[F.col(f"b.{c}").alias(f"b_{c}") for c in own[second]])
