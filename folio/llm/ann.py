"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns the unit vector by three rounds of random signs and a fast Hadamard transform and
takes the signed axis with the largest coordinate; ``depth`` hashes in a row make a table's
bucket.  Each row is in one bucket a table; a query also visits the buckets of its next-best
axes, as many as its ``probes``.  The rows of all visited buckets are ranked, and the nearest are
ranked again by the exact Euclidean distance of the original vectors in double precision.

Tables hold ids and vectors rounded to a byte a component.  How far rounding may move a distance
is known, so whatever could be among the ``top`` goes on to the exact ranking and nothing is lost
by it.  The depth grows with the logarithm of the number of rows, which keeps buckets small.  The
number of probes is the least that finds ``recall`` of the true neighbours of ``sample`` queries,
which are compared with all rows.

Buckets that share their first axes are one group, of about ``group_rows`` rows (a small table is
one whole); groups with more are split by a salt, and queries visit all parts, so no task holds an
unbounded group.  Of equal
vectors only the ``top + 1`` smallest ids can be an answer, so the rest are set aside before
hashing; queries are never set aside.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components and vectors
of another length than most take no part; null ids take no part; ties go to the smaller id;
repeated rows are one candidate and one query; a query that its buckets leave with fewer than
``top`` rows visits every row; vectors of any finite size keep their distances (above the largest
double: none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Axes in one step of the transform, rows hashed at once, and candidates ranked at once.
RADIX, ROWS, CANDIDATES = 64, 4096, 1 << 15
_H = np.ones((1, 1))
while len(_H) < RADIX:
    _H = np.block([[_H, _H], [_H, -_H]])


def turned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of ``x`` (padded to a power of two) after three rounds of signs and Hadamard, ``RADIX`` axes a step."""
    n, d = x.shape
    for _ in range(3):
        x = x * rng.choice(np.array([-1.0, 1.0]), d)
        done = 1
        while done < d:
            r = min(RADIX, d // done)
            x = x.reshape(-1, r, done).swapaxes(1, 2).reshape(-1, r) @ _H[:r, :r]
            x = x.reshape(-1, done, r).swapaxes(1, 2).reshape(n, d)
            done *= r
        x = x / np.sqrt(d)
    return x


def width(d: int) -> int:
    return 1 << max(0, (d - 1).bit_length())


def hashed(vectors: np.ndarray, table: int, depth: int, probes: int, seed: int) -> np.ndarray:
    """The ``probes`` best buckets of each row in a table, best first."""
    unit = np.zeros((len(vectors), width(vectors.shape[1])))
    most = np.abs(vectors).max(1, keepdims=True)
    unit[:, : vectors.shape[1]] = vectors / most / np.linalg.norm(vectors / most, axis=1, keepdims=True)
    score, code = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
    for i in range(depth):
        y = turned(unit, np.random.default_rng([seed, table, i]))
        y = np.concatenate([y, -y], 1)
        if probes == 1:
            code = code * y.shape[1] + y.argmax(1)[:, None]
            continue
        best = np.argsort(-y, axis=1, kind="stable")[:, :probes]
        gain = np.take_along_axis(y, best, 1)
        score = (score[:, :, None] + gain[:, None, :]).reshape(len(y), -1)
        code = (code[:, :, None] * y.shape[1] + best[:, None, :]).reshape(len(y), -1)
        if score.shape[1] > probes:
            some = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            score, code = np.take_along_axis(score, some, 1), np.take_along_axis(code, some, 1)
        order = np.lexsort((code, -score), axis=1)
        score, code = np.take_along_axis(score, order, 1), np.take_along_axis(code, order, 1)
    return code


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, also where squares leave the range of doubles."""
    gap = a - b
    most = np.abs(gap).max(1)
    far = (most > 1e140) | ((most < 1e-140) & (most > 0))
    scale = np.where(far, most, 1.0)
    return np.sqrt(np.square(gap / scale[:, None]).sum(1)) * scale


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _rounded(v: np.ndarray, unit: float) -> tuple[pa.Array, pa.Array]:
    """Vectors over ``unit`` as bytes, and what a byte counts."""
    x = v / unit
    step = np.abs(x).max(1) / 127
    codes = np.rint(x / np.maximum(step, 1e-300)[:, None]).astype(np.int8)
    return pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step)


def _restored(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rounded vectors, and how far each may be from the one it stands for."""
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int8).reshape(rows.num_rows, -1)
    step = rows.column("step").to_numpy()
    return codes * step[:, None], step * (np.sqrt(codes.shape[1]) * 0.5000001)


def weighed_at_once(probes: int, axes: int, depth: int) -> int:
    """Queries that are probed together: each weighs every pair of its best buckets so far and the next hash's axes."""
    return max(1, (1 << 22) // (min(probes, axes ** max(1, depth - 1)) * min(probes, axes)))


class _Index:
    """How rows are dealt to tables and groups."""

    def __init__(self, tables: int, depth: int, axes: int, d: int, unit: float, seed: int):
        self.tables, self.depth, self.seed, self.unit = tables, depth, seed, unit
        self.axes, self.below = 2 * width(d), (2 * width(d)) ** (depth - axes)

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            v = _matrix(b.column("v"))
            for t in range(self.tables):
                grp, n = np.unique(hashed(v, t, self.depth, 1, self.seed)[:, 0] // self.below, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grp), t, np.int32)), pa.array(grp), pa.array(n)], names=["tab", "grp", "n"])

    def placed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            v = _matrix(b.column("v"))
            codes, step = _rounded(v, self.unit)
            for t in range(self.tables):
                bucket = hashed(v, t, self.depth, 1, self.seed)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(bucket // self.below), pa.array(bucket), b.column("vec_id"), codes, step], names=["tab", "grp", "bucket", "vec_id", "codes", "step"])

    def probed(self, probes: int):
        at_once = weighed_at_once(probes, self.axes, self.depth)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, at_once):
                v = _matrix(b.column("v"))
                codes, step = _rounded(v, self.unit)
                for t in range(self.tables):
                    bucket = np.sort(hashed(v, t, self.depth, probes, self.seed), axis=1)
                    rows, grps, lists = [], [], []
                    for i, own in enumerate(bucket):
                        grp, first = np.unique(own // self.below, return_index=True)
                        rows += [i] * len(grp)
                        grps += grp.tolist()
                        lists += [x.tolist() for x in np.split(own, first[1:])]
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(grps, pa.int64()), pa.array(lists, pa.list_(pa.int64())), b.column("vec_id").take(at), codes.take(at), step.take(at)],
                        names=["tab", "grp", "buckets", "vec_id", "codes", "step"])

        return run


def _least(ids: np.ndarray, dist: np.ndarray, slack: np.ndarray, top: int) -> np.ndarray:
    """The rows that may be among the ``top`` nearest ids when each distance is wrong by ``slack`` at most."""
    order = np.argsort(dist + slack, kind="stable")
    _, first = np.unique(ids[order], return_index=True)
    if len(first) <= top:
        return order
    edge = (dist + slack)[order[np.sort(first)[top - 1]]]
    return np.flatnonzero(dist - slack <= edge)


_FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64())), ("slack", pa.list_(pa.float64()))])
_FOUND_SQL = "query_id long, ids array<long>, dist array<double>, slack array<double>"


def _nearest(top: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """For each query the rows of its buckets, without those that cannot be among the ``top`` where they are many."""
        out = [_FOUND.empty_table()]
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("bucket")
            bucket, ids = rows.column("bucket").to_numpy(), rows.column("vec_id").to_numpy()
            (v, off), (x, x_off) = _restored(rows), _restored(asked)
            names, lists = asked.column("vec_id").to_numpy(), asked.column("buckets")
            every = np.unique(bucket)
            wanted = [every if (w := q.values) is None else w.to_numpy() for q in lists]
            held, size = [], 0
            for i, w in enumerate(wanted):
                first, stop = np.searchsorted(bucket, w, "left"), np.searchsorted(bucket, w, "right")
                count = stop - first
                at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                held.append((i, at[ids[at] != names[i]]))
                size += len(at)
                if size >= CANDIDATES or i == len(wanted) - 1:
                    out.append(_ranked(held, names, ids, v, off, x, x_off, top))
                    held, size = [], 0
        return pa.concat_tables(out)

    return run


def _ranked(held: list[tuple[int, np.ndarray]], names: np.ndarray, ids: np.ndarray, v: np.ndarray, off: np.ndarray, x: np.ndarray, x_off: np.ndarray, top: int) -> pa.Table:
    query = np.array([i for i, _ in held])
    count = np.array([len(at) for _, at in held])
    at, owner = np.concatenate([at for _, at in held]), np.repeat(query, count)
    dist, slack = np.sqrt(np.square(v[at] - x[owner]).sum(1)), off[at] + x_off[owner]
    keep = np.ones(len(at), bool)
    end = np.cumsum(count)
    for i in np.flatnonzero(count > 4 * top).tolist():
        own = slice(end[i] - count[i], end[i])
        near = _least(ids[at[own]], dist[own], slack[own], top)
        keep[own] = False
        keep[own.start + near] = True
    edges = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], end])]
    some = np.flatnonzero(np.diff(edges))
    offsets = pa.array(np.append(edges[some], edges[-1]), pa.int32())
    cols = [pa.ListArray.from_arrays(offsets, pa.array(c[keep])) for c in (ids[at], dist, slack)]
    return pa.Table.from_arrays([pa.array(names[query[some]]), *cols], schema=_FOUND)


def _merged(top: int):
    def run(rows: pa.Table) -> pa.Table:
        flat = [rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "dist", "slack")]
        ids = np.unique(flat[0][_least(*flat, top)])
        return pa.table({"query_id": pa.array(np.full(len(ids), rows.column("query_id")[0].as_py(), np.int64)), "vec_id": pa.array(ids)})

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = distances(_matrix(b.column("v")), _matrix(b.column("q"))) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def _compared(queries: np.ndarray, ids: list[int], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``top`` nearest of a slice's rows for each of a few queries."""
        for b in _slices(batches):
            v, own = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            for q, x in zip(ids, queries, strict=True):
                dist = distances(v, x)
                at = np.lexsort((own, dist))
                at = at[own[at] != q][:top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int64)), pa.array(own[at]), b.column("v").take(pa.array(at)), pa.array(dist[at])], names=["query_id", "vec_id", "v", "score"])

    return run


def probes_for(recall: float, rows: DataFrame, asked: DataFrame, sample: int, top: int, tables: int, depth: int, seed: int, least: int = 16) -> int:
    """The least number of probes that finds ``recall`` of the true neighbours of the ``sample`` queries with the smallest hashes."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    queries, ids = np.array([r["v"] for r in some], float), [r["vec_id"] for r in some]
    kind = dict(rows.dtypes)["v"]
    near = rows.mapInArrow(_compared(queries, ids, top), f"query_id long, vec_id long, v {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("query_id", "v").collect()  # sample * top rows
    if not near:
        return least
    buckets = (2 * width(queries.shape[1])) ** depth
    at = {q: i for i, q in enumerate(ids)}
    owner, v = np.array([at[r["query_id"]] for r in near]), np.array([r["v"] for r in near], float)
    homes = [hashed(v, t, depth, 1, seed)[:, 0] for t in range(tables)]
    probes = least
    while probes < buckets:
        hit = np.zeros(len(near), bool)
        step = weighed_at_once(probes, 2 * width(queries.shape[1]), depth)
        for a in range(0, len(queries), step):  # no more in memory than a task holds
            own = np.flatnonzero((owner >= a) & (owner < a + step))
            for t, home in enumerate(homes):
                hit[own] |= (hashed(queries[a : a + step], t, depth, probes, seed)[owner[own] - a] == home[own, None]).any(1)
        if hit.mean() >= recall:
            return probes
        probes += probes // 4
    return buckets


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = dict(rows.dtypes)[vec_col]
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    x = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return x.where(F.coalesce(fine, F.lit(False)))


def search(rows: DataFrame, queries: DataFrame, top: int = 10, tables: int = 24, depth: int | None = None, recall: float = 0.95, sample: int = 64,
           group_rows: int = 8192, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest rows found for each query."""
    rows, asked = valid(rows, id_col, vec_col), valid(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    d, n = size["d"], size["n"]
    rows, asked = rows.where(F.size("v") == d), saved(asked.where(F.size("v") == d), "ann-asked")
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    rows = saved(rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= top + 1).select("vec_id", "v"), "ann-rows")
    base = log(2 * width(d))
    depth = depth or max(2, round(log(n) / base))
    index = _Index(tables, depth, min(depth, max(0, round(log(max(1, n / group_rows)) / base))), d, float(size["most"]), seed)
    parts = rows.mapInArrow(index.counted, "tab int, grp long, n long").groupBy("tab", "grp").agg(F.ceil(F.sum("n") / group_rows).cast("int").alias("parts"))
    parts = saved(parts, "ann-groups")
    placed = rows.mapInArrow(index.placed, "tab int, grp long, bucket long, vec_id long, codes binary, step double")
    salted = placed.join(parts, ["tab", "grp"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    by = ["tab", "grp", "part"]

    def found(probed: DataFrame) -> DataFrame:
        probed = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        near = salted.groupBy(*by).cogroup(probed.groupBy(*by)).applyInArrow(_nearest(top), _FOUND_SQL)
        pairs = near.groupBy("query_id").applyInArrow(_merged(top), "query_id long, vec_id long")
        full = pairs.join(rows, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        score = full.select("query_id", "vec_id", "v", "q").mapInArrow(_exact, "query_id long, vec_id long, score double")
        score = score.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).where("score < double('infinity')")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    probes = probes_for(recall, rows, asked, sample, top, tables, depth, seed)
    fields = "tab int, grp long, buckets array<long>, vec_id long, codes binary, step double"
    near = saved(found(asked.mapInArrow(index.probed(probes), fields).join(parts, ["tab", "grp"])), "ann-found")
    enough = min(top, rows.select("vec_id").distinct().limit(top + 1).count() - 1)
    short = asked.join(near.where(F.col("rank") >= enough).select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_anti")
    if enough > 0 and not short.isEmpty():
        short = saved(short, "ann-short")
        # the groups of one table hold every row
        every = short.mapInArrow(index.probed(1), fields).where("tab = 0").select("tab", F.lit(None).cast("array<long>").alias("buckets"), "vec_id", "codes", "step")
        every = every.join(parts, "tab").select("tab", "grp", "buckets", "vec_id", "codes", "step", "parts")
        near = near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(found(every))
    return near.select("query_id", "rank", "vec_id", "score")
