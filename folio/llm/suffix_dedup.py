"""Exact removal of long repeated strings by interval expansion on a Burrows-Wheeler transform.

Every byte under a ``SIZE``-byte string that also starts elsewhere goes.  Equal strings are
brought together by content: the smallest hash of ``GRAM`` bytes inside a window of ``SIZE``
bytes is its anchor, the same wherever the window stands, and the neighbouring windows with one
anchor form its context.  Anchors that occur once cannot belong to a repeated string and are left
out first.  Of equal contexts one stands for all, with their number as its weight.  The contexts go
to tasks by anchor: each builds suffix order and transform of a bounded batch of contexts and
expands intervals breadth-first by backward extension, which finds the boundaries between suffixes
by increasing length of their common prefixes and stops at ``SIZE``; suffixes that no boundary
parts are one string, which is repeated if their weights sum to more than one.  Nothing is settled
in another way.

An anchor whose contexts are too many for one batch is refined: its windows are split by where the
anchor stands in them, first roughly, then to the byte, and the bytes that all windows of a part
must share become the part's own anchor.  In the end a part is one string, so every group comes to
fit a batch.

Defined cases: a null text is empty; rows that repeat id and text are occurrences like any other,
so their long strings all go; null ids are documents by their text; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import discard, keyed, saved

SIZE, GRAM = 200, 32
#: Bytes of contexts in one transform (more only where one anchor's go a little beyond), and the widths of the parts of refined anchors.
BATCH_BYTES, WIDTHS = 2 << 20, (64, 16, 4, 1)
_START = 7
# a place packs the first window's start, its distance to the anchor and the number of windows
_FIRST, _BYTE = 16, 8
_ANCHORS = "kh long, c1 long, c2 long, k1 long, k2 long, at long"
_UNITS = "kh long, c1 long, c2 long, n long, dist int, bytes binary"


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window's start, number of windows, anchor's distance from that start) of each context of a slice."""
    n = len(raw) - SIZE + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    sums = B.prefix(raw.astype(np.uint64) + np.uint64(1), B._BASE)
    at = np.arange(len(raw) - GRAM + 1)
    h = B.spans_hash(sums, at, at + GRAM, B._BASE)
    low = np.uint64((1 << max(24, len(raw).bit_length())) - 1)
    least = B.sliding_min((h & ~low) | at.astype(np.uint64), SIZE - GRAM + 1)[:n]
    place = (least & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    first, stop = starts[:-1], starts[1:] - 1 - SIZE + 1  # window starts of each text
    has = stop > first
    np.add.at(inside, first[has], 1)
    np.add.at(inside, stop[has], -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    begin = np.flatnonzero(new)
    last = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
    return h[place[begin]], begin, last - begin + 1, place[begin] - begin


def _digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
        for first, offset, raw, starts in B.pieces(b.column("text").to_pylist(), SIZE - 1):
            kh, begin, count, dist = anchors(raw, starts)
            data = raw.tobytes()
            c1, c2 = _digests([data[a : a + n + SIZE - 1] for a, n in zip(begin.tolist(), count.tolist(), strict=True)])
            doc = np.searchsorted(starts, begin, "right") - 1
            at = ((begin - starts[doc] + offset) << _FIRST) | (dist << _BYTE) | count
            yield pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64)), pa.array(c1), pa.array(c2), pa.array(k1[first + doc]), pa.array(k2[first + doc]), pa.array(at)], names=["kh", "c1", "c2", "k1", "k2", "at"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by anchor, whose anchor has a neighbour; a partition's first and last anchor may have one elsewhere."""
    held: pa.RecordBatch | None = None
    paired, first = False, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        kh = b.column("kh").to_numpy()
        first = kh[0] if first is None else first
        same = kh[1:] == kh[:-1]
        keep = np.append(same, False) | np.insert(same, 0, paired) | (kh == first)
        # the last row stays back, to be compared with the next batch's first
        n = len(kh) - 1
        yield b.slice(0, n).filter(pa.array(keep[:n], pa.bool_()))
        held, paired = b.slice(n), bool(keep[n])
    if held is not None:
        yield held


def suffix_order(sym: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``order`` (or more) symbols, and where their first seven differ."""
    n = len(sym)
    pad = np.append(sym, np.zeros(_START, np.uint64))
    key = np.zeros(n, np.uint64)
    for j in range(_START):
        key = (key << np.uint64(9)) | pad[j : j + n]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    first = new.copy()
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = _START
    at = np.arange(n)  # places whose suffix is not told apart from its neighbours yet
    while h < order:
        head = new[at]
        # places of one group stand side by side, so a head followed by a head is alone
        at = at[~(head & np.append(head[1:], True))]
        if not len(at):
            break
        own = sa[at]
        pair = (rank[own].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(own + h, n)] + 1).astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        own, pair = own[by], pair[by]
        sa[at] = own
        new[at[1:]] |= pair[1:] != pair[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[at], at, 0))
        h *= 2
    return sa, first


def repeated(sym: np.ndarray, valid: np.ndarray, size: int = SIZE, weight: np.ndarray | None = None) -> np.ndarray:
    """Which positions of ``valid`` start a string of ``size`` symbols that occurs twice or more.

    ``sym``: bytes plus 1 in uint64, with 0 between contexts; ``weight``: how many occurrences a
    position stands for (one each, if not given).  The weights under an interval are summed.
    """
    n = len(sym)
    sa, first = suffix_order(sym, size)
    last_symbol = np.where(sa > 0, sym[sa - 1], 0).astype(np.uint16)  # the transform
    step = np.empty(n, np.int64)
    step[np.argsort(last_symbol, kind="stable")] = np.arange(n)
    parted = np.append(first, True)  # parted[i]: a boundary below suffix i is known
    lb = np.flatnonzero(first)
    rb = np.append(lb[1:], n) - 1
    for _ in range(_START, size):
        if not len(lb):
            break
        width = rb - lb + 1
        owner = np.repeat(np.arange(len(lb)), width)
        at = np.arange(width.sum()) + np.repeat(lb - (np.cumsum(width) - width), width)
        symbol = last_symbol[at]
        # rows stand in the order of their intervals, so sorting by symbol brings the parts of each together
        by = np.argsort(symbol, kind="stable")
        symbol, owner, to = symbol[by], owner[by], step[at[by]]
        edge = np.flatnonzero((symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1]))
        left, right = to[np.insert(edge + 1, 0, 0)], to[np.append(edge, len(to) - 1)]
        fresh = ~parted[right + 1]
        lb, rb = left[fresh], right[fresh]
        parted[rb + 1] = True
    # suffixes that no boundary parts have the same first ``size`` symbols
    own = np.where(valid[sa], 1 if weight is None else weight[sa], 0)
    begin = np.flatnonzero(parted[:n])
    total = np.add.reduceat(own, begin) if n else own
    out = np.zeros(n, bool)
    out[sa] = np.repeat(total > 1, np.diff(np.append(begin, n))) & valid[sa]
    return out


_MARKS = "kh long, c1 long, c2 long, s int, e int"


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of each context; rows come sorted by anchor, and anchors are never split."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[4]) + 1 for r in rows])
        begin = np.cumsum(sizes) - sizes
        sym = np.frombuffer(b"\x00".join([*(r[4] for r in rows), b""]), np.uint8).astype(np.uint64) + np.uint64(1)
        sym[begin + sizes - 1] = 0
        owner = np.repeat(np.arange(len(rows)), sizes)
        valid = np.arange(len(sym)) < (begin + sizes - SIZE)[owner]
        found = repeated(sym, valid, SIZE, np.array([r[3] for r in rows])[owner])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
        start, stop = edge[0::2], edge[1::2]  # a run never passes a context's end, where no window starts
        own = owner[start]
        cols = [pa.array([rows[i][k] for i in own.tolist()], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(start - begin[own], pa.int32()), pa.array(stop - begin[own], pa.int32())], names=["kh", "c1", "c2", "s", "e"])

    held: list[tuple] = []  # contexts of whole anchors
    group: list[tuple] = []  # contexts of the last anchor
    size = 0

    def close() -> int:
        """Take the last anchor's contexts in, unless they are one occurrence, which repeats nothing."""
        if len(group) == 1 and group[0][3] == 1:
            return 0
        held.extend(group)
        return sum(len(x[4]) for x in group)

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("kh", "c1", "c2", "n", "bytes")), strict=True):
            if group and r[0] != group[0][0]:
                size += close()
                group = []
                if size >= BATCH_BYTES:
                    yield settle(held)
                    held, size = [], 0
            group.append(r)
    close()
    if held:
        yield settle(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    for b in batches:
        out: list[tuple] = []
        for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in want:
                a, dist, n = w["at"] >> _FIRST, w["at"] >> _BYTE & 0xFF, w["at"] & 0xFF
                out.append((w["kh"], w["c1"], w["c2"], w["n"], dist, raw[a : a + n + SIZE - 1]))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kh", "c1", "c2", "n", "dist", "bytes"])


def refined(data: bytes, dist: int, wide: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(part, first window, its distance to the anchor, bytes of its windows, bytes that all windows of the part share) of a context.

    A part holds the windows whose distance to the anchor is the same multiple of ``wide``; equal
    windows have equal distances, so they come into one part and share those bytes.
    """
    first, n = 0, len(data) - SIZE + 1
    while first < n:
        part = (dist - first) // wide
        stop = min(n, dist - part * wide + 1)  # behind the last window of the part
        shared = data[dist - part * wide : dist - part * wide - wide + 1 + SIZE]
        yield part, first, dist - first, data[first : stop + SIZE - 1], shared
        first = stop


def _refined(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, keys, parts = [], [], []
            for kh, c1, c2, n, dist, data in zip(*(b.column(c).to_pylist() for c in ("kh", "c1", "c2", "n", "dist", "bytes")), strict=True):
                for part, first, d, own, shared in refined(data, dist, wide):
                    out.append((kh, c1, c2, first, n, d, own))
                    keys.append(b"%d,%d," % (kh, part) + shared)
                    parts.append(own)
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            names = [_digests(keys)[0], *_digests(parts)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, names), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["kh", "c1", "c2", "up_kh", "up_c1", "up_c2", "first", "n", "dist", "bytes"])

    return run


def _repeated_windows(units: DataFrame) -> DataFrame:
    """``kh, c1, c2, s, e``: the repeated windows of distinct contexts ``units``, as ranges from each context's first one."""
    ready, origins = None, []
    name = ["kh", "c1", "c2"]
    for wide in (*WIDTHS, None):
        hot = saved(units.groupBy("kh").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > BATCH_BYTES).select("kh"), "hot-anchors") if wide else None
        if hot is None or hot.isEmpty():
            ready = units if ready is None else ready.unionByName(units)
            break
        cold = units.join(hot, "kh", "left_anti")
        ready = cold if ready is None else ready.unionByName(cold)
        split = units.join(hot, "kh", "left_semi").mapInArrow(B.bounded(_refined(wide)), "kh long, c1 long, c2 long, up_kh long, up_c1 long, up_c2 long, first int, n long, dist int, bytes binary")
        split = saved(split, "context-parts")
        origins.append(split.select(*name, "up_kh", "up_c1", "up_c2", "first"))
        units = saved(split.groupBy(*name).agg(F.sum("n").alias("n"), F.first("dist").alias("dist"), F.first("bytes").alias("bytes")), "part-bytes")
    found = ready.repartition("kh").sortWithinPartitions("kh").mapInArrow(B.bounded(_expanded), _MARKS)
    if not origins:
        return found
    # what was found in parts goes back level by level, to the contexts they were cut from
    found = saved(found, "found-windows")
    for origin in reversed(origins):
        up = found.join(origin, name).select(*(F.col(f"up_{c}").alias(c) for c in name), (F.col("s") + F.col("first")).alias("s"), (F.col("e") + F.col("first")).alias("e"))
        found = found.unionByName(up)
    return found


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, a, z``: byte ranges under repeated strings; they may overlap."""
    rows = saved(keyed(docs, id_col, text_col).mapInArrow(B.bounded(_anchored), _ANCHORS), "anchors")
    # the range keeps an anchor's rows side by side and still splits a hot one over many tasks
    dealt = rows.repartitionByRange("kh", "c1", "c2", "k1", "k2", "at").sortWithinPartitions("kh")
    some = saved(dealt.mapInArrow(_shared, _ANCHORS), "anchor-rows")
    discard(rows)
    contexts = some.groupBy("kh", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("x"))
    want = contexts.groupBy("x.k1", "x.k2").agg(F.collect_list(F.struct("kh", "c1", "c2", "n", "x.at")).alias("want"))
    texts = keyed(docs, id_col, text_col).join(want, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "want")
    units = saved(texts.mapInArrow(B.bounded(_cut_out), _UNITS), "context-bytes")
    found = saved(_repeated_windows(units), "end-marks")
    start = F.shiftright("at", _FIRST)
    return some.join(found, ["kh", "c1", "c2"]).select("k1", "k2", (start + F.col("s")).alias("a"), (start + F.col("e") + SIZE - 1).alias("z"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for r in sorted(ranges or [], key=lambda r: r["a"]):
                if spans and r["a"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["z"])
                else:
                    spans.append([r["a"], r["z"]])
            edges = [0, *(p for s in spans for p in s), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edges[0::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in spans]))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row."""
    marks = repeated_ranges(docs, id_col, text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))
    joined = keyed(docs, id_col, text_col).join(marks, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "ranges")
    return joined.mapInArrow(B.bounded(_kept), "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
