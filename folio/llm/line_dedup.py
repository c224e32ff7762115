"""Line dedup: range-partitioned line hashes, secondary sort, keep bitmaps.

Every line's key (ends stripped of ASCII white space, A-Z lower-cased) is named by 128 bits of its
SHA-256.  The rows (hash, document, position) are range-partitioned and sorted by all three, so a
very frequent line spreads over as many partitions as it needs.  One streaming pass over each sorted
partition counts the documents of each hash and returns the lines to drop; a run of equal hashes
that touches a partition's edge and is not decided there is settled afterwards from at most two
short runs a partition.  Decisions come back as one compressed bitmap per document; the text is
only touched when they are applied.

Defined cases: null or empty text is one empty line; keys of fewer than ``min_chars`` code points
are never dropped; rows that repeat id and text are one document when counting, and each gets the
result; rows with a null id count as documents of their own by text; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import digest_lanes, discard, keyed, row_key, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"
_RUNS = "kind byte, lead boolean, h1 long, h2 long, k1 long, k2 long, pos int"
DROPPED, OPEN, FREQUENT = 0, 1, 2


def line_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER))
    h1, h2 = digest_lanes(F.col("key"))
    return lines.where(F.length("key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"), "k1", "k2", "pos")


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, n_docs, edge, lead = None, None, 0, True, True
        held: list[np.ndarray] = []  # rows of the current hash while it is undecided

        def out(kind: int, rows: np.ndarray, first: bool):
            lead_col = np.zeros(len(rows), bool)
            lead_col[:1] = first
            kinds = np.full(len(rows), kind, np.int8)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(lead_col), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)), pa.array(rows[:, 4].astype(np.int32))], names=["kind", "lead", "h1", "h2", "k1", "k2", "pos"])

        def closed(at_edge: bool):
            """What is left of the current hash when it ends."""
            if at_edge and n_docs >= min_docs:
                yield out(FREQUENT, np.array([[*key, 0, 0, 0]], np.int64), False)
            elif at_edge and held:
                yield out(OPEN, np.concatenate(held), True)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            h, d = rows[:, :2], rows[:, 2:4]
            new = np.ones(len(rows), bool)
            new[1:] = (h[1:] != h[:-1]).any(1)
            fresh = new.copy()
            fresh[1:] |= (d[1:] != d[:-1]).any(1)
            cuts = np.append(np.flatnonzero(new), len(rows))
            docs = np.add.reduceat(fresh.astype(np.int64), cuts[:-1])
            drop = []
            inner = range(len(cuts) - 1)
            # whole runs inside the batch are decided at once; the first and last need the state
            if len(cuts) > 3:
                big = np.flatnonzero(docs[1:-1] >= min_docs) + 1
                if len(big):
                    take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in big])
                    firsts = np.zeros(len(take), bool)
                    firsts[np.concatenate([[0], np.cumsum(np.diff(cuts)[big])[:-1]])] = True
                    drop.append((take, firsts))
                inner = (0, len(cuts) - 2)
            for j in inner:
                part = rows[cuts[j] : cuts[j + 1]]
                k, n = (int(part[0, 0]), int(part[0, 1])), int(docs[j])
                if k != key:
                    if key is not None:
                        yield from closed(edge)
                        edge = False
                    if j and len(cuts) > 3:
                        edge = False
                    key, doc, n_docs, held, lead = k, None, 0, [], True
                n_docs += n - (doc == (int(part[0, 2]), int(part[0, 3])))
                doc = (int(part[-1, 2]), int(part[-1, 3]))
                if n_docs < min_docs:
                    held.append(part)
                else:
                    for x in [*held, part]:
                        yield out(DROPPED, x, lead)
                        lead = False
                    held = []
            for take, firsts in drop:
                x = rows[take]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int8)), pa.array(firsts), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(4)), pa.array(x[:, 4].astype(np.int32))], names=["kind", "lead", "h1", "h2", "k1", "k2", "pos"])
        if key is not None:
            yield from closed(True)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, pos`` of each line to drop: its key is in at least ``min_docs`` documents.

    ``keep_first``: the first line of each such key, by document and position, stays.
    """
    # dealing by range reads its rows twice, so the lines are split once and kept as hashes
    lines = saved(line_keys(keyed(docs, id_col, text_col), min_chars), "line-keys")
    dealt = lines.repartitionByRange("h1", "h2", "k1", "k2", "pos").sortWithinPartitions("h1", "h2", "k1", "k2", "pos")
    runs = saved(dealt.mapInArrow(_stream(min_docs), _RUNS), "line-runs")
    discard(lines)
    open_ = runs.where(F.col("kind") == OPEN)
    # at most two short runs a partition are open, so this aggregate and join are small
    settled = (
        runs.where(F.col("kind") != DROPPED).groupBy("h1", "h2")
        .agg(F.max((F.col("kind") == FREQUENT).cast("int")).alias("frequent"),
             F.count_distinct(F.when(F.col("kind") == OPEN, F.struct("k1", "k2"))).alias("n"))
        .where((F.col("frequent") == 1) | (F.col("n") >= min_docs)).select("h1", "h2")
    )
    gone = runs.where(F.col("kind") == DROPPED).unionByName(open_.join(settled, ["h1", "h2"]).select(*runs.columns))
    if keep_first:
        lead = gone.where("lead").groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "pos")).alias("first"))
        lead = lead.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.pos").alias("pos"))
        gone = gone.join(lead, ["k1", "k2", "pos"], "left_anti")
    return gone.select("k1", "k2", "pos")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for at in b.column("at").to_pylist():
            keep = np.ones((max(at) // 8 + 1) * 8, bool)  # whole bytes: lines behind the end stay
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(maps, pa.binary())], names=["k1", "k2", "keep"])


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """``k1, k2, keep`` of each document that loses a line.

    ``keep`` is a zlib-compressed bitmap, a bit a line from the first on; lines behind its end stay.
    """
    gone = dropped_lines(docs, **options).groupBy("k1", "k2").agg(F.collect_list("pos").alias("at"))
    return gone.mapInArrow(_packed, "k1 long, k2 long, keep binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, n_dropped = b.column("text"), []
        maps = b.column("keep").to_pylist()
        if any(m is not None for m in maps):
            new = texts.to_pylist()
            for i, m in enumerate(maps):
                if m is None:
                    n_dropped.append(0)
                    continue
                keep = np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8))
                lines = new[i].split("\n")
                stay = [x for j, x in enumerate(lines) if j >= len(keep) or keep[j]]
                n_dropped.append(len(lines) - len(stay))
                new[i] = "\n".join(stay)
            texts = pa.array(new, pa.string())
        else:
            n_dropped = [0] * b.num_rows
        cols = [texts if n == "text" else b.column(n) for n in b.schema.names if n != "keep"]
        names = [n for n in b.schema.names if n != "keep"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_dropped, pa.int64())], names=[*names, "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, text, n_lines, n_dropped`` for each row, ``text`` with its lines dropped."""
    maps = keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, id_col=id_col, text_col=text_col)
    return apply_bitmaps(keyed(docs, id_col, text_col).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")), maps)


def apply_bitmaps(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """``rows`` (with ``k1, k2, text``) without the lines that their bitmaps leave out, and ``n_dropped``."""
    joined = rows.join(maps, ["k1", "k2"], "left").select(*rows.columns, "keep")
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return joined.mapInArrow(B.bounded(_kept), fields + ", n_dropped long")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they were but for the text and its length ``n_chars``."""
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    rows = docs.select(*row_key(id_col, text_col), *[F.col(f"`{c}`").alias(n) for c, n in others.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = apply_bitmaps(rows, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options))
    size = {"n_chars": F.length("text").cast("long")}
    return kept.select(*[size.get(c, F.col(others.get(c, "text"))).alias(c) for c in docs.columns])
