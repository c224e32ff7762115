"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts texts where five of its bits are zero, at least
``MIN_CHUNK`` and at most ``MAX_CHUNK`` bytes apart, so an insertion moves only the cuts beside
it.  Chunks are compared by a 128-bit digest over the whole corpus.  Chunks that occur once are
left out before anything is gathered; runs of neighbouring repeated chunks of at least
``min_run`` bytes are repeated passages, and all but the first copy of their chunks (by document
and offset) go.

Defined cases: a null text is empty; rows that repeat id and text are occurrences like any other
but share one decision; null ids come before all others; runs shorter than ``min_run`` stay; an
empty table gives no rows; extra columns are ignored.
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

MIN_CHUNK, MAX_CHUNK = 24, 128
_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, np.uint32)
_CUT = np.uint32(0b11111 << 15)
_CHUNKS = "h1 long, h2 long, k1 long, k2 long, at long"
_PART = 16  # an offset and a length (below 2**16) share one long


def gear(raw: np.ndarray) -> np.ndarray:
    """Sum of ``gear[byte j back] << j`` over 16 bytes, by doubling."""
    h, size = _GEAR[raw], 1
    while size < 16:
        older = np.zeros_like(h)
        older[size:] = h[:-size]
        h = h + (older << np.uint32(size))
        size *= 2
    return h


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Ends of the bytes whose hash asks for a cut; worked out in parts, so memory does not grow with a text."""
    found = []
    for a in range(0, len(raw), B.SLICE):
        lead = min(a, 15)
        h = gear(raw[a - lead : a + B.SLICE])[lead:]
        found.append(np.flatnonzero((h & _CUT) == 0) + a + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(raw: np.ndarray, starts: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each text of a slice."""
    cuts = cut_places(raw).tolist()
    at = 0
    for begin, stop in zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True):
        ends, last = [], begin
        while at < len(cuts) and cuts[at] < stop:
            cut = cuts[at]
            at += 1
            if cut - last < MIN_CHUNK:
                continue
            while cut - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if cut - last >= MIN_CHUNK:
                ends.append(cut)
                last = cut
        while stop - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if stop > last:
            ends.append(stop)
        while at < len(cuts) and cuts[at] <= stop + 1:  # the separator belongs to no text
            at += 1
        yield ends


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
        for first, raw, starts in B.slices(b.column("text").to_pylist()):
            data, digests, at, owner = raw.tobytes(), [], [], []
            for i, ends in enumerate(chunk_ends(raw, starts)):
                begin = last = int(starts[i])
                for z in ends:
                    digests.append(hashlib.blake2b(data[last:z], digest_size=16).digest())
                    at.append((last - begin) << _PART | (z - last))
                    last = z
                owner.append(len(ends))
            own = np.repeat(np.arange(first, first + len(owner)), owner)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(k1[own]), pa.array(k2[own]), pa.array(at, pa.int64())], names=["h1", "h2", "k1", "k2", "at"])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, at, first`` of chunks that occur more than once; ``first``: the copy that stays."""
    chunks = saved(keyed(docs, id_col, text_col).mapInArrow(B.bounded(_chunked), _CHUNKS), "chunks")
    often = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    copies = saved(chunks.join(often, ["h1", "h2"]), "chunk-copies")
    discard(chunks)
    place = F.struct("k1", "k2", "at")
    firsts = copies.groupBy("h1", "h2").agg(F.min(place).alias("x"))
    return copies.join(firsts, ["h1", "h2"]).select("k1", "k2", "at", (place == F.col("x")).alias("first"))


def _kept(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, chunks in zip(b.column("text").to_pylist(), b.column("chunks").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone, repeated = [], 0
                group: list[tuple[int, int, bool]] = []
                for x in [*sorted(((c["at"] >> _PART, c["at"] & 0xFFFF, c["first"]) for c in chunks or []), key=lambda c: c[:2]), None]:
                    if group and (x is None or x[0] != group[-1][0] + group[-1][1]):
                        if (size := group[-1][0] + group[-1][1] - group[0][0]) >= min_run:
                            repeated += size
                            gone += [(a, a + n) for a, n, first in group if not first]
                        group = []
                    if x is not None:
                        group.append(x)
                spans: list[list[int]] = []
                for a, z in gone:
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = z
                    else:
                        spans.append([a, z])
                edges = [0, *(p for s in spans for p in s), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[0::2], edges[1::2]))
                rows.append((len(raw), repeated, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in spans]))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_bytes", "n_repeated", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k1", "k2", "doc_id", *names])

    return run


def dedup_substrings(docs: DataFrame, min_run: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, spans`` of each row.

    ``n_repeated``: bytes in repeated passages, first copies included; ``spans``: the bytes removed.
    """
    found = repeated_chunks(docs, id_col, text_col).dropDuplicates(["k1", "k2", "at"])
    per_doc = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "first")).alias("chunks"))
    joined = keyed(docs, id_col, text_col).join(per_doc, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "chunks")
    return joined.mapInArrow(B.bounded(_kept(min_run)), "k1 long, k2 long, doc_id long, n_bytes long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
