"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.  A window is
``window`` consecutive words of an item; an item with fewer words is one window of all of them.
The fingerprint of a window is the smallest hash of the ``window - gram + 1`` runs of ``gram``
words in it, so every run of ``window`` shared words has a fingerprint that both sides keep.  The
documents' fingerprints are joined with the benchmark's; around each hit the windows that the
fingerprint stands for are extended to their full length, word by word to both sides, and their
128-bit hashes are joined with those of the benchmark's windows.  Items shorter than a window have
no such fingerprint; they are found by all runs of their length.

A benchmark of up to ``LOCAL_MARKS`` fingerprints goes to every task as one sorted array, so the
documents are read once and never shuffled.  A larger one is joined by a shuffle of the
documents' fingerprints.

Defined cases: null or wordless texts have no words and are clean; wordless items never occur;
repeated rows each get the result; a null id is a document by its text; null item ids count as
hits but not as items; an empty table on either side gives clean or no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .store import keyed, row_key, saved

#: Fingerprints (8 bytes each) that are sent to every task at most.
LOCAL_MARKS = 2_000_000
#: Up to this many benchmark windows (about 64 MB) the window table is broadcast, else shuffled.
BROADCAST_WINDOWS = 1_000_000
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NEAR = "near array<struct<start:int,size:int,w1:long,w2:long>>"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fingerprints(word: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of each window of consecutive words, across texts too."""
    return B.sliding_min(B.grams(word, gram), window - gram + 1)


def _inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words lie in one text."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)


def _item_windows(window: int, gram: int):
    classes = B.table(WORD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw, starts in B.slices(b.column("text").to_pylist()):
                word, _, _, doc = B.words(raw, starts, classes)
                count = np.bincount(doc, minlength=len(starts) - 1)
                for n in sorted({min(window, x) for x in count.tolist() if x}):
                    # an item of fewer words than a window is one window of its own
                    at = np.flatnonzero(_inside(doc, n) & (n == window or count[doc[: len(doc) - n + 1]] == n))
                    w1, w2 = (B.grams(x, n, lane, at) for lane, x in enumerate(word))
                    mark = fingerprints(word[0], window, gram)[at] if n == window else w1
                    item = b.column("item_id").take(pa.array(first + doc[at]))
                    yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(at), n, np.int32)), _signed(w1), _signed(w2), _signed(mark)], names=["item_id", "size", "w1", "w2", "mark"])

    return run


def item_windows(items: DataFrame, window: int, gram: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_item_windows(window, gram), "item_id string, size int, w1 long, w2 long, mark long")


def _runs(texts: list[str], window: int) -> Iterator[tuple[int, bool, int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(first text, last run of it, words before, words that an earlier run had, hashes, text of each word, words of each text)."""
    left: list[np.ndarray] = []
    before = 0
    for first, more, ends, found, count in B.word_runs(texts, B.table(WORD_BYTES)):
        own = [np.concatenate(x) for x in zip(left, found, strict=True)] if more else found
        old = len(left[0]) if more else 0
        before = before if more else 0
        yield first, ends, before - old, old, own, np.repeat(np.arange(len(count)), count) if not more else np.zeros(len(own[0]), np.int64), count
        before += int(count[0])
        left = [x[max(0, len(x) - window + 1) :] for x in own]


def _marks(word: list[np.ndarray], doc: np.ndarray, old: int, sizes: list[int], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, fingerprints) of the windows that may be the benchmark's; ``old`` words were there before."""
    if window in sizes and len(doc) >= window:
        at = np.flatnonzero(_inside(doc, window))
        yield window, at, fingerprints(word[0], window, gram)[at]
    for n in sizes:
        if n < window and len(doc) >= n:
            at = np.flatnonzero(_inside(doc, n))
            at = at[at + n > old]
            yield n, at, B.grams(word[0], n, 0, at)


def _kept_marks(sizes: list[int], window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, _, old, word, doc, count in _runs(b.column("text").to_pylist(), window):
                for _, at, mark in _marks(word, doc, old, sizes, window, gram):
                    # neighbouring windows mostly share a fingerprint
                    new = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (doc[at[1:]] != doc[at[:-1]]))[: len(at)])
                    row = pa.array(first + doc[at[new]])
                    yield pa.RecordBatch.from_arrays([b.column("k1").take(row), b.column("k2").take(row), _signed(mark[new])], names=["k1", "k2", "mark"])

    return run


def _extended(shared, sizes: list[int], window: int, gram: int):
    """Per document: its number of words, and the windows whose fingerprint the benchmark has.

    ``shared``: the benchmark's fingerprints, sorted; none: each row brings those of its hits.
    """
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = shared.value if shared is not None else np.unique(b.column("marks").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n_words = np.zeros(b.num_rows, np.int64)
            hits: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for first, _, base, old, word, doc, count in _runs(b.column("text").to_pylist(), window):
                n_words[first : first + len(count)] += count
                begin = np.cumsum(count) - count - base
                for size, at, mark in _marks(word, doc, old, sizes, window, gram):
                    if not len(known):
                        break
                    at = at[known[np.minimum(np.searchsorted(known, mark), len(known) - 1)] == mark]
                    w1, w2 = (B.grams(x, size, lane, at).view(np.int64).tolist() for lane, x in enumerate(word))
                    for p, d, x, y in zip((at - begin[doc[at]]).tolist(), doc[at].tolist(), w1, w2, strict=True):
                        hits[first + d].append({"start": p, "size": size, "w1": x, "w2": y})
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array(n_words), pa.array(hits, hit_type)], names=["k1", "k2", "doc_id", "n_words", "near"])

    return run


def near_windows(docs: DataFrame, marks: DataFrame, sizes: list[int], window: int, gram: int) -> DataFrame:
    """``k1, k2, doc_id, n_words, near`` of keyed documents; ``near``: windows whose fingerprint is one of ``marks``."""
    spark = docs.sparkSession
    marks = saved(marks.distinct(), "bench-marks")
    fields = f"k1 long, k2 long, doc_id long, n_words long, {_NEAR}"
    if marks.count() <= LOCAL_MARKS:
        sent = np.sort(marks.toArrow().column("mark").to_numpy().view(np.uint64))
        return docs.mapInArrow(B.bounded(_extended(spark.sparkContext.broadcast(sent), sizes, window, gram)), fields)
    kept = docs.select("k1", "k2", "text").mapInArrow(B.bounded(_kept_marks(sizes, window, gram)), "k1 long, k2 long, mark long")
    hits = kept.join(marks, "mark").groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks"))
    rows = docs.join(hits, ["k1", "k2"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<long>")))
    return rows.select("k1", "k2", "doc_id", "text", "marks").mapInArrow(B.bounded(_extended(None, sizes, window, gram)), fields)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, n_words, n_hit, items`` (sorted item ids) for each row of ``docs``."""
    windows = saved(item_windows(items, window, gram, item_col, item_text_col), "bench-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` values
    near = saved(near_windows(keyed(docs, id_col, text_col), windows.select("mark"), sizes, window, gram), "bench-near")
    hint = F.broadcast if windows.count() <= BROADCAST_WINDOWS else (lambda x: x)
    keys = ["size", "w1", "w2"]
    at = near.where(F.size("near") > 0).select("k1", "k2", F.explode("near").alias("x")).select("k1", "k2", "x.*")
    true = at.join(hint(windows.select(*keys).distinct()), keys).dropDuplicates(["k1", "k2", "start", "size"])
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "size"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda z, x: F.struct(
            (z["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["size"] - F.greatest(z["end"], x["start"].cast("long")))).alias("n"),
            F.greatest(z["end"], (x["start"] + x["size"]).cast("long")).alias("end")),
        lambda z: z["n"])
    n_hit = true.groupBy("k1", "k2").agg(covered.alias("n_hit"))
    named = (
        true.select("k1", "k2", *keys).distinct().join(hint(windows.select(*keys, "item_id").where("item_id is not null").distinct()), keys)
        .select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    return (
        near.select("k1", "k2", "doc_id", "n_words").join(n_hit, ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
        .select("k1", "k2", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that hold no window of the benchmark."""
    dirty = saved(contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0").select("k1", "k2").distinct(), "bench-dirty")
    others = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*row_key(id_col, text_col), *[F.col(f"`{c}`").alias(n) for c, n in others.items()]).join(dirty, ["k1", "k2"], "left_anti")
    return rows.select(*[F.col(n).alias(c) for c, n in others.items()])
