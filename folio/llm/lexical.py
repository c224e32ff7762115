"""Ranked lexical search with block-max pruning.

The index is a table of blocks.  A block is a range of documents as the table stores them, so
building it shuffles nothing.  It holds a compressed forward index (each document's terms and their
numbers), which is read only when the block is scored, and for each of its terms the number of its documents that have it, the largest number of
occurrences and the shortest of those documents.  The last two bound the term's part of any score
in the block, whatever the corpus's statistics are; blocks may be added later.

Queries are answered in batches of a bounded number of terms, each in three passes over the index
that read the columns they need:

1. document frequencies of the batch's terms;
2. of every ``BLOCKS`` blocks a task reads, it scores the one with the largest bound for each query.
   The ``top``-th best of these scores is a threshold that no answer is below;
3. every ``BLOCKS`` blocks are sorted by a query's bound and scored until the bound is below the
   threshold, which rises with the best scores of the task.

A task returns at most ``top`` rows of a query; equal bounds are scored, since a tie may go to a
smaller id.  Nothing is left out: a block that is passed over cannot hold an answer.

Scores are whole numbers: the sum over a query's distinct terms of ``w * ((10**9 tf) div (1000 tf
+ 20 m))``, where ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div L``.

Defined cases: a null text has no terms; documents without terms are not counted and never found;
a query without terms, or whose terms no document has, gives no rows; rows that share a query id
(null too) are one query with the terms of all; repeated documents are found each by itself; null
document ids come behind others of their score; an empty table gives no rows; extra columns are
ignored.  A very long text is split into terms piece by piece and is a block of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import saved, small_batches

#: Documents and postings that close a block, bytes of a text that are split at once, blocks in an Arrow batch.
BLOCK_DOCS, BLOCK_POSTINGS, PIECE, BLOCKS = 16, 1 << 14, 1 << 20, 64
_NO_DOC = 2**63 - 1  # behind all ids
#: Terms of the queries that are answered together, and files that hold the queries.
BATCH_TERMS, QUERY_FILES = 1 << 16, 8
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_INDEX = "docs binary, terms binary, heads binary, lists binary, n_docs int, n_terms long"
_FOUND = "item_id long, doc_id long, score long"


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term; only A-Z are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(raw) <= PIECE:
        return Counter(_TERM.findall(raw))
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        stop = gap.start() if gap else len(raw)
        found.update(_TERM.findall(raw, at, stop))
        at = stop
    return found


def _packed(*columns: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate(columns).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4").astype(np.int64)


def _block(held: list[tuple[int | None, Counter]]) -> tuple:
    """A row of the index: ids; terms, parted by line ends; three numbers a term; the forward index."""
    names: dict[bytes, int] = {}
    term, tf, ends = [], [], []
    for _, counts in held:
        term += [names.setdefault(t, len(names)) for t in counts]
        tf += counts.values()
        ends.append(len(term))
    n = np.array([c.total() for _, c in held])
    owner = np.repeat(np.arange(len(held)), np.diff(ends, prepend=0))
    at, times = np.array(term), np.array(tf)
    most, least = np.zeros(len(names), np.int64), np.full(len(names), n.max())
    np.maximum.at(most, at, times)
    np.minimum.at(least, at, n[owner])
    docs = np.array([_NO_DOC if i is None else i for i, _ in held], "<i8")
    return docs.tobytes(), zlib.compress(b"\n".join(names), 1), _packed(np.bincount(at), most, least), _packed(n, np.array(ends), at, times), len(held), int(n.sum())


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, Counter]] = []
    blocks: list[tuple] = []
    postings = 0

    def out() -> pa.RecordBatch:
        kinds = [pa.binary()] * 4 + [pa.int32(), pa.int64()]
        rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds, strict=True)], names=[f.split()[0] for f in _INDEX.split(", ")])
        blocks.clear()
        return rows

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            counts = term_counts(text.as_py())
            if not counts:
                continue
            held.append((doc, counts))
            postings += len(counts)
            if len(held) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                blocks.append(_block(held))
                held, postings = [], 0
            if len(blocks) >= BLOCKS:
                yield out()
    if held:
        blocks.append(_block(held))
    if blocks:
        yield out()


@dataclass(frozen=True)
class Index:
    """Blocks of a corpus, the number of its documents with a term, and of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Build the index of all rows of ``docs``, in the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = saved(rows.mapInArrow(B.bounded(_indexed), _INDEX), "lexical-blocks")
    size = blocks.agg(F.sum("n_docs").alias("documents"), F.sum("n_terms").alias("terms")).first()
    return Index(blocks, size["documents"] or 0, size["terms"] or 0)


@dataclass
class _Batch:
    """Queries with their terms as numbers of a vocabulary, in runs of ``starts``."""

    ids: list[int | None] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    entries: list[int] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def add(self, item: int | None, terms: list[str]) -> None:
        self.ids.append(item)
        self.starts.append(len(self.entries))
        self.entries += [self.vocabulary.setdefault(t.encode("utf-8", "surrogatepass"), len(self.vocabulary)) for t in terms]


def _batches(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[_Batch]:
    """The queries, so many at once that they have about ``most`` terms; only these are on the driver."""
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    terms = items.select(F.col(id_col).cast("long").alias("item"), F.explode(F.array_distinct(found)).alias("term")).groupBy("item").agg(F.collect_set("term").alias("terms"))
    batch = _Batch()
    for row in saved(terms.coalesce(QUERY_FILES), "lexical-queries").toLocalIterator():
        if len(batch.entries) >= most:
            yield batch
            batch = _Batch()
        batch.add(row["item"], row["terms"])
    if batch.ids:
        yield batch


def _known(terms: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The vocabulary's number of each of a block's terms, -1 for others."""
    return np.array([vocabulary.get(t, -1) for t in zlib.decompress(terms).split(b"\n")])


def _frequencies(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for terms, heads in zip(b.column("terms"), b.column("heads"), strict=True):
                at = _known(terms.as_py(), vocabulary)
                total[at[at >= 0]] += _unpacked(heads.as_py())[: len(at)][at >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Best:
    """The best rows of one query so far, and the score that a row has to reach."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, max(1, least)
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        fine = scores >= self.least
        if not fine.any():
            return
        self.scores, self.docs = np.append(self.scores, scores[fine]), np.append(self.docs, docs[fine])
        if len(self.scores) >= self.top:
            order = np.lexsort((self.docs, -self.scores))[: self.top]
            self.scores, self.docs = self.scores[order], self.docs[order]
            self.least = max(self.least, int(self.scores[-1]))


class _Search:
    """What a task needs to answer a batch of queries."""

    def __init__(self, index: Index, batch: _Batch, df: dict[int, int], top: int):
        self.documents, self.length, self.top = index.documents, index.terms, top
        self.ids, self.vocabulary = batch.ids, batch.vocabulary
        weights = np.array([weight(self.documents, df[t]) if t in df else 0 for t in range(len(batch.vocabulary))], np.int64)
        self.starts, self.entries, self.weights = np.array(batch.starts), np.array(batch.entries), weights

    def part(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A term's share of a score, before its weight."""
        sizes, of = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * x * self.documents // self.length for x in sizes.tolist()], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 20 * m[of])

    def bounds(self, terms: bytes, heads: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of a block's terms, the most that any of its documents can score for each query)."""
        at = _known(terms, self.vocabulary)
        asked = at >= 0
        _, most, least = _unpacked(heads).reshape(3, -1)
        dense = np.zeros(len(self.weights), np.int64)
        dense[at[asked]] = self.part(most[asked], least[asked])
        return at, np.add.reduceat((dense * self.weights)[self.entries], self.starts)

    def opened(self, docs: bytes, lists: bytes, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, first posting of each, terms, shares) of a block, without what no query asks for."""
        ids, flat = np.frombuffer(docs, "<i8"), _unpacked(lists)
        n, ends, rest = flat[: len(ids)], flat[len(ids) : 2 * len(ids)], flat[2 * len(ids) :]
        term, tf = rest.reshape(2, -1)
        owner = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        at = names[term]
        asked = at >= 0
        owner, at = owner[asked], at[asked]
        has, first = np.unique(owner, return_index=True)
        return ids[has], first, at, self.part(tf[asked], n[owner])

    def run(self, best: list[_Best], b: pa.RecordBatch, only_first: bool) -> None:
        found = [self.bounds(t.as_py(), h.as_py()) for t, h in zip(b.column("terms"), b.column("heads"), strict=True)]
        bounds = np.stack([x for _, x in found])
        order = np.argsort(-bounds, axis=0, kind="stable")
        opened: dict[int, tuple] = {}
        weights = np.zeros_like(self.weights)
        ends = np.append(self.starts[1:], len(self.entries))
        for q, own in enumerate(best):
            terms = self.entries[self.starts[q] : ends[q]]
            weights[terms] = self.weights[terms]
            for i in order[: 1 if only_first else None, q].tolist():
                if bounds[i, q] < own.least:
                    break
                if i not in opened:
                    opened[i] = self.opened(b.column("docs")[i].as_py(), b.column("lists")[i].as_py(), found[i][0])
                docs, first, at, share = opened[i]
                own.add(np.add.reduceat(share * weights[at], first), docs)
            weights[terms] = 0

    def task(self, least: dict[int, int], only_first: bool):
        """``least``: for queries by number, the score that their rows have to reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(self.top, least.get(q, 1)) for q in range(len(self.ids))]
            for b in batches:
                for at in range(0, b.num_rows, BLOCKS):
                    self.run(best, b.slice(at, BLOCKS), only_first)
            for q, x in enumerate(best):
                if len(x.scores):
                    ids = pa.array([self.ids[q]] * len(x.scores), pa.int64())
                    none = pa.array(x.docs == _NO_DOC)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.scores), q, np.int32)), ids, pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(x.docs)), pa.array(x.scores)], names=["q", "item_id", "doc_id", "score"])

        return run


def _answered(index: Index, batch: _Batch, top: int) -> DataFrame:
    found = index.blocks.select("terms", "heads").mapInArrow(B.bounded(_frequencies(batch.vocabulary)), "term int, df long")
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a number a term of the batch
    search = _Search(index, batch, df, top)
    fields = "q int, " + _FOUND
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    blocks = index.blocks.select("docs", "terms", "heads", "lists")
    seeds = blocks.mapInArrow(B.bounded(search.task({}, True)), fields).withColumn("nth", nth).where(F.col("nth") <= top)
    least = {r["q"]: r["score"] for r in seeds.where(F.col("nth") == top).collect()}  # a row a query
    rows = blocks.mapInArrow(B.bounded(search.task(least, False)), fields)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, top: int = 50, id_col: str = "item_id", text_col: str = "text", batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest scores for each query."""
    spark = index.blocks.sparkSession
    found: list[DataFrame] = []
    for batch in _batches(queries, id_col, text_col, batch_terms) if index.documents else ():
        if found:  # kept batch by batch, so that many do not become one long plan
            found[-1] = saved(found[-1], "lexical-found")
        found.append(_answered(index, batch, top))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
