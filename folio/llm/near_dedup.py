"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles.  A signature is ``HASHES`` minima, of which
``b`` = 16 bits each are kept.  Signatures within ``RADIUS`` differing symbols are found without
loss: ``CHUNKS`` chunks cannot all hold more than ``RADIUS // CHUNKS`` = 1 error, so each
document's key list has every chunk with each one symbol left out, and two signatures within the
radius share a key.  A pair at the similarity threshold of 0.85 differs in 9.6 of 64 symbols on
average and in more than 24 once in several hundred thousand pairs.  For thresholds from 0.80 to
below 0.85 there are ``WIDE_CHUNKS`` chunks for ``WIDE_RADIUS``: a pair at 0.80 differs in 12.8
symbols on average and in more than 29 with odds of 1.2 in a million.

Equal sets are one node from the start.  Links are only wanted for classes, so no group is
expanded into pairs: every member of a bucket is first compared with the bucket's smallest and
largest node, and the classes this gives are contracted.  Buckets whose other members are still
of several classes are then compared completely between classes, all of them in the same way: the
members of the bucket's largest class stay in their block, the rest meet all blocks, and blocks
are bounded in rows and in bytes.  Signatures find the pairs within the radius that the bucket
owns (it has the first key that both share); texts are sent only for members of such pairs, and
the task that holds both texts settles the pair and returns links that join different classes.

A shingle is 128 bits, in two lanes that share nothing.  Every candidate is confirmed on the full
sets in both lanes.  Links are final when they are made.

Defined cases: texts that are null or have no word have an empty set and are linked with nothing;
texts of fewer words than a shingle are one shingle of all their words; rows that repeat an id
are linked by their texts alone and share the fate of their text; null ids never name a class
unless it has no other id (then the class id is null and the rows are not kept, save rows with an
empty set, which are always kept); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .store import keyed, row_key, saved

HASHES, CHUNKS, RADIUS = 64, 13, 24
# below NARROW_PERCENT, down to LEAST_PERCENT
WIDE_CHUNKS, WIDE_RADIUS, NARROW_PERCENT, LEAST_PERCENT = 15, 29, 85, 80
#: Rows and shingles in a block of a bucket (more only where one text has more), and pairs of one text in a task.
BLOCK_ROWS, BLOCK_SHINGLES, HUB_PAIRS = 1024, 1 << 19, 512
WORD_BYTES = bytes(sorted(set(range(256)) - {0x20, *range(0x09, 0x0E)}))
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, HASHES, np.uint64, endpoint=False)
_EDGES, _WIDE_EDGES = (np.linspace(0, HASHES, n + 1).round().astype(int) for n in (CHUNKS, WIDE_CHUNKS))
_SETS = "k1 long, k2 long, doc_id long, n_shingles long, n1 long, n2 long, sig binary"


def reach(percent: int) -> tuple[int, np.ndarray]:
    """Radius and edges of the chunks for a threshold."""
    return (RADIUS, _EDGES) if percent >= NARROW_PERCENT else (WIDE_RADIUS, _WIDE_EDGES)


Set = tuple[np.ndarray, np.ndarray]


def _distinct(a: np.ndarray, b: np.ndarray) -> Set:
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if (b[1:] != b[:-1])[~new[1:]].any():  # equal in one lane alone
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _grams(word: list[np.ndarray], size: int) -> Set:
    """Shingles of a text's words; of all its words where they are fewer than ``size``."""
    n = min(size, len(word[0]))
    return tuple(B.grams(x, n, lane) if n else x for lane, x in enumerate(word))


def shingle_sets(texts: list[str], size: int) -> Iterator[tuple[int, Set]]:
    """(index of the text, its distinct shingles in both lanes, sorted by the first)."""
    parts: list[Set] = []  # of a long text
    left: list[np.ndarray] = []  # its words that no later shingle may miss
    for first, more, ends, found, count in B.word_runs(texts, B.table(WORD_BYTES)):
        if ends and not more:
            whole = [B.grams(x, size, lane) for lane, x in enumerate(found)]
            begin = np.cumsum(count) - count
            for i, (a, n) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
                yield first + i, _distinct(*(x[a : a + n - size + 1] for x in whole)) if n >= size else _grams([x[a : a + n] for x in found], size)
            continue
        own = [np.concatenate(x) for x in zip(left, found, strict=True)] if more else found
        if len(own[0]) >= size:
            parts.append(_distinct(*_grams(own, size)))
        left = [x[max(0, len(x) - size + 1) :] for x in own]
        if ends:
            yield first, _distinct(*map(np.concatenate, zip(*parts))) if parts else _grams(left, size)
            parts, left = [], []


def common(a: Set, b: Set) -> int:
    """Size of the intersection of two sets."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(HASHES, ~np.uint64(0))
    for i in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[i : i + 512, None] ^ _XOR) * _ODD).min(0), out=least)
    return (B.mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            rows = []
            for _, (s, t) in shingle_sets(b.column("text").to_pylist(), size):
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                name = hashlib.blake2b(t, digest_size=16, key=hashlib.blake2b(s, digest_size=32).digest()).digest()
                if name not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    known[name] = signature(s)
                n1, n2 = np.frombuffer(name, "<i8").tolist()
                rows.append((len(s), n1, n2, known[name]))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))],
                names=["k1", "k2", "doc_id", "n_shingles", "n1", "n2", "sig"])

    return run


def chunk_keys(sigs: np.ndarray, edges: np.ndarray = _EDGES) -> np.ndarray:
    """Keys (rows x HASHES) of signatures: each chunk with each one of its symbols left out."""
    x = B.mix(sigs.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(16)))
    keys = np.empty_like(x)
    for a, z in zip(edges, edges[1:]):
        whole = x[:, a:z].sum(1, dtype=np.uint64)
        for i in range(a, z):
            keys[:, i] = B.mix(whole - x[:, i] + _ODD[i])
    return keys


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _keyed(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = chunk_keys(_matrix(part.column("sig")), edges)
                node = np.repeat(part.column("n1").to_numpy(zero_copy_only=False), HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "n1"])

    return run


def _close(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = (_matrix(b.column("sig_a")) != _matrix(b.column("sig_b"))).sum(1) if b.num_rows else np.zeros(0)
            yield b.filter(pa.array(far <= radius)).drop_columns(["sig_a", "sig_b"])

    return run


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in batches:
            keep = []
            a_key = b.column("ka").to_pylist()
            a_text = b.column("text_a")
            sets_b = (s for _, s in shingle_sets(b.column("text_b").to_pylist(), size))
            for i, (k, sb) in enumerate(zip(a_key, sets_b, strict=True)):
                if held[0] != k:
                    held = (k, next(shingle_sets([a_text[i].as_py()], size))[1])
                keep.append(linked(held[1], sb, percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(a: Set, b: Set, percent: int) -> bool:
    both = common(a, b)
    return 100 * both >= percent * (len(a[0]) + len(b[0]) - both)


def first_keys(x: np.ndarray, others: np.ndarray, edges: np.ndarray, chunk: int, symbol: int, radius: int) -> np.ndarray:
    """Which rows of ``others`` are within the radius of ``x`` and have the key of ``chunk`` without ``symbol`` as the first common one."""
    left = np.arange(len(others))
    for c in range(chunk):  # an earlier chunk with one error at most owns the pair
        wrong = (others[left, edges[c] : edges[c + 1]] != x[edges[c] : edges[c + 1]]).sum(1)
        left = left[wrong > 1]
    differs = others[left, edges[chunk] : edges[chunk + 1]] != x[edges[chunk] : edges[chunk + 1]]
    # without an error in the chunk all of its keys are common, and the first of them is the one without the first symbol
    at = symbol - edges[chunk]
    own = (differs.sum(1) == 1) & differs[:, at] if at else (differs[:, 1:].sum(1) == 0)
    left = left[own]
    return left[(others[left] != x).sum(1) <= radius]


def _owned(key: tuple, rows: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, other rows): pairs of two blocks of a bucket, of different classes, that may be linked and that the bucket owns."""
    radius, edges = reach(percent)
    sig = _matrix(rows.column("sig").combine_chunks())
    n, label, block = (rows.column(c).to_numpy() for c in ("n_shingles", "label", "block"))
    index = int(np.flatnonzero(chunk_keys(sig[:1], edges)[0].view(np.int64) == key[0].as_py())[0])
    chunk = int(np.searchsorted(edges, index, "right")) - 1
    within = key[1].as_py() == key[2].as_py()
    left, right = (np.flatnonzero(block == k.as_py()) for k in key[1:])
    for i, x in enumerate(left.tolist()):
        y = right[i + 1 :] if within else right
        y = y[(label[y] != label[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        y = y[first_keys(sig[x], sig[y], edges, chunk, index, radius)] if len(y) else y
        if len(y):
            yield x, y


_BLOCK = "key long, i int, j int, block int, n1 long, n2 long, label long, n_shingles long, sig binary"


def _asked(percent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The members of two blocks that are in a pair to be settled there."""
        used = np.zeros(rows.num_rows, bool)
        for x, y in _owned(key, rows, percent):
            used[x] = True
            used[y] = True
        return rows.filter(pa.array(used))

    return run


class _Classes:
    """Union and find over a few numbers."""

    def __init__(self, items: np.ndarray):
        self.up = {x: x for x in items.tolist()}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _settled(size: int, percent: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """A spanning forest of the links between classes for two blocks of a bucket."""
        sets = [s for _, s in shingle_sets(rows.column("text").to_pylist(), size)]
        label = rows.column("label").to_numpy()
        classes, out = _Classes(label), []
        n1, n2 = rows.column("n1").to_pylist(), rows.column("n2").to_pylist()
        for x, others in _owned(key, rows, percent):
            for y in others.tolist():
                if classes.root(int(label[x])) != classes.root(int(label[y])) and linked(sets[x], sets[y], percent):
                    classes.join(int(label[x]), int(label[y]))
                    out.append((n1[x], n2[x], n1[y], n2[y]))
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a1", "a2", "b1", "b2"), cols, strict=True)})

    return run


class _Join:
    """The tables that both passes over candidates need."""

    def __init__(self, docs: tuple, sets: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.nodes = saved(sets.where("n_shingles > 0").select("n1", "n2", "n_shingles", "sig").dropDuplicates(["n1", "n2"]), "near-nodes")
        self.sets = sets

    def lend_texts(self, members: DataFrame) -> None:
        """Keep one text of each node that shares a bucket; all later comparisons read these."""
        used = self.nodes.join(members.select("n1").distinct(), "n1", "left_semi").select("n1", "n2")
        row = self.sets.join(used, ["n1", "n2"]).groupBy("n1", "n2").agg(F.min(F.struct("k1", "k2")).alias("k")).select("n1", "n2", "k.*")
        texts = keyed(*self.docs).join(row, ["k1", "k2"]).select("n1", "n2", "text").dropDuplicates(["n1", "n2"])
        self.texts = saved(texts, "near-texts")

    def confirmed(self, pairs: DataFrame, most: int) -> DataFrame:
        """Of candidates ``a, b`` (first halves of node names), ``most`` of them at most, the linked ones, as whole names."""
        ends = self.nodes.select("n1", "n2", "n_shingles", "sig")
        side = lambda x: ends.select(F.col("n1").alias(x), F.struct("n1", "n2").alias(f"k{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        p = self.percent
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b)")
        near = near.select("ka", "kb", "sig_a", "sig_b").mapInArrow(B.bounded(_close(reach(p)[0])), "ka struct<n1:long,n2:long>, kb struct<n1:long,n2:long>")
        near = saved(near, "near-pairs", most)
        # a text in very many pairs is lent in several parts
        busy = near.select(F.explode(F.array("ka", "kb")).alias("k")).groupBy("k").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")).where("parts > 1")
        busy = saved(busy, "near-busy", 1)
        text = self.texts.select(F.struct("n1", "n2").alias("k"), "text").join(busy, "k", "left")
        text = text.select("k", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "text")
        for x, other in (("ka", "kb"), ("kb", "ka")):
            parts = busy.select(F.col("k").alias(x), "parts")
            near = near.join(parts, x, "left").withColumn(f"part_{x}", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        lent = lambda x: text.select(F.col("k").alias(f"k{x}"), F.col("part").alias(f"part_k{x}"), F.col("text").alias(f"text_{x}"))
        both = near.join(lent("b"), ["kb", "part_kb"]).join(lent("a"), ["ka", "part_ka"])
        both = both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.concat_ws(":", "ka.n1", "ka.n2").alias("ka"), "text_a", "text_b")
        return saved(both.mapInArrow(B.bounded(_confirmed(self.size, p)), f"a {_NAME}, b {_NAME}"), "near-links")


_NAME = "struct<n1:long,n2:long>"


def _links_between(members: DataFrame, join: _Join, labels: DataFrame) -> DataFrame:
    """Links ``a, b`` that join different classes whose members (``key, n1, lo, hi``) share a bucket."""
    # in a bucket one long stands for a class; equal ones would only hide a pair, with odds of 2**-64
    label = labels.select(F.col("node.n1").alias("n1"), F.xxhash64("root.n1", "root.n2").alias("label")).dropDuplicates(["n1"])
    # classes and sizes are joined to nodes, each with its buckets, not to every member of a bucket
    nodes = members.groupBy("n1").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("at"))
    nodes = nodes.join(join.nodes.groupBy("n1").agg(F.max("n_shingles").alias("n_shingles")), "n1").join(label, "n1", "left")
    rows = nodes.select("n1", "n_shingles", F.coalesce("label", F.xxhash64("n1")).alias("label"), F.explode("at").alias("at")).select("at.key", "n1", "label", "n_shingles", "at.lo", "at.hi")
    # the bucket's smallest and largest have met all of its members
    rows = rows.where("n1 <> lo and n1 <> hi").drop("lo", "hi")
    size = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    mixed = size.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("n", "w", "label")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("classes > 1")
    mixed = mixed.select("key", F.col("most.label").alias("large"), blocks(F.col("most.n"), F.col("most.w")).alias("own"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("rest"))
    rows = rows.join(mixed, "key").withColumn("is_large", F.col("label") == F.col("large"))
    # blocks of the largest class come behind the others; they meet those but not each other
    block = F.when(F.col("is_large"), F.col("rest") + F.pmod(F.xxhash64("n1"), F.col("own"))).otherwise(F.pmod(F.xxhash64("n1"), F.col("rest"))).cast("int")
    rows = rows.withColumn("block", block)
    last = F.when(F.col("is_large"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1
    met_by = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.greatest(x, F.col("block")).alias("i"), F.least(x, F.col("block")).alias("j"))).alias("met")
    sent = rows.groupBy("n1").agg(F.collect_list(F.struct("key", "label", "block", met_by)).alias("at")).join(join.nodes, "n1")
    sent = sent.select("n1", "n2", "n_shingles", "sig", F.explode("at").alias("at")).select("at.key", "n1", "n2", "at.label", "n_shingles", "sig", "at.block", F.explode("at.met").alias("met"))
    sent = sent.select("key", "met.i", "met.j", "block", "n1", "n2", "label", "n_shingles", "sig")
    asked = saved(sent.groupBy("key", "i", "j").applyInArrow(_asked(join.percent), _BLOCK), "near-asked")
    found = asked.join(join.texts, ["n1", "n2"]).select(*asked.columns, "text").groupBy("key", "i", "j").applyInArrow(_settled(join.size, join.percent), "a1 long, a2 long, b1 long, b2 long")
    return saved(found.select(F.struct(F.col("a1").alias("n1"), F.col("a2").alias("n2")).alias("a"), F.struct(F.col("b1").alias("n1"), F.col("b2").alias("n2")).alias("b")), "near-more")


def _classes(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after the links ``more`` have joined some of their classes."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    roots = components(joined)
    up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return old.unionByName(roots.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, n_shingles, component_id, kept, root`` for each row; ``root`` names the class (null: empty set)."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the signatures' radius holds for {LEAST_PERCENT} percent and more")
    sets = saved(keyed(docs, id_col, text_col).mapInArrow(B.bounded(_signed(shingle)), _SETS), "near-sets")
    join = _Join((docs, id_col, text_col), sets, shingle, percent)
    keys = join.nodes.select("n1", "sig").mapInArrow(B.bounded(_keyed(reach(percent)[1])), "key long, n1 long")
    shared = keys.groupBy("key").agg(F.min("n1").alias("lo"), F.max("n1").alias("hi")).where("lo <> hi")
    members = saved(keys.join(shared, "key"), "near-members")
    join.lend_texts(members)
    ends = F.explode(F.array("lo", "hi"))
    stars = members.select("n1", ends.alias("c")).where("n1 <> c").select(F.least("n1", "c").alias("a"), F.greatest("n1", "c").alias("b")).distinct()
    labels = components(join.confirmed(stars, 2 * members.count()))
    more = _links_between(members, join, labels)
    if not more.isEmpty():
        labels = _classes(labels, more)
    named = sets.where("n_shingles > 0").groupBy("n1", "n2").agg(F.min("doc_id").alias("least"))
    named = named.join(labels.select(F.col("node.n1").alias("n1"), F.col("node.n2").alias("n2"), "root"), ["n1", "n2"], "left")
    named = named.withColumn("root", F.coalesce("root", F.struct("n1", "n2")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("n1", "n2", "root", "component_id")
    out = sets.select("k1", "k2", "doc_id", "n_shingles", "n1", "n2").join(classes, ["n1", "n2"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("k1", "k2", "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      (empty | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"), "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they were: of each class the one with the smallest id, and all without words."""
    near = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "k1", "k2")
    first = near.where("root is not null").groupBy("root").agg(F.min(place).alias("x")).select("x.k1", "x.k2")
    keep = saved(first.unionByName(near.where("root is null").select("k1", "k2")).distinct(), "near-kept")
    others = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*row_key(id_col, text_col), *[F.col(f"`{c}`").alias(n) for c, n in others.items()]).join(keep, ["k1", "k2"])
    # rows that repeat id and text are one document
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k2"))).where("nth = 1")
    return rows.select(*[F.col(n).alias(c) for c, n in others.items()])
