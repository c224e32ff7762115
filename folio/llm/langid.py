"""Language identification of words in code-switched text by a linear-chain CRF.

Features of a word are the word itself (the lexicon of the sample), its affixes of 1 to 3 bytes
and its inner n-grams of 2 to 4 bytes, hashed into one table of weights.  Weights and transitions
are trained by the gradient of the sequence likelihood; training sequences splice words of
documents in several languages, so that transitions are learned too.  Words are labelled by
forward-backward over the whole text, and a document takes the language with the largest mean
probability.

Fitting uses ``rows_per_label`` rows a label of at most ``max_chars`` characters, those with the
smallest hash of their id, whole; that bounds the driver's memory.  A label with longer rows alone
is learned from its shortest one.  Prediction reads nothing but the text.

Defined cases: text that is null or has no letter is ``und`` with score 0; rows with a null id may
be predicted and never train; repeated rows each get the result; with no labelled row every text
is ``und``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .store import row_key, small_batches

UND = "und"
BITS = 18
BLOCK = 64
LETTER_BYTES = bytes([*range(0x61, 0x7B), *range(0x80, 0x100)])
PREDICT_SLICE = 1 << 20


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # hashed feature x label
    transition: np.ndarray  # label before x label


def word_features(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word's index, feature) pairs, grouped by kind of feature."""
    code = B.table(LETTER_BYTES)[raw].astype(np.uint64)
    size = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    owner = np.repeat(np.arange(len(begin)), size)
    last = end[owner]
    mask = np.uint64((1 << BITS) - 1)
    code = np.append(code, np.zeros(4, np.uint64))

    def packed(pos: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(pos), np.uint64)
        for i in range(n):
            out = (out << np.uint64(9)) | code[pos + i]
        return out

    def feature(value: np.ndarray, kind: int) -> np.ndarray:
        return (B.mix(value * np.uint64(16) + np.uint64(kind)) & mask).astype(np.int64)

    owners, found = [np.arange(len(begin))], [feature(word, 0)]
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n)
        owners += [long, long]
        found += [feature(packed(begin[long], n), n), feature(packed(end[long] - n, n), 3 + n)]
    for n in (2, 3, 4):
        ok = at + n <= last
        owners.append(owner[ok])
        found.append(feature(packed(at[ok], n), 6 + n))
    return np.concatenate(owners), np.concatenate(found)


def word_scores(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(owner, weights[feature, k], n) for k in range(weights.shape[1])])


def posteriors(scores: np.ndarray, transition: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Label probabilities of each word; ``first`` and ``count`` cut ``scores`` into sequences.

    Sequences are cut into blocks.  The products of their transfer matrices carry the forward and
    backward messages from block to block, so that all blocks are worked on together.
    """
    k = scores.shape[1]
    t = np.exp(transition - transition.max())
    n_blocks = -(-count // BLOCK)
    seq = np.repeat(np.arange(len(count)), n_blocks)
    nth = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    base = first[seq] + nth * BLOCK
    length = np.minimum(BLOCK, count[seq] - nth * BLOCK)
    e = np.exp(scores - scores.max(1, keepdims=True))
    nb = len(seq)
    grid = np.minimum(base[:, None] + np.arange(BLOCK), len(scores) - 1)
    inside = np.arange(BLOCK) < length[:, None]
    em = e[grid]  # block x step x label
    move = np.tile(np.eye(k), (nb, 1, 1))
    for s in range(BLOCK):
        on = inside[:, s]
        if not on.any():
            break
        step = np.matmul(move[on], t) * em[on, s][:, None, :]
        move[on] = step / step.max((1, 2), keepdims=True)
    begin = np.cumsum(n_blocks) - n_blocks
    into, outof = np.ones((nb, k)), np.ones((nb, k))
    order = np.argsort(-n_blocks, kind="stable")
    message = np.full((len(count), k), 1.0 / k)
    for i in range(int(n_blocks.max(initial=0))):
        live = order[: np.searchsorted(-n_blocks[order], -i, "left")]
        b = begin[live] + i
        into[b] = message[live]
        after = np.matmul(message[live][:, None, :], move[b])[:, 0]
        message[live] = after / after.sum(1, keepdims=True)
    message = np.ones((len(count), k))
    for i in range(int(n_blocks.max(initial=0))):
        live = order[: np.searchsorted(-n_blocks[order], -i, "left")]
        b = begin[live] + n_blocks[live] - 1 - i
        outof[b] = message[live]
        before = np.matmul(move[b], message[live][:, :, None])[:, :, 0]
        message[live] = before / before.sum(1, keepdims=True)
    forward = np.empty((nb, BLOCK, k))
    a = into
    for s in range(BLOCK):
        nxt = (a @ t) * em[:, s]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(inside[:, s, None], nxt, a)
        forward[:, s] = a
    back = outof
    for s in range(BLOCK - 1, -1, -1):
        forward[:, s] *= back
        prev = (em[:, s] * back) @ t.T
        back = np.where(inside[:, s, None], prev / prev.sum(1, keepdims=True), back)
    out = forward[inside]
    return out / out.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], steps_of: int = 48, epochs: int = 3, rate: float = 0.5, seed: int = 3) -> Model | None:
    """Train on whole texts; sequences of ``steps_of`` words splice two documents' words."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    owners, feats, gold, offset = [], [], [], 0
    runs: list[tuple[int, int]] = []
    for first, raw, starts in B.slices(texts):
        (word,), begin, end, doc = B.words(raw, starts, B.table(LETTER_BYTES), 1)
        owner, feature = word_features(raw, begin, end, word)
        owners.append((owner + offset).astype(np.int32))
        feats.append(feature.astype(np.int32))
        lang = np.array([labels.index(x) for x in langs[first : first + len(starts) - 1]])
        gold.append(lang[doc])
        half = steps_of // 2
        for d, n in enumerate(np.bincount(doc, minlength=len(starts) - 1)):
            a = offset + int(np.searchsorted(doc, d))
            runs += [(p, min(half, a + n - p)) for p in range(a, a + n, half)]
        offset += len(word)
    if not offset:
        return None
    owner, feature, gold_ = np.concatenate(owners), np.concatenate(feats), np.concatenate(gold)
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    edge = np.searchsorted(owner, np.arange(offset + 1))
    k = len(labels)
    weights, transition = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
    square = np.full((1 << BITS, k), 1e-2, np.float32)
    pairs = 64
    for epoch in range(epochs):
        rng.shuffle(runs)
        for i in range(0, len(runs), 2 * pairs):
            chosen = runs[i : i + 2 * pairs]
            words = np.concatenate([np.arange(a, a + n) for a, n in chosen])
            count = np.array([sum(n for _, n in chosen[j : j + 2]) for j in range(0, len(chosen), 2)])
            first = np.cumsum(count) - count
            size = edge[words + 1] - edge[words]
            own = np.repeat(np.arange(len(words)), size)
            f = feature[np.repeat(edge[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            p = posteriors(word_scores(weights, own, f, len(words)), transition, first, count)
            truth = np.zeros_like(p)
            truth[np.arange(len(words)), gold_[words]] = 1
            error = (truth - p).astype(np.float32)
            used, at = np.unique(f, return_inverse=True)
            g = np.column_stack([np.bincount(at, error[own, j], len(used)) for j in range(k)]).astype(np.float32)
            square[used] += g * g
            weights[used] += rate * g / np.sqrt(square[used])
            inner = np.ones(len(words), bool)
            inner[first] = False
            b = np.flatnonzero(inner)
            seen = truth[b - 1].T @ truth[b]
            expected = p[b - 1].T @ p[b]
            transition += 0.1 * (seen - expected) / max(1, len(b)) * k
    return Model(labels, weights, transition)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, rows_per_label: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(label_col).alias("lang"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("h"), F.greatest(F.length(text_col) - max_chars, F.lit(0)).alias("over"), *row_key(id_col, text_col))
    pick = Window.partitionBy("lang").orderBy("over", "h", "doc_id", "k2")
    # the plain bound comes first, so that each task passes on no more rows a label than that
    first = rows.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= rows_per_label)
    chosen = first.where((F.col("r") == 1) | (F.col("over") == 0)).select("k1", "k2", "lang", "h").distinct()
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    # rows_per_label rows a label: small enough to be sent to every task
    return texts.join(F.broadcast(chosen), ["k1", "k2"]).dropDuplicates(["k1", "k2", "lang"]).select("h", "k2", "lang", "text")


def train(docs: DataFrame, rows_per_label: int = 120, max_chars: int = 20_000, **columns) -> Model | None:
    got = training_rows(docs, rows_per_label, max_chars, **columns).orderBy("h", "k2", "lang").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def _predicted(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            for first, raw, starts in B.slices(texts, PREDICT_SLICE):
                n = len(starts) - 1
                langs, scores = [UND] * n, np.zeros(n)
                if model is not None:
                    langs, scores = predict(model, texts[first : first + n], raw, starts)
                part = b.slice(first, n)
                names = [x for x in b.schema.names if with_text or x != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def predict(model: Model, texts: list[str], raw: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    n, k = len(starts) - 1, len(model.labels)
    (word,), begin, end, doc = B.words(raw, starts, B.table(LETTER_BYTES), 1)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    mean = np.zeros((n, k))
    if len(word):
        kinds, at, back = np.unique(word, return_index=True, return_inverse=True)
        own, feature = word_features(raw, begin[at], end[at], kinds)
        scores = word_scores(model.weights, own, feature, len(kinds))[back]
        some = count > 0
        p = posteriors(scores, model.transition, first[some], count[some])
        mean = np.column_stack([np.bincount(doc, p[:, j], n) for j in range(k)]) / np.maximum(count, 1)[:, None]
    best, top = mean.argmax(1), np.clip(mean.max(1), 0, 1)
    ascii_letter = np.bincount(np.searchsorted(starts, np.flatnonzero(((raw | 32) >= 97) & ((raw | 32) <= 122)), "right") - 1, minlength=n) > 0
    langs = []
    for i in range(n):
        letter = ascii_letter[i] or (count[i] > 0 and any(map(str.isalpha, texts[i] or "")))
        langs.append(model.labels[best[i]] if letter else UND)
        top[i] = top[i] if letter else 0.0
    return langs, top


def identify(docs: DataFrame, model: Model | None, keep: list | None = None, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Columns ``keep`` (of ``docs``), the text if asked for (null: empty), then ``lang_pred`` and ``score``."""
    small_batches(docs.sparkSession)
    kept = docs.select(*(keep or []), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{n}` {t}, " for n, t in kept.dtypes if with_text or n != "text")
    return kept.mapInArrow(B.bounded(_predicted(shared, with_text)), fields + "lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose language is known with at least ``least_score``."""
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    found = identify(docs, model, [F.col(f"`{c}`").alias(n) for c, n in others.items()], text_col, with_text=True)
    found = found.where((F.col("lang_pred") != UND) & (F.col("score") >= least_score))
    return found.select(*[F.col(others.get(c, "text")).alias(c) for c in docs.columns])
