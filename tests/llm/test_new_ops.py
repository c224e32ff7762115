"""Vector codes, quality rules and ranked search against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import LONG, rows

from folio.llm import lexical, quality, queries, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(frame, *cols):
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=str)


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """(code, error) of each (id, components), and the codebooks, with loops."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in vectors}
    wide = len(vectors[0][1]) // parts
    part = lambda i, p: x[i][p * wide : (p + 1) * wide]
    books = [[part(i, p) for i in sorted(x)[:entries]] for p in range(parts)]
    near = lambda a, book: min((sum((u - w) ** 2 for u, w in zip(a, b)), e) for e, b in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for i in x:
                own[near(part(i, p), book)[1]].append(part(i, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if own[e] else b for e, b in enumerate(book)]
    found = {i: [near(part(i, p), books[p]) for p in range(parts)] for i in x}
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for i, n in found.items()}, digest


@pytest.mark.parametrize(("wide", "ties"), [(1, True), (4, True), (4, False), (9, False)])
def test_partial_distances_find_the_nearest(wide, ties):
    rng = np.random.default_rng(wide)
    most = 3 if ties else 1000
    x, book = rng.integers(-most, most, (3000, wide)), rng.integers(-most, most, (64, wide))
    whole = np.square(x[:, None] - book).sum(2)
    code, apart = vector_codes.nearest(x, book)
    assert (code == whole.argmin(1)).all() and (apart == whole.min(1)).all()


def test_op11(spark, sf):
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = plain_codes([(i, v) for i, v, _ in vectors])
    total = Counter()
    for i, _, label in vectors:
        total[label] += want[i][1]
    rows = queries.op11_vector_codes(spark, sf).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in rows) == sorted((i, *want[i], total[label]) for i, _, label in vectors)
    assert {r.codebooks_sha256 for r in rows} == {digest}


def test_vectors_that_take_no_part(spark):
    fields = "vec_id long, embedding array<double>, label string, v string, code int, error string, same int"
    nan, inf = float("nan"), float("inf")
    fine = [(i, [float((i * k) % 7) - 2.5 for k in range(32)]) for i in range(5)]
    odd = [(10, None), (11, []), (12, [nan] * 32), (13, [inf] + [0.0] * 31), (14, [None] + [0.0] * 31), (15, [1.0] * 8)]
    more = [(None, [0.25] * 32), (3, [9.0] * 32), (20, [1e300] + [-1e300] * 31)]
    labels = lambda i: None if i in (1, None) else "a"
    frame = spark.createDataFrame([(i, v, labels(i), "x", 1, "y", 2) for i, v in fine + odd + more], fields)
    codes, books = vector_codes.compress(frame)
    rows = vector_codes.with_label_errors(codes).collect()
    assert sorted((r.vec_id for r in rows), key=str) == sorted([0, 1, 2, 3, 3, 4, 20, None], key=str) and books.entries.shape == (16, 8, 2)
    assert len({r.label_error for r in rows if r.label is None}) == 1 and all(len(r.code) == 32 and r.error >= 0 for r in rows)
    assert vector_codes.compress(frame.limit(0))[1] is None and vector_codes.with_label_errors(vector_codes.compress(frame.limit(0))[0]).count() == 0
    some = vector_codes.compress(spark.createDataFrame([(1, [0.5, 0.25, 1.0], None, "", 0, "", 0)], fields), parts=2)[0].collect()
    assert [(r.code, r.error) for r in some] == [("0000", 0)]  # three components in two parts: filled up


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(runs)
    again = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(5)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_op12(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got(queries.op12_quality_rules(spark, sf), "doc_id", *BASE) == sorted(((r.doc_id, *plain_quality(r.text)) for r in docs), key=str)


def test_quality_of_odd_rows(odd, none):
    found = quality.clean_lines(odd)
    assert got(found, "doc_id", *BASE) == sorted(((i, *plain_quality(t)) for i, t, *_ in rows()), key=str)
    assert all(not r.kept for r in found.collect() if r.base_failed) and quality.clean_lines(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_have_the_numbers_of_short_ones(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a ", "b ", "cc", " d", "\n", "\t", "é ", "A.\n", "| "]) for _ in range(3000))
    assert quality.line_report(text) == quality.line_report(text, long=0)
    assert quality.line_report(text)[0][:5] == list(plain_quality(text))[:5]
    words = [rng.choice("ab") for _ in range(60)]
    for window in (2, 3, 5, 7, 8):
        runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        want = len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(window)})
        numbers = np.array([ord(w) for w in words])
        assert quality.repeated_words([w.encode() for w in words], window) == quality.repeated_numbers(numbers, window) == want


PROSE = "The committee met on Monday and agreed to publish the full report before the end of the month."


@pytest.mark.parametrize(("line", "rule"), [
    (PROSE, None), ("« Nous partons demain matin », dit-elle avec un sourire. »", None), ("她说我们明天早上离开这里。", None), ("He said: “it is late.”  ", None), ("1990 was a good year.", None),
    ("Read the report published in 2020", "punctuation"), ("the ### of $$$ and %%% is here.", "punctuation"), ("Home | About | Contact | News.", "navigation"), ("BUY OUR NEW THING TODAY!!", "navigation"),
    ("12 / 30.", "navigation"), ("Copyright 2024 Example Press. All rights reserved.", "boilerplate"), ("We use cookies to improve this site.", "boilerplate"), ("Licensed under CC BY 4.0.", "boilerplate"),
])
def test_rules(line, rule):
    failed = [r for r, f in zip(quality.RULES, quality.failed_rules(line, line.encode(), len(line.split()))) if f]
    assert (rule in failed) if rule else not failed


def test_documents_that_lose_too_much(spark):
    clean = "\n".join([PROSE, "A second line of prose tells where the report can be found.", "And a third one ends it."])
    docs = [(1, clean + "\nAll rights reserved."), (2, "\n".join(["Home | About | News"] * 9) + "\n" + PROSE), (3, clean)]
    found = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[i].kept for i in (1, 2, 3)] == [True, False, True] and found[1].text == found[3].text == clean and found[2].text == PROSE
    assert (found[1].n_removed, found[1].n_boilerplate, found[2].n_navigation, found[2].n_lines) == (1, 1, 9, 10)


def plain_search(docs, items, top=50):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    big_n, length = len(texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in texts:
            m = 50 + 50 * c.total() * big_n // length
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_op13(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(i, "text").collect()] for n, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(queries.op13_lexical_search(spark, sf), "item_id", "rank", "doc_id", "score") == plain_search(docs, items)


@pytest.mark.parametrize(("top", "batch", "size"), [(3, 1, (16, 1 << 14, 64)), (7, 40, (1, 1, 2)), (50, 1 << 16, (4, 30, 3))])
def test_search_in_blocks_and_batches(spark, top, batch, size, monkeypatch):
    """Ties, copies, few documents and small blocks give the same rows as scoring every document."""
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "BLOCKS"), size, strict=True):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(top)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i // 2 if i % 5 else i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 200])))) for i in range(160)] + [(None, "w1 w2"), (None, "w1 w2"), (5, None)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(12)] + [(None, "w1 w3"), (3, "w2 w900"), (99, "nothing"), (98, None)]
    # repeated ids keep the order of their rows out of the result: compare without rank where scores tie
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), top=top, batch_terms=batch)
    assert got(found, "item_id", "rank", "doc_id", "score") == plain_search(docs, items, top)


def test_search_of_odd_rows(spark, odd, none):
    docs = [(i, t) for i, t, *_ in rows()]
    items = [(1, "the Quick brown Fox"), (2, "日本語 eins"), (3, "common tail word3"), (4, "…")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.search(lexical.index(odd), asked), "item_id", "rank", "doc_id", "score") == plain_search(docs, items)
    assert lexical.search(lexical.index(none), asked).count() == lexical.search(lexical.index(odd), asked.limit(0)).count() == 0


def test_terms_of_a_long_text(monkeypatch):
    whole = lexical.term_counts(LONG)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(LONG) == whole and {k.decode(): v for k, v in whole.items()} == Counter(TERM.findall(LONG.translate(LOWER)))
