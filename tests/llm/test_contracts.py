"""The registered queries against brute force on the small tables."""

import random
from datetime import UTC, datetime

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import ann, bytesops, decontaminate, langid, line_dedup, near_dedup, packing, queries, secret_scan, substring_dedup, suffix_dedup, warc


def table(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]


def got(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


def test_op1(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.op1_substring_dedup(spark, sf).collect()}
    assert set(rows) == {i for i, _ in docs}
    exact = {r[0]: r for r in brute.repeats(docs)}
    for i, text in docs:
        r = rows[i]
        assert r.n_bytes == len((text or "").encode()) and r.n_removed <= r.n_repeated <= r.n_bytes
        assert (r.n_removed == 0) == (r.kept_sha256 == brute.sha(text or ""))
        if exact[i][2] >= 600:  # a repeated passage of a hundred words or more is never missed
            assert r.n_repeated > 0
        if r.n_repeated >= 400:  # and long runs of repeated chunks are repeated strings
            assert exact[i][2] > 0


def test_op1_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    pieces = {}
    for name, text in (("a", base), ("b", base[:7000] + "inserted words" + base[7000:])):
        _, raw, starts = next(bytesops.slices([text]))
        ends = next(substring_dedup.chunk_ends(raw, starts))
        edges = [0, *ends]
        assert edges[-1] == len(text.encode()) and all(0 < z - a <= substring_dedup.MAX_CHUNK for a, z in zip(edges, edges[1:]))
        pieces[name] = {text[a:z] for a, z in zip(edges, edges[1:])}
    assert len(pieces["a"] & pieces["b"]) > 0.95 * len(pieces["a"])


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    want = brute.pieces(docs, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(1024 - sum(n for _, n in parts) for parts in bins.values()) == best_fit_decreasing([w[3] for w in want], 1024)


def best_fit_decreasing(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in bins if r >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(size - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 16, 100, 1024])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan(counts, size)
    used = {}
    for i, (length, rank, first, offset) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for b in range(first, first + end - rank):
            assert used.get(b, 0) == offset
            used[b] = offset + length
    assert sorted(size - x for x in used.values()) == best_fit_decreasing(lengths, size)


def test_fast_encoder_is_the_tokenizers(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in [x or "" for _, x in docs][:100] + ["", " ", "\n\n  x", "ﬁ 日本 é́ 🙂\r\n\t1234567 don't", "a" * 2000]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_op3(spark, sf):
    rows = {r.doc_id: r for r in queries.op3_language_id(spark, sf).collect()}
    truth = table(spark, sf, "documents", "doc_id", "lang")
    held = [(i, x) for i, x in truth if rows[i].held_out]
    assert held and np.mean([rows[i].lang_pred == x for i, x in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_code_switching_and_blocks():
    de, en = "der die und nicht ein mit ", "the of and to in that "
    model = langid.fit([de * 60, en * 60], ["de", "en"], epochs=4)
    _, raw, starts = next(bytesops.slices([en * 4 + de * 4 + en * 4]))
    (word,), begin, end, _ = bytesops.words(raw, starts, bytesops.table(langid.LETTER_BYTES), 1)
    scores = langid.word_scores(model.weights, *langid.word_features(raw, begin, end, word), len(word))
    p = langid.posteriors(scores, model.transition, np.array([0]), np.array([len(word)]))
    labels = [model.labels[i] for i in p.argmax(1)]
    assert labels == ["en"] * 24 + ["de"] * 24 + ["en"] * 24


def test_posteriors_are_forward_backward():
    rng = np.random.default_rng(1)
    count = np.array([1, 200, 64, 65, 3])
    first = np.cumsum(count) - count
    scores, move = rng.normal(size=(count.sum(), 3)), rng.normal(size=(3, 3))
    found = langid.posteriors(scores, move, first, count)
    for a, n in zip(first, count):
        e, t = np.exp(scores[a : a + n]), np.exp(move)
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        f[0] = (np.ones(3) @ t) * e[0]
        for i in range(1, n):
            f[i] = (f[i - 1] / f[i - 1].sum() @ t) * e[i]
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        assert np.allclose(found[a : a + n], p / p.sum(1, keepdims=True))


def test_op4(spark, sf, docs):
    want = sorted((i, n, c, i == c) for i, (n, c) in brute.components(docs).items())
    assert got(queries.op4_near_dedup(spark, sf), "doc_id", "n_shingles", "component_id", "kept") == want


@pytest.mark.parametrize(("rows", "shingles"), [(3, 1 << 19), (1024, 1 << 19), (1024, 400)])
def test_near_copies_of_one_text(spark, rows, shingles, monkeypatch):
    """A family of copies with few to many changes: any size of blocks gives the same classes as all pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(160)]
    docs = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12])):
            own[rng.randrange(len(own))] = f"z{rng.randint(0, 9999)}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 7)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_dedup.near_duplicates(frame)
    assert got(rows, "doc_id", "component_id") == sorted((i, c) for i, (_, c) in brute.components(docs).items())


def test_keys_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 65536, (200, near_dedup.HASHES)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.HASHES, rng.integers(0, near_dedup.RADIUS + 1), replace=False)
        row[at] ^= 1
    assert all(set(x) & set(y) for x, y in zip(near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)))
    assert_owned_once(a, b, near_dedup._EDGES, near_dedup.RADIUS)


def assert_owned_once(a, b, edges, radius):
    """Each pair belongs to the first of its common keys and to no other."""
    for x, y, kx, ky in zip(a, b, near_dedup.chunk_keys(a, edges), near_dedup.chunk_keys(b, edges)):
        owned = [i for i in range(near_dedup.HASHES) if len(near_dedup.first_keys(x, y[None], edges, int(np.searchsorted(edges, i, "right")) - 1, i, radius))]
        assert owned == [int(np.flatnonzero(kx == ky)[0])]


def thue_morse(n):
    """Two words that polynomials modulo 2**64 cannot tell apart."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(2048)
    shared = "one two three four"
    docs = [(0, f"{x} {shared}"), (1, f"{y} {shared}"), (2, f"{y} {shared}")]
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(rows, "doc_id", "component_id") == [(0, 0), (1, 1), (2, 1)]


def test_word_hashes():
    """Neither the slice, the place in it nor the case matters; length and every byte do."""
    rng, classes = random.Random(4), bytesops.table(near_dedup.WORD_BYTES)
    words = ["".join(rng.choice("abcé-0") for _ in range(n)) for n in [*range(1, 80), 500] for _ in range(3)]
    words += [w[:-1] + "z" for w in words] + [w + "\0" for w in words]
    hashes = {}
    for sep in (" ", "\t\n  "):
        _, raw, starts = next(bytesops.slices(["", sep.join(words) + sep, " ".join(words).upper()]))
        (h1, h2), begin, _, doc = bytesops.words(raw, starts, classes)
        for w, a, b in zip(words, h1[doc == 1].tolist(), h2[doc == 1].tolist(), strict=True):
            assert hashes.setdefault(w, (a, b)) == (a, b)
    assert len({a for a, _ in hashes.values()}) == len({b for _, b in hashes.values()}) == len(set(words))


def test_long_texts_have_the_shingles_of_short_ones(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["", "ab", "c" * rng.randint(1, 90), "d", "\n"]) for _ in range(n)) for n in (0, 3, 4, 5, 40, 900)] + ["x" * 700, "", "one two three four"]
    want = [near_dedup.shingle_sets([t], 5) for t in texts]
    want = [[s.tolist() for s in next(x)[1]] for x in want]
    for size in (16, 64, 200):
        monkeypatch.setattr(bytesops, "SLICE", size)
        monkeypatch.setattr(bytesops.slices, "__defaults__", (size,))
        found = list(near_dedup.shingle_sets(texts, 5))
        assert [i for i, _ in found] == list(range(len(texts)))
        assert [[s.tolist() for s in x] for _, x in found] == want
        assert [len(x[0]) for x in want] == [len(brute.shingles(t)) for t in texts]


def test_no_link_hides_behind_another(spark):
    """Two classes with many links whose signatures differ much or little are joined whatever link is met first."""
    rng, docs = random.Random(12), []
    base = [f"w{i}" for i in range(130)]
    for side in (0, 1):  # each side is a chain of copies; sides are linked by some pairs only
        for step in range(12):
            own = list(base)
            for j in range(step % 4 + side):
                own[(17 * side + 31 * step + 7 * j) % 130] = f"z{side}{step}{j}"
            docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    want = sorted((i, c) for i, (_, c) in brute.components(docs).items())
    assert got(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), "doc_id", "component_id") == want


def test_op5(spark, sf, docs):
    assert got(queries.op5_suffix_dedup(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(docs))


@pytest.mark.parametrize("seed", range(8))
def test_intervals_find_repeats(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 4, rng.integers(5, 80)) for _ in range(6)]
    texts += [t[2:40] for t in texts[:3]]
    size = 9
    sym = np.concatenate([np.append(t, 0) for t in texts]).astype(np.uint64)
    valid, at, seen = np.zeros(len(sym), bool), 0, {}
    for t in texts:
        valid[at : at + max(0, len(t) - size + 1)] = True
        for s in range(max(0, len(t) - size + 1)):
            seen.setdefault(tuple(t[s : s + size]), []).append(at + s)
        at += len(t) + 1
    want = np.zeros(len(sym), bool)
    for places in seen.values():
        want[places] = len(places) > 1
    assert (suffix_dedup.repeated(sym, valid, size) == want).all()


@pytest.mark.parametrize(("limit", "piece"), [(2 << 20, 1 << 19), (900, 1 << 19), (1, 700)])
def test_large_anchor_groups(spark, limit, piece, monkeypatch):
    """Refined to any depth, and with texts in pieces of any size, the result is that of brute force."""
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefghijkl ") for _ in range(260))
    docs = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + core[rng.randint(0, 50) :] + str(i) * 30) for i in range(40)]
    docs += [(i, docs[i - 40][1]) for i in range(40, 55)] + [(60, core * 4), (61, "q" * 900), (62, "q" * 199), (63, "")]
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", limit)
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got(rows, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(docs))
    monkeypatch.setattr(bytesops, "SLICE", piece)
    monkeypatch.setattr(bytesops.slices, "__defaults__", (piece,))
    seen = {}
    for first, offset, raw, starts in bytesops.pieces([t for _, t in docs], 199):
        for _, begin, count, _ in zip(*suffix_dedup.anchors(raw, starts)):
            doc = int(np.searchsorted(starts, begin, "right")) - 1
            at = int(begin - starts[doc]) + offset
            for s in range(at, at + count):
                assert seen.setdefault((first + doc, s), True) is True and not seen.pop((first + doc, s, "twice"), False)
                seen[first + doc, s, "twice"] = True
    assert sum(len(k) == 2 for k in seen) == sum(max(0, len(t.encode()) - 199) for _, t in docs)


@pytest.mark.parametrize("wide", suffix_dedup.WIDTHS)
def test_refined_contexts(wide):
    """Parts hold each window once, and equal windows of two contexts of one anchor get equal parts and shared bytes."""
    rng = np.random.default_rng(wide)
    core = rng.integers(97, 123, 400, np.uint8).tobytes()
    by_window = {}
    for _ in range(60):
        anchor = 190  # the place of the anchor in the core
        first = int(rng.integers(anchor - 168, anchor + 1))
        n = int(rng.integers(1, anchor - first + 2))
        data = core[first : first + n + 199]
        seen = []
        for part, j, dist, own, shared in suffix_dedup.refined(data, anchor - first, wide):
            assert dist == anchor - first - j and len(shared) == 201 - wide and shared in own
            for k in range(len(own) - 199):
                seen.append(j + k)
                assert by_window.setdefault(own[k : k + 200], (part, shared)) == (part, shared)
        assert seen == list(range(n))


def test_op6(spark, sf):
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], float)
    want = brute.neighbours(ids, v, [i for i in ids if i % 100 == 0])
    found = {}
    for r in queries.op6_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    hits = 0
    for q, near in want.items():
        assert [x[2] for x in found[q]] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((v[ids.index(i)] - v[ids.index(q)]) ** 2).sum())) < 1e-12 for i, s, _ in found[q])
        hits += len({i for i, _ in near} & {i for i, _, _ in found[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ann_odd_rows(spark):
    bad = [(None, [1.0, 0.0]), (50, None), (51, []), (52, [0.0, 0.0]), (53, [None, 1.0]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0, 3.0])]
    same = [(i, [0.6, 0.8]) for i in range(30)]
    rows = spark.createDataFrame(bad + same + same[:1] + [(40, [-1.0, 1e-3])], "vec_id long, embedding array<double>")
    found = ann.search(rows, rows.where("vec_id in (0, 29, 40, 52)"), top=4, group_rows=7).collect()
    by = {q: [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 29, 40, 52)}
    assert by == {0: [(1, 1), (2, 2), (3, 3), (4, 4)], 29: [(1, 0), (2, 1), (3, 2), (4, 3)], 40: [(1, 0), (2, 1), (3, 2), (4, 3)], 52: []}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few, few).collect()] in ([(0, 1), (1, 0)], [(1, 0), (0, 1)])
    assert ann.search(few.limit(0), few).count() == 0


@pytest.mark.parametrize("factor", [1e200, 1e-200, 1e307])
def test_ann_sizes_of_vectors(spark, factor):
    """Squares out of range lose no row; ids, ranks and distances are those of the small vectors, scaled."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 8)) / 4
    rows = spark.createDataFrame([(i, (x * factor).tolist(), "c", 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, rank string, q int")
    found = ann.search(rows, rows.where("vec_id % 10 = 0"), recall=1.0).collect()
    want = brute.neighbours(list(range(40)), v, range(0, 40, 10))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(q, k + 1, i) for q, near in sorted(want.items()) for k, (i, _) in enumerate(near)]
    assert all(abs(r.score / factor - want[r.query_id][r["rank"] - 1][1]) < 1e-12 for r in found)


def test_ann_tight_clusters(spark):
    """Neighbours much nearer than a rounded vector can tell are still ranked exactly, and groups may be split."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(6, 16)), 60, axis=0) + rng.normal(size=(360, 16)) * 1e-6
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    found = ann.search(rows, rows.where("vec_id % 50 = 0"), group_rows=25).collect()
    want = brute.neighbours(list(range(360)), v, range(0, 360, 50))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(q, k + 1, i) for q, near in sorted(want.items()) for k, (i, _) in enumerate(near)]


@pytest.mark.parametrize("d", [1, 2, 64, 100, 256])
def test_turns_are_rotations(d):
    x = np.random.default_rng(d).normal(size=(5, ann.width(d)))
    y = ann.turned(x, np.random.default_rng(1))
    assert np.allclose(x @ x.T, y @ y.T) and (d == 1 or not np.allclose(x, y))


def test_op7(spark, sf):
    assert got(queries.op7_warc_archive(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(brute.warc(table(spark, sf, "pages", "page_id", "html")))


def test_warc_records(spark, tmp_path):
    pages = [(1, "http://a\r\nX: 1", "é" * 60), (2, "http://b", "é" * 60), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "n", "é" * 60), (1, "again", "é" * 60)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    warc.write_archive(frame, str(tmp_path / "w"), date=datetime(2020, 2, 29, 12, tzinfo=UTC))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    records = warc.read_archive(spark, str(tmp_path / "w"))
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.parsed(records).collect())
    assert rows == [(0, "revisit", 1, 120), (1, "response", 0, 120), (1, "response", 0, 120), (2, "revisit", 1, 120), (3, "response", 0, 0), (4, "response", 0, 5), (5, "response", 0, 5)]
    raw = sorted(bytes(r.record) for r in warc.record_bytes(records).collect())
    assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in raw)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 5\r\n\r\n"
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Date: 2020-02-29T12:00:00Z\r\nWARC-Target-URI: u\r\n"
    assert f"{head}WARC-Payload-Digest: sha256:{brute.sha('short')}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + 5}\r\n\r\n{http}short\r\n\r\n".encode() in raw
    for x in raw:  # a revisit has the HTTP header alone
        fields, _, payload = warc.parse_record(x)
        assert (fields["warc-type"] == "revisit") == ("warc-refers-to" in fields) and (fields["warc-type"] != "revisit" or payload == b"")
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    spark.createDataFrame([("0" * 64, "WARC/1.1\r\n")], "digest string, header string").write.mode("overwrite").parquet(str(tmp_path / "w/headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "w")).collect()


def test_urls_bring_no_header_lines(spark, tmp_path):
    ends = ["\r\n", "\n", "\r", "\u2028", "\u2029", "\x85", "\x0b", "\x00"]
    urls = [f"http://a{e}WARC-Refers-To: <urn:page:5>" for e in ends] + ["http://é/%20?q=+", "a b", ""]
    frame = spark.createDataFrame([(i, u, "x" * 200 if i % 2 else f"\r\n\r\n{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write_archive(frame, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.parsed(warc.read_archive(spark, str(tmp_path / "w"))).collect()}
    assert [rows[i].refers_to for i in range(len(urls))] == [1 if i % 2 and i > 1 else None for i in range(len(urls))]
    assert [rows[i].url for i in range(len(urls))][-4:] == ["http://a%00WARC-Refers-To:%20<urn:page:5>", "http://é/%20?q=+", "a%20b", None]
    assert rows[3].url == "http://a%E2%80%A8WARC-Refers-To:%20<urn:page:5>" and rows[0].url.startswith("http://a%0D%0AWARC")
    assert all(bytes(r.payload) == (b"x" * 200 if i % 2 else f"\r\n\r\n{i}".encode()) for i, r in rows.items())


def test_warc_of_nothing_and_of_a_long_page(spark, tmp_path):
    schema = "page_id long, url string, html string"
    warc.write_archive(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert warc.parsed(warc.read_archive(spark, str(tmp_path / "none"))).count() == 0
    long = "é\r\n\r\n" * 2_000_000
    warc.write_archive(spark.createDataFrame([(1, "a", long), (2, "b", long)], schema), str(tmp_path / "long"))
    rows = warc.parsed(warc.read_archive(spark, str(tmp_path / "long"))).drop("payload").collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows) == [(1, 12_000_000, brute.sha(long), None), (2, 12_000_000, brute.sha(long), 1)]


def test_op8(spark, sf, docs):
    assert got(queries.op8_line_dedup(spark, sf), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.lines(docs))


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (7, 3), (40, 1)])
def test_lines_across_partitions(spark, partitions, batch):
    """One very frequent line, many middling ones: partition and batch borders do not matter."""
    rng = random.Random(partitions)
    docs = [(i, "\n".join(["hot"] * rng.randint(1, 4) + [f"l{rng.randint(0, 60)}" for _ in range(rng.randint(0, 6))])) for i in range(400)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        rows = line_dedup.dedup_lines(frame, min_docs=25).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h"))
        assert got(rows, "doc_id", "n_lines", "n_dropped", "h") == sorted(brute.lines(docs, 25))
        first = line_dedup.dedup_lines(frame, min_docs=25, keep_first=True).agg(F.sum("n_dropped")).first()[0]
        keys = {}
        for i, t in docs:
            for x in t.split("\n"):
                keys.setdefault(x, []).append(i)
        assert first == sum(len(v) - 1 for v in keys.values() if len(set(v)) >= 25)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_op9(spark, sf, docs):
    assert got(queries.op9_secret_scan(spark, sf), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(brute.secrets(docs))


def test_secret_corners(spark):
    texts = ["ſecret = abcdefg", "Api-Key: x", "API_KEY\" :  'Ab/9.=-", "é password=short\nAKIA" + "A1" * 8, "token=token=abcdef", "AKIAAKIA" + "B" * 12, "deadbeef" * 3, "x" * 50_000 + " passwd:1234567", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.secret_spans(frame, queries.tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    want = {w[0]: w[1:] for w in brute.secrets(list(enumerate(texts)))}
    for r in rows:
        spans = [x.asDict() for x in r.spans]
        count = [sum(x["kind"] == k for x in spans) for k in ("assign", "access", "hex")]
        assert (*count, secret_scan.base_digest(spans)) == want[r.doc_id]


def test_random_strings(spark):
    encode = secret_scan.encoding(queries.tokenizer_path("byte_bpe_50k.tiktoken")).encode_ordinary
    hit = lambda s: secret_scan.is_random(s, encode, 2.0)
    assert hit(b"xK9vQ2mZ7pLw4RtY8sNb") and hit(b"q8Zr3tVw1xYk5nMb7cJd9f")
    assert not hit(b"5d41402abc4b2a76b9719d911017c592") and not hit(b"123e4567-e89b-12d3-a456-426614174000")
    assert not hit(b"release_notes_2024_version_12") and not hit(b"internationalisation")


def test_op10(spark, sf, docs):
    want = brute.contamination(docs, table(spark, sf, "benchmark", "item_id", "text"))
    assert got(queries.op10_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


@pytest.mark.parametrize("local", [0, 10**6])
def test_fingerprints_sent_or_shuffled(spark, local, monkeypatch):
    """Short items, item ends, hits across the runs of a long text: both joins find what brute force finds."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 30)}"
    items = [(f"i{i}", " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(40)] + [("none", "?!"), ("null", None), (None, "w1 w2 w3 w4")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 400)))) for i in range(60)]
    for i in range(60, 90):
        docs.append((i, " ".join(x for _ in range(6) for x in (items[rng.randrange(40)][1], word(), word().upper() + "!"))))
    docs += [(90, None), (91, ""), (92, "W1, w2; w3 w4")]
    monkeypatch.setattr(decontaminate, "LOCAL_MARKS", local)
    want = sorted(brute.contamination(docs, [x for x in items if x[0]] + [("", "w1 w2 w3 w4")]))
    for size in (bytesops.SLICE, 300):
        monkeypatch.setattr(bytesops, "SLICE", size)
        monkeypatch.setattr(bytesops.slices, "__defaults__", (size,))
        near = [(first, count.tolist()) for first, ends, _, _, _, _, count in decontaminate._runs([t for _, t in docs], 10) if ends]
        assert sum(len(c) for _, c in near) == len(docs)
        out = b"".join(_batch_bytes(docs, items))
        assert out == _batch_bytes.seen.setdefault("out", out)
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in found) == [w[:3] for w in want]


def _batch_bytes(docs, items):
    """What the tasks find, without Spark: the workers do not see a test's changes to the module."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"item_id": i, "text": t or ""} for i, t in items], pa.schema([("item_id", pa.string()), ("text", pa.string())]))
    windows = pa.Table.from_batches(list(decontaminate._item_windows(10, 5)([rows])))
    marks = np.sort(np.unique(windows.column("mark").to_numpy()).view(np.uint64))
    sizes = sorted(set(windows.column("size").to_pylist()))
    batch = pa.RecordBatch.from_pylist([{"k1": i, "k2": 0, "doc_id": i, "text": t or ""} for i, t in docs])
    shared = type("Shared", (), {"value": marks})
    for out in decontaminate._extended(shared, sizes, 10, 5)([batch]):
        for x in out.to_pylist():
            x["near"].sort(key=lambda h: (h["size"], h["start"]))
            yield repr(x).encode()


_batch_bytes.seen = {}
