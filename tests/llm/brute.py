"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(docs, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add((i, t))
    bad = {k for k, v in seen.items() if k and len(v) >= min_docs}
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in bad]
        out.append((i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return out


def contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    index = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if n:
            sizes.add(n)
            for a in range(len(w) - n + 1):
                index[tuple(w[a : a + n])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := index.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def warc(pages):
    firsts = {}
    for i, h in pages:
        p = (h or "").encode()
        if len(p) >= 100 and (p not in firsts or i < firsts[p]):
            firsts[p] = i
    out = []
    for i, h in pages:
        p = (h or "").encode()
        first = firsts.get(p, i)
        out.append((i, len(p), sha(p), "response" if first == i else "revisit", None if first == i else first))
    return out


def secrets(docs):
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = []
    for i, t in docs:
        t = t or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = ("assign", "access", "hex")
        out.append((i, len(a), len(b), len(c), sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(a + b + c)))))
    return out


def pieces(docs, encode, size=1024, end_id=2):
    """(doc_id, piece, length, crc32) is what packing may not change; start follows."""
    out = []
    for i, t in docs:
        ids = [*encode(t or ""), end_id]
        cut = len(ids) % size or min(size, len(ids))
        edges = [0, *range(cut, len(ids) + 1, size)]
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            out.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    return out


def neighbours(ids, v, queries, top=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        d[[j for j, x in enumerate(ids) if x == q]] = np.inf
        order = np.lexsort((ids, d))[:top]
        out[q] = [(ids[j], d[j]) for j in order if np.isfinite(d[j])]
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(docs, percent=85):
    """doc_id -> (set size, smallest reachable id), by all pairs that share a shingle."""
    sets, index = {}, defaultdict(list)
    for i, t in docs:
        sets[i] = shingles(t)
    by_set = defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    reps = []
    for s, own in by_set.items():
        for x in own[1:]:
            link(own[0], x)
        reps.append((own[0], s))
    for i, s in reps:
        for x in s:
            index[x].append(i)
    for i, s in reps:
        common = Counter(j for x in s for j in index[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                link(i, j)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(docs, size=200):
    """op5: every byte under a ``size``-byte string that starts at more than one place."""
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for a in range(len(b) - size + 1):
            seen[hash(b[a : a + size])] += 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for a in range(len(b) - size + 1):
            if seen[hash(b[a : a + size])] > 1:
                gone[a] += 1
                gone[a + size] -= 1
        off = np.cumsum(gone[:-1]) > 0
        runs = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()) if len(off) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~off]) if len(b) else b""
        out.append((i, len(b), int(off.sum()), runs, sha(kept)))
    return out


def chunks(data, gear, cut, least, most):
    """Ends of content-defined chunks, byte by byte."""
    ends, last = [], 0
    for i in range(len(data)):
        size = i + 1 - last
        h = sum(int(gear[data[i - j]]) << j for j in range(16) if i >= j) & 0xFFFFFFFF
        if size == most or (size >= least and not h & cut):
            ends.append(i + 1)
            last = i + 1
    return ends + [len(data)] * (last < len(data))


def substrings(docs, cdc, min_run=80):
    """op1 for documents with ids of their own (rows may repeat): doc_id -> (bytes, repeated, removed, runs, digest)."""
    parts, seen = {}, defaultdict(list)
    for i, t in docs:
        raw, at = (t or "").encode(), 0
        parts[i] = []
        for z in cdc(raw):
            parts[i].append((at, raw[at:z]))
            seen[raw[at:z]].append((i, at))
            at = z
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone, repeated = np.zeros(len(raw), bool), 0
        run = []
        for at, piece in [*parts[i], (None, None)]:
            if piece is not None and len(seen[piece]) > 1:
                run.append((at, piece))
                continue
            if sum(len(p) for _, p in run) >= min_run:
                for a, p in run:
                    repeated += len(p)
                    gone[a : a + len(p)] = min(seen[p]) != (i, a)
            run = []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out[i] = (len(raw), repeated, int(gone.sum()), len(edges) // 2, sha(bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""))
    return out
