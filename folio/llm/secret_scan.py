"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Fixed kinds are ``assign`` (a credential name, then its value), ``access`` (an access key id) and
``hex`` (a long hexadecimal run).  The method adds ``random``: a run of base64-like characters
with letters whose characters per token under a tiktoken vocabulary are few, since merges learned
from text do not fit random strings.  Known digests (hexadecimal of a digest's length), UUIDs and
identifiers (words joined by ``_``, ``-`` or ``/``, also with numbers) are left out.  A run of
letters in the case of a word (all capitals, or none after the first) may be an unknown word, so
it has to be below nine tenths of the ratio or have vowels in at most three letters of ten.

Defined cases: a null or empty text has no spans; repeated rows and null ids each get a row; an
empty table gives no rows; extra columns are ignored.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B
from .store import keyed

KINDS = ("assign", "access", "hex", "random")
# fixed patterns, over bytes whose A-Z are lower-cased
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(rb"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_HEX = re.compile(rb"[0-9a-f]+", re.I)
_CASED = rb"(?:[A-Z]?[a-z]+|[A-Z]+)"
_WORD = re.compile(_CASED)
_WORDS = re.compile(_CASED + rb"(?:[_/+-]+" + _CASED + rb")+")
_VOWELS = b"aeiouyAEIOUY"
WORD_RATIO, WORD_VOWELS = 0.9, 0.3
_IDENTIFIER = re.compile(rb"(?:[a-zA-Z]+|[A-Z]?[a-z]+|[0-9]{1,8})(?:[_/+-]+(?:[a-zA-Z]+|[0-9]{1,8}))*")
SCHEMA = "k1 long, k2 long, doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def is_random(run: bytes, encode, max_chars_per_token: float) -> bool:
    if not re.search(rb"[A-Za-z]", run):
        return False
    if not re.search(rb"[0-9]", run):
        return _is_random_letters(run, encode, max_chars_per_token)
    if (len(run) in DIGEST_CHARS and _HEX.fullmatch(run)) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run):
        return False
    return len(run) <= max_chars_per_token * len(encode(run.decode("ascii")))


def _is_random_letters(run: bytes, encode, max_chars_per_token: float) -> bool:
    if _WORDS.fullmatch(run):
        return False
    ratio = len(run) / len(encode(run.decode("ascii")))
    if not _WORD.fullmatch(run) or len(run) - len(run.translate(None, _VOWELS)) <= WORD_VOWELS * len(run):
        return ratio <= max_chars_per_token
    return ratio <= WORD_RATIO * max_chars_per_token


def _runs(raw: np.ndarray, kept: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    ok = np.zeros(256, np.int8)
    ok[list(kept)] = 1
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ok[raw]
    edges = np.flatnonzero(np.diff(inside))
    long = edges[1::2] - edges[0::2] >= least
    return edges[0::2][long], edges[1::2][long]


def slice_spans(raw: np.ndarray, encode, min_random: int, max_chars_per_token: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of a slice; no pattern matches the newline between texts."""
    data = raw.tobytes()
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data.lower()) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= MIN_ACCESS]
    found += [(a, 2, z) for a, z in zip(*(x.tolist() for x in _runs(raw, b"0123456789abcdef", MIN_HEX)))]
    run_bytes = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    for a, z in zip(*(x.tolist() for x in _runs(raw, run_bytes, min_random))):
        if is_random(data[a:z], encode, max_chars_per_token):
            found.append((a, 3, z))
    return sorted(found)


def _scan(path: str, min_random: int, max_chars_per_token: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for first, raw, starts in B.slices(b.column("text").to_pylist()):
                n = len(starts) - 1
                spans: list[list[dict]] = [[] for _ in range(n)]
                if found := slice_spans(raw, encode, min_random, max_chars_per_token):
                    points = np.zeros(len(raw) + 1, np.int64)
                    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
                    for a, kind, z in found:
                        d = int(np.searchsorted(starts, a, "right")) - 1
                        at = int(points[starts[d]])
                        spans[d].append({"kind": KINDS[kind], "start": int(points[a]) - at, "end": int(points[z]) - at})
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("doc_id"), pa.array(spans, kind_of)], names=["k1", "k2", "doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, vocabulary: str, min_random: int = 16, max_chars_per_token: float = 2.0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, spans`` of each row: spans by start, then kind in the order of ``KINDS``."""
    return keyed(docs, id_col, text_col).mapInArrow(B.bounded(_scan(vocabulary, min_random, max_chars_per_token)), SCHEMA)


def joined_spans(spans: list[dict]) -> str:
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in spans)


def base_digest(spans: list[dict]) -> str:
    return hashlib.sha256(joined_spans([x for x in spans if x["kind"] != "random"]).encode()).hexdigest()
