"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, deflated, and move deflated; record headers are stored separately, exactly
as they stand in the record, with the header of the HTTP response that begins its block.  A
record is its header joined with its payload: a *response* has the payload behind the HTTP header,
a *revisit* the HTTP header alone and the id of the response.  The first record (by id) of
payloads of at least ``min_revisit`` bytes is the response and later ones are revisits of it;
smaller payloads are always responses.  On reading, every payload is hashed again, the records
are put together to WARC/1.1 bytes and these are parsed; what does not fit fails the job.

Defined cases: a null payload is empty; a null id is never the first of its group if another has
an id, and its header has an empty record id; repeated rows each get a record (of equal ids, all
are responses); control characters, blanks and Unicode line ends of a url are percent-encoded, so
no url can bring a header line; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .store import small_batches

CRLF = "\r\n"
# fixed values of the format
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = "[\\x00-\\x20\\x7f-\\x9f\\u2028\\u2029]"
_PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(CRLF))


def _page(name: str, value: Column) -> Column:
    return _line(name, F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">")))


def safe_url(url: Column) -> Column:
    """``url`` with control characters, blanks and Unicode line ends percent-encoded (null: empty)."""
    safe = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(_UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.coalesce(F.when(url.rlike(_UNSAFE), F.array_join(safe, "")).otherwise(url), F.lit(""))


def _header(kind: Column, date: str) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), _line("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    revisit = F.concat(_page("WARC-Refers-To", F.col("first_id")), _line("WARC-Profile", F.lit(PROFILE)))
    block = F.length(http) + F.when(kind == "revisit", F.lit(0)).otherwise(F.col("n"))  # the HTTP header is ASCII
    return F.concat(
        F.lit(VERSION + CRLF), _line("WARC-Type", kind), _page("WARC-Record-ID", F.col("page_id")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", safe_url(F.col("url"))), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(kind == "revisit", revisit).otherwise(""), _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(CRLF), http)


def deflated(payload: Column) -> Column:
    """Payloads as zlib streams: what is shuffled and stored."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else zlib.compress(v) for v in values.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(payload)


def inflated(stored: Column) -> Column:
    """Payloads of zlib streams; null for anything else."""

    def read(value: bytes | None) -> bytes | None:
        try:
            return None if value is None else zlib.decompress(value)
        except zlib.error:
            return None

    def run(values: pa.Array) -> pa.Array:
        return pa.array([read(v) for v in values.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(stored)


def write_archive(pages: DataFrame, path: str, min_revisit: int = 100, date: datetime | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write ``path/headers`` (digest, header) and ``path/payloads`` (digest, deflated payload; one row a digest).

    ``date``: of all records; the time of writing where none is given.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload").cast("long"), "place": F.struct(F.col("page_id").isNull().alias("none"), "page_id")})
    firsts = rows.groupBy("digest").agg(F.min("place")["page_id"].alias("first_id"))
    heads = rows.select("page_id", "url", "digest", "n").join(firsts, "digest")
    kind = F.when((F.col("n") >= min_revisit) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), "revisit").otherwise("response")
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads.select("digest", _header(kind, stamp).alias("header")).write.parquet(f"{path}/headers")
    # each task keeps one row of a digest before payloads move, so copies of one page never meet in one task
    small_batches(pages.sparkSession)
    once = rows.select("digest", "place", deflated(F.col("payload")).alias("payload")).groupBy("digest").agg(F.min_by("payload", "place").alias("payload"))
    once.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``header, payload, digest`` of each record; payloads are verified against their digest."""
    heads = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    small_batches(spark)
    # payloads are inflated behind the join, so they are small where they move
    found = heads.join(stored, "digest").select("header", inflated(F.col("payload")).alias("payload"), "digest")
    return found.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))).cast("binary")))


def record_of(header: bytes, payload: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    revisit = b"\r\nWARC-Type: revisit\r\n" in header
    return header + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields of the WARC header by lower-case name, HTTP header, payload) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split(CRLF)
    fields = {}
    for line in lines:
        name, found, value = line.partition(":")
        if not found or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip(" \t")
    size = int(fields["content-length"])
    if version != VERSION or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n" or "warc-date" not in fields:
        raise ValueError(f"not a record of {VERSION}: {head[:200]!r}")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("the block is no HTTP response")
    if fields["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"]:
        raise ValueError(f"payload does not match digest {fields['warc-payload-digest']}")
    return fields, http + b"\r\n\r\n", payload


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [record_of(h.encode("utf-8", "surrogatepass"), p) for h, p in zip(b.column("header").to_pylist(), b.column("payload").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.large_binary()).cast(pa.binary())], names=["record"])


def record_bytes(records: DataFrame) -> DataFrame:
    """``record``: the bytes of each record, as they stand in a WARC file."""
    small_batches(records.sparkSession)
    return records.mapInArrow(B.bounded(_record_rows), "record binary")


def _ident(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _PARSED.split(", ")]
    for b in batches:
        out = []
        for header, whole in zip(b.column("header").to_pylist(), b.column("payload").to_pylist(), strict=True):
            fields, _, payload = parse_record(record_of(header.encode("utf-8", "surrogatepass"), whole))
            if fields["warc-type"] == "revisit":
                payload = whole  # of the response that it refers to
            out.append((_ident(fields["warc-record-id"]), fields["warc-target-uri"] or None, len(payload), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], _ident(fields.get("warc-refers-to")), payload))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds, strict=True)], names=names)


def parsed(records: DataFrame) -> DataFrame:
    """Each record put together and read back: the fields of its header, and its payload (a revisit's: that of its response)."""
    small_batches(records.sparkSession)
    return records.select("header", "payload").mapInArrow(B.bounded(_parsed), _PARSED)
