"""Tables in versions: upserts that replay harmlessly, and readers that see one version.

    path/data/<name>/part=<part>/   Parquet files, never changed
    path/versions/<number>.json     which folder holds each part, and the last batch of each stream

A part is a bucket of the keys' hash, under the value of ``by`` where a table has such a column (a
layer).  A write makes new folders for the parts it touches and then a new manifest, which is moved
into place only if no other writer has taken its number; else the write is done again on what that
writer left.  Readers take a manifest and read its folders alone, whatever is written meanwhile.

A batch of a stream carries the stream's name and its number; a number that the manifest has seen
changes nothing, so a batch may be replayed after any failure.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

TRIES = 20


@dataclass(frozen=True)
class Manifest:
    """A version: folders by part, the rows' schema, and the last batch number by stream."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)


class _Files:
    """A Hadoop file system's few calls that a manifest needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.root.getFileSystem(self.conf)
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.store.listStatus(at)) if self.store.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.store.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a whole file under a name that is free; false where another writer has it."""
        draft = self.path(f"versions/.{uuid.uuid4().hex}")
        out = self.store.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        to = self.path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.store.getUri(), self.conf)
        try:
            context.rename(self.store.makeQualified(draft), self.store.makeQualified(to), self.none)
            return True
        except Exception as e:  # the error that says so is Java's
            if "FileAlreadyExists" not in str(e):
                raise
            self.store.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        self.store.delete(self.path(name), True)


class VersionedTable:
    """Rows with unique ``keys`` under one path."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("doc", "id"), by: str | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), list(keys), by, buckets
        self.files = _Files(spark, self.path)

    def _part(self) -> Column:
        bucket = F.lpad(F.pmod(F.hash(self.keys[0]), F.lit(self.buckets)).cast("string"), 5, "0")
        return F.concat(F.col(self.by), F.lit("-"), bucket) if self.by else bucket

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The last version, or a given one; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(self.files.read(f"versions/{version:012}.json"))) if version else Manifest()

    def read(self, version: int | Manifest | None = None, only: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version; ``only``: some values of ``by``; ``schema``: of an empty table."""
        m = version if isinstance(version, Manifest) else self.manifest(version)
        shape = StructType.fromJson(json.loads(m.schema)) if m.schema else schema
        if shape is None:
            raise ValueError(f"{self.path} has no version yet")
        folders = [f for part, f in sorted(m.parts.items()) if only is None or part.rpartition("-")[0] in only]
        if not folders:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*(f"{self.path}/{f}" for f in folders))

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """New folders of ``rows`` by part, a file each."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{name}")
        folders = [n for n in self.files.names(name) if n.startswith("part=")]
        return {n.removeprefix("part="): f"{name}/{n}" for n in folders}

    def _commit(self, change, batch: tuple[str, int] | None) -> int:
        """``change`` gives a manifest's new parts; tried again on the last version until no writer was faster."""
        for _ in range(TRIES):
            old = self.manifest()
            if batch and old.batches.get(batch[0], -1) >= batch[1]:
                return old.version
            parts, schema = change(old)
            new = Manifest(old.version + 1, parts, schema, old.batches | ({batch[0]: batch[1]} if batch else {}))
            if self.files.put_new(f"versions/{new.version:012}.json", json.dumps(new.__dict__)):
                return new.version
        raise RuntimeError(f"other writers of {self.path} were faster {TRIES} times")

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Put rows in the place of those with the same keys, or beside the others; the new version."""
        shape = [c for c in rows.columns if c != "part"]

        def change(old: Manifest) -> tuple[dict[str, str], str]:
            touched = [r[0] for r in rows.select(self._part().alias("part")).distinct().collect()]  # at most the table's parts
            held = Manifest(old.version, {p: f for p, f in old.parts.items() if p in touched}, old.schema)
            now = self.read(held, schema=rows.schema).select(*shape)
            keys = self.keys + [self.by] * bool(self.by)
            merged = now.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*shape))
            return old.parts | self._written(merged), rows.schema.json()

        return self._commit(change, batch)

    def overwrite(self, rows: DataFrame, value: str | None = None) -> int:
        """Only these rows from now on; ``value``: of this value of ``by``, the others stay."""

        def change(old: Manifest) -> tuple[dict[str, str], str]:
            kept = {p: f for p, f in old.parts.items() if value is not None and p.rpartition("-")[0] != value}
            return kept | self._written(rows), rows.schema.json()

        return self._commit(change, None)

    def clean(self, keep: int = 2) -> None:
        """Delete what the last ``keep`` versions do not name; no reader may hold an older one, no writer be at work."""
        last = self.versions()[-keep:]
        named = {f.split("/")[1] for v in last for f in self.manifest(v).parts.values()}
        for v in self.versions()[:-keep]:
            self.files.delete(f"versions/{v:012}.json")
        for name in self.files.names("data"):
            if name not in named:
                self.files.delete(f"data/{name}")


def upsert_stream(rows: DataFrame, table: VersionedTable, name: str, checkpoint: str) -> StreamingQuery:
    """A streaming query that upserts what arrives; of one key in a batch the row with the largest values stays."""

    def put(batch: DataFrame, number: int) -> None:
        keys = table.keys + [table.by] * bool(table.by)
        rest = [c for c in batch.columns if c not in keys]
        once = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
        table.upsert(once.select(*batch.columns), (name, number))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
