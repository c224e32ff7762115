"""Paged files as a Spark data source: partitions by file and range of pages.

``spark.read.format("folio_pages")`` with the options

    path        a file, a folder or a pattern (``*`` in the last part), on any store that pyarrow.fs opens in tasks
    kind        one of ``RECORDS``
    parser      ``module:name`` of a ``PageParser`` class
    part_bytes  bytes of a file for each partition (32 MB)

gives the records of one kind.  A file of n partitions is read by n tasks, each of which opens it,
asks the parser for its pages and reads its own range only; no task holds a file's bytes.  Planning
lists names and sizes and opens nothing.  A schema given to the reader prunes columns: the parser
is told which are wanted.

With ``doc`` all files of the path are parts of one document of that name, as of a table that Spark
wrote; its parser then has to be ``numbered``: it gives each page the number that stands in the file.

``docs`` and ``pages`` of ``read_pages`` leave out files, which are then not opened, and pages, which are
not parsed.  With ``push_filters`` comparisons of ``doc`` and ``page`` in a plan do the same.  Spark 4.1
keeps pushed filters for a relation, not for a scan: of a frame that stands in one plan twice with
different filters, one filter would hold for both.  So that is off unless asked for, and only right
for a frame that is used once in a plan; arguments are right everywhere.

A partition is the unit of recovery; a parser's error fails its task with the file's name.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import BinaryIO, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .pdf import RECORDS

NAME, PART_BYTES = "folio_pages", 32 << 20


class PageParser(Protocol):
    """Reads a file that can be opened at any place; pages count from 1.

    A parser with a true ``numbered`` counts pages by their place in the file as well, but its records
    have the page's own number, which holds across files.
    """

    def pages(self, file: BinaryIO) -> int: ...

    def records(self, file: BinaryIO, kind: str, first: int, last: int, columns: list[str]) -> Iterable[dict]:
        """Records of pages ``first`` to ``last``, in order: ``page`` and the other fields by name, at least those of ``columns``."""
        ...


def load(name: str) -> PageParser:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def listed(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files that a path names, by name."""
    from pyarrow import fs

    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    base, _, last = path.rpartition("/")
    pattern = last if "*" in last or "?" in last else ""
    store, root = fs.FileSystem.from_uri(base if pattern else path) if scheme else (fs.LocalFileSystem(), base if pattern else path)
    found = store.get_file_info(root)
    found = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
    # hidden files are no data, as everywhere in Spark
    files = [f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_." and fnmatchcase(f.base_name, pattern or "*")]
    whole = lambda f: f.path if not scheme or scheme == "file://" else path[: path.index(root)] + f.path
    return sorted((whole(f), f.size) for f in files)


def opened(uri: str) -> BinaryIO:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def doc_name(uri: str) -> str:
    """A file's name without folder and extension."""
    name = uri.replace("\\", "/").rpartition("/")[2]
    return name.rpartition(".")[0] or name


@dataclass
class Share(InputPartition):
    """The ``nth`` of ``of`` ranges of a file's pages."""

    uri: str
    nth: int
    of: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind, self.parser = options["path"], options["kind"], options["parser"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.columns = schema.names
        self.doc = options.get("doc")
        self.docs: set[str] | None = set(json.loads(options["docs"])) if "docs" in options else None
        self.first, self.last = json.loads(options.get("pages", "[1, null]"))

    def partitions(self) -> list[Share]:
        out = []
        for uri, size in listed(self.path):
            if self.docs is None or self._name(uri) in self.docs:
                n = max(1, -(-size // self.part_bytes))
                out += [Share(uri, i, n) for i in range(n)]
        return out

    def _name(self, uri: str) -> str:
        return doc_name(uri) if self.doc is None else self.doc

    def read(self, partition: Share | None) -> Iterator[tuple]:
        if partition is None:  # no file is left
            return
        parser = load(self.parser)
        numbered = getattr(parser, "numbered", False)
        if self.doc is not None and not numbered:
            raise ValueError(f"{self.parser} does not number pages across the files of {self.doc}")
        wanted = lambda page: self.first <= page and (self.last is None or page <= self.last)
        with opened(partition.uri) as file:
            n = parser.pages(file)
            first, last = (n * i // partition.of for i in (partition.nth, partition.nth + 1))
            first += 1
            if not numbered:  # places are page numbers
                first, last = max(first, self.first), last if self.last is None else min(last, self.last)
            if first > last:
                return
            doc = self._name(partition.uri)
            try:
                for record in parser.records(file, self.kind, first, last, self.columns):
                    if not numbered or wanted(record["page"]):
                        yield tuple(doc if c == "doc" else record[c] for c in self.columns)
            except Exception as e:
                raise ValueError(f"pages {first} to {last} of {partition.uri} cannot be read as {self.kind}") from e


class PushingPageReader(PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``doc`` with names and of ``page`` with numbers are answered here; the rest goes back."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("doc",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.docs = names if self.docs is None else self.docs & names
            elif column == ("page",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    most = f.value - isinstance(f, LessThan)
                    self.last = most if self.last is None else min(self.last, most)
            else:
                yield f


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORDS[self.options["kind"]]

    def reader(self, schema: StructType) -> PageReader:
        kind = PushingPageReader if self.options.get("push_filters") == "true" else PageReader
        return kind(dict(self.options), schema)


def read_pages(spark: SparkSession, path: str, kind: str, parser: str, columns: list[str] | None = None, part_bytes: int = PART_BYTES,
               docs: list[str] | None = None, pages: tuple[int, int | None] | None = None, push_filters: bool = False, doc: str | None = None) -> DataFrame:
    """Records of one kind of all files of ``path``, or of some ``docs`` and a range of ``pages`` (first and last).

    ``doc``: all files are parts of this document.  ``columns``: only these, in the order of the kind's schema.  ``push_filters`` turns Spark's switch
    for Python sources on; see above for when it may be used.
    """
    spark.dataSource.register(PageSource)
    fields = [f.strip() for f in RECORDS[kind].split(",")]
    wanted = ", ".join(f for f in fields if columns is None or f.split()[0] in columns)
    reader = spark.read.format(NAME).schema(wanted).options(path=path, kind=kind, parser=parser, part_bytes=str(part_bytes))
    if doc is not None:
        reader = reader.option("doc", doc)
    if docs is not None:
        reader = reader.option("docs", json.dumps(docs))
    if pages is not None:
        reader = reader.option("pages", json.dumps(pages))
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("push_filters", "true")
    return reader.load()
