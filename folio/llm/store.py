"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
#: Rows of a few numbers that make a file worth its while.
ROWS_PER_FILE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all runs in one process, as in tests, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a later loss of executors costs only the tasks that ran there.
    ``rows``: a bound of the number of rows, where it is known; small tables get few files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS_PER_FILE) or 1)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folio_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``saved`` that nothing reads any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._folio_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python workers 2,000 at a time unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 2000:
        spark.conf.set(name, "2000")


def digest_lanes(value: Column, n: int = 2) -> list[Column]:
    """The first ``n`` 64-bit words of a value's SHA-256, as longs.

    Faster hashes of Spark have pairs of texts that agree under every seed, so two of them are no more than one.
    """
    digest = F.sha2(value, 256)
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(n)]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two non-null longs that name a row by its id and text (the second: half of a SHA-256 of both).

    Rows that repeat both are one document; null ids and repeated ids with other texts stay apart.
    """
    both = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), digest_lanes(both, 1)[0].alias("k2")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, text`` (null text: empty); other columns are left out, so no names clash."""
    small_batches(docs.sparkSession)
    return docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
