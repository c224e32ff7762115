"""Resumed, incremental and chained translation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import overlay

Translator = Callable[[str], str]


def unfinished(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items of chunks that no finished translation covers."""
    return items.join(done.select("doc", "chunk").distinct(), ["doc", "chunk"], "left_anti")


def translate(items: DataFrame, translator: Translator) -> DataFrame:
    """``doc, chunk, id, zh`` by a function that is called in tasks, batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[["doc", "chunk", "id"]].assign(zh=[None if t is None else translator(t) for t in p.text])

    kinds = dict(items.dtypes)
    return items.select("doc", "chunk", "id", "text").mapInPandas(run, f"doc {kinds['doc']}, chunk {kinds['chunk']}, id string, zh string")


def top_up(base: DataFrame, new: DataFrame) -> DataFrame:
    """New translations laid over a base by stable block id."""
    layers = base.select("doc", "id", "zh", F.lit(0).alias("priority")).unionByName(new.select("doc", "id", "zh", F.lit(1).alias("priority")))
    return overlay.merge_layers(layers)


def chained(items: DataFrame, step: Callable[[list[str], str], tuple[list[str], str]], schema: str) -> DataFrame:
    """Translate a document's items in order with carried state; documents run side by side.

    ``step(texts of a chunk, state) -> (translations, state)``; state starts empty.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = "", []
        for chunk, part in rows.sort_values(["chunk", "ord"]).groupby("chunk", sort=True):
            done, state = step(part.text.tolist(), state)
            out += [(d, chunk, i, z) for d, i, z in zip(part.doc, part.id, done, strict=True)]
        return pd.DataFrame(out, columns=["doc", "chunk", "id", "zh"])

    return items.groupBy("doc").applyInPandas(run, schema)


def stream_translations(items: DataFrame, translator: Translator, out: str, checkpoint: str) -> StreamingQuery:
    """A streaming query that translates arriving items and appends them; the checkpoint is the resume point."""
    done = translate(items, translator)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_logs(lanes: DataFrame) -> DataFrame:
    """``doc, term, zh``: term logs of several lanes as one; the first entry by sequence and lane wins."""
    return lanes.groupBy("doc", "term").agg(F.min_by("zh", F.struct("seq", "lane")).alias("zh"))


def windowed_counts(events: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of event types in tumbling windows with a watermark; works on a stream and on a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
