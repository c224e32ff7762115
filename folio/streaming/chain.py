"""Chained translation as a stateful stream: a document's chunks in order, with carried state.

The state of a document is the number of the chunk that comes next, what the step carried over
(the tail of the last translation, the term log) and the chunks that came too early.  It lives in
the state store and its checkpoint, so a query that is stopped goes on in the middle of a document.
A chunk that came before is left out.  If a missing chunk keeps later ones waiting longer than
``patience``, a timer passes over it; their rows are marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: ``step(texts of a chunk, carried) -> (translations, carried)``; carried starts empty.
Step = Callable[[list[str], str], tuple[list[str], str]]
OUT = "doc string, chunk int, id string, zh string, after_gap boolean"


def chunk_rows(items: DataFrame) -> DataFrame:
    """``doc, chunk, ids, texts``: a row a chunk, its items in order (the unit that may arrive)."""
    own = F.array_sort(F.collect_list(F.struct("ord", "id", "text")))
    rows = items.groupBy("doc", "chunk").agg(own.alias("own"))
    return rows.select(F.col("doc").cast("string").alias("doc"), F.col("chunk").cast("int").alias("chunk"), F.col("own.id").alias("ids"), F.col("own.text").alias("texts"))


class Chain(StatefulProcessor):
    def __init__(self, step: Step, first: int, patience_ms: int):
        self.step, self.first, self.patience_ms = step, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "chunk int, carried string")
        self.early = handle.getMapState("early", "chunk int", "ids array<string>, texts array<string>")

    def _state(self) -> tuple[int, str]:
        return tuple(self.next.get()) if self.next.exists() else (self.first, "")

    def _drained(self, key, chunk: int, carried: str, gap: bool) -> Iterator[pd.DataFrame]:
        """Translate from ``chunk`` on for as long as the next one is there."""
        while self.early.containsKey((chunk,)):
            ids, texts = self.early.getValue((chunk,))
            done, carried = self.step(list(texts), carried)
            self.early.removeKey((chunk,))
            yield pd.DataFrame({"doc": key[0], "chunk": chunk, "id": list(ids), "zh": done, "after_gap": gap})
            chunk, gap = chunk + 1, False
        self.next.update((chunk, carried))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk, carried = self._state()
        for part in rows:
            for r in part.itertuples():
                if r.chunk >= chunk and not self.early.containsKey((int(r.chunk),)):
                    self.early.updateValue((int(r.chunk),), (list(r.ids), list(r.texts)))
        yield from self._drained(key, chunk, carried, False)
        waiting = any(True for _ in self.early.keys())
        if waiting and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunk, carried = self._state()
        if (least := min((k[0] for k in self.early.keys()), default=None)) is not None:
            yield from self._drained(key, least, carried, least > chunk)
            if any(True for _ in self.early.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def close(self) -> None:
        pass


def chained_stream(chunks: DataFrame, step: Step, first: int = 0, patience_ms: int = 600_000) -> DataFrame:
    """``doc, chunk, id, zh, after_gap`` of a stream of ``chunk_rows``; ``first``: the number of a document's first chunk.

    State of this kind needs Spark's RocksDB store, which the session's later streams use too.
    """
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.groupBy("doc").transformWithStateInPandas(Chain(step, first, patience_ms), OUT, "Append", "ProcessingTime")


def run_chain(chunks: DataFrame, step: Step, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Translate what has arrived and append it; the checkpoint is where the next run goes on.

    Timers that are due fire in a run that has something to read: Spark would otherwise start empty
    batches as long as a document has state, and a run would never end.
    """
    done = chained_stream(chunks, step, **options)
    conf, name = chunks.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    old = conf.get(name)
    conf.set(name, "false")
    try:  # a query takes its settings when it starts
        return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, old)
