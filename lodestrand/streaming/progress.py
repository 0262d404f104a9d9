"""Streams: progress counts over event time, stage states from a log stream, resumable appends."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import views

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A file stream of events, with event time as a time stamp."""
    folder, name = str(PurePosixPath(path).parent), PurePosixPath(path).name
    folder = path[: -len(name) - 1] if "://" in path else folder
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def progress(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start_ms, event_type, n, total for each window; events later than ``late`` are dropped."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counted = seen.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


def stage_changes(lines: DataFrame) -> DataFrame:
    """run_id, stage, state, line_no from a stream of log lines: a row whenever a stage's latest state changes."""

    def advance(key, batches: Iterable[pd.DataFrame], state: GroupState):
        last, line = state.get if state.exists else (None, -1)
        for batch in batches:
            newest = batch.loc[batch["line_no"].idxmax()]
            if newest["line_no"] > line:
                line = int(newest["line_no"])
                if newest["state"] != last:
                    last = str(newest["state"])
                    yield pd.DataFrame([[*key, last, line]], columns=["run_id", "stage", "state", "line_no"])
        state.update((last, line))

    return views.log_events(lines).groupBy("run_id", "stage").applyInPandasWithState(
        advance, "run_id long, stage string, state string, line_no long", "state string, line_no long", "append", GroupStateTimeout.NoTimeout
    )


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, schema: str, slices: int = 64):
    """A writer that adds rows whose key isn't there yet, by slices of keys and batches.

    A row lies in the folder of its key's slice and of the batch (of the query with this checkpoint) that
    brought it. A batch reads the keys of the slices that it has rows for and no others, and replaces its own
    folders as a whole: run again after a failure, it neither adds nor loses anything.
    """
    query, whole = f"{zlib.crc32(checkpoint.encode()):08x}", f"{schema}, slice int, batch string"

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{query}-{number}"
        dealt = batch.dropDuplicates([key]).withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).withColumn("batch", F.lit(own))
        spark.createDataFrame([], whole).write.mode("ignore").partitionBy("slice", "batch").parquet(path)
        mine = [r[0] for r in dealt.select("slice").distinct().collect()]  # ``slices`` at most
        there = spark.read.schema(whole).parquet(path).where(F.col("slice").isin(mine) & (F.col("batch") != own))
        new = dealt.join(there.select(key), key, "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class EventLog:
    """A run's events: a bounded history for late subscribers, delivery to all, and an end."""

    def __init__(self, history: int = 300):
        from collections import deque

        self._history, self._subscribers, self.closed = deque(maxlen=history), [], False

    def subscribe(self, receive) -> None:
        for event in self._history:
            receive(event)
        if self.closed:
            receive(None)
        else:
            self._subscribers.append(receive)

    def publish(self, event: dict) -> None:
        if not self.closed:
            self._history.append(event)
            for receive in self._subscribers:
                receive(event)

    def close(self) -> None:
        self.closed = True
        for receive in self._subscribers:
            receive(None)
        self._subscribers = []


def with_retry(call, attempts: int = 4, first_wait: float = 1.0, retry_on=(ConnectionError, TimeoutError), sleep=None):
    """``call()``, tried again after waits that double; other errors, such as refused requests, are raised at once."""
    import time

    for i in range(attempts):
        try:
            return call()
        except retry_on:
            if i == attempts - 1:
                raise
            (sleep or time.sleep)(first_wait * 2**i)
