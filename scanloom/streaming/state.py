"""Streams: continuous ingestion, cross-run deduplication, sessions, running means and the status machine.

Event times that come without zone are cast to timestamps, as watermarks need; the session's time zone should be UTC.
Each operator gives on a stream what its batch counterpart gives on all of the rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files_stream(spark: SparkSession, folder: str, *, at_once: int = 1000) -> DataFrame:
    """New files of a folder as they arrive."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", at_once).load(folder)


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch of ``stream`` to ``sink`` once per batch number; stops when what is there has been read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], at: str, *, late: str = "1 hour") -> DataFrame:
    """The first row of each key, within the time the watermark keeps."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, at: str, value: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key: begin, end, rows and sum. Works on batch and stream."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def windows(stream: DataFrame, key: str, at: str, value: str, *, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows per key."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, length, slide) if slide else F.window(at, length)
    out = timed.groupBy(key, window.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("begin"), "n", "mean")


def running_means(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the number of values so far and their mean, after each micro-batch: state is two numbers a key."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            kept = frame[value].dropna()
            n, total = n + len(kept), total + float(kept.sum())
        state.update((int(n), float(total)))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else None]})

    return stream.select(key, value).groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def statuses(stream: DataFrame, key: str) -> DataFrame:
    """The status machine on a log (key, status, at as epoch seconds): current status, first start, last end."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, status, started, ended = state.get if state.exists else (float("-inf"), "", None, None)
        for frame in frames:
            for s, t in frame[["status", "at"]].itertuples(index=False):
                if (t, s) > (at, status):
                    at, status = float(t), s
                if s == "in_progress":
                    started = float(t) if started is None else min(started, float(t))
                if s in ("completed", "failed"):
                    ended = float(t) if ended is None else max(ended, float(t))
        state.update((at, status, started, ended))
        yield pd.DataFrame({key: [k[0]], "status": [status], "started_at": [started], "completed_at": [ended]})

    out = f"`{key}` {kind}, status string, started_at double, completed_at double"
    return stream.select(key, "status", "at").groupBy(key).applyInPandasWithState(update, out, "at double, status string, started double, ended double", "update", GroupStateTimeout.NoTimeout)
