"""Streaming twins of the event statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import scratch_dir

#: How late an event may come and still count.
LATENESS = "10 minutes"
HISTORY, LEAST, FAR = 100, 10, 2.5
#: Most alert thresholds.
MOST_THRESHOLDS = 10_000


def stream_table(spark: SparkSession, root: str, name: str, files: int | None = None) -> DataFrame:
    """A stream over a table's files, whether it is one file or a folder; ``files`` is how many make a batch."""
    path = f"{root}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def metric_stream(events: DataFrame) -> DataFrame:
    """(metric, at, id, value) of finite durations with event time."""
    rows = events.where((F.abs("duration") < F.lit(float("inf"))) & F.col("event_name").isNotNull() & F.col("ts").isNotNull())
    return rows.select(F.col("event_name").alias("metric"), F.timestamp_seconds("ts").alias("at"), "id", F.col("duration").alias("value"))


def rolling_stats(stream: DataFrame, width: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Statistics of each metric in sliding windows; later than LATENESS is dropped from the state."""
    w = F.window("at", width, step)
    out = stream.withWatermark("at", LATENESS).groupBy("metric", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("metric", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n", "mean", "low", "high")


def daily_stats(stream: DataFrame) -> DataFrame:
    """Statistics of each metric by day, in windows that do not overlap."""
    return rolling_stats(stream, "1 day", "1 day")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events of a metric in a row without a longer pause than ``gap``."""
    w = F.session_window("at", gap)
    out = stream.withWatermark("at", LATENESS).groupBy("metric", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("metric", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def _scores(past: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each new value lies from the HISTORY values before it, in their deviations; NaN with fewer than LEAST."""
    whole, k = np.concatenate((past, new)), len(past)
    out = np.full(len(new), np.nan)
    for j in range(k, min(len(whole), HISTORY)):  # while the history still fills
        if j >= LEAST and (std := whole[:j].std(ddof=1)) > 0:
            out[j - k] = (whole[j] - whole[:j].mean()) / std
    start = max(k, HISTORY)
    if start < len(whole):
        frames = np.lib.stride_tricks.sliding_window_view(whole[start - HISTORY : -1], HISTORY)
        for i in range(0, len(frames), 10_000):
            f = frames[i : i + 10_000]
            std = f.std(axis=1, ddof=1)
            at = start - k + i
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at : at + len(f)] = np.where(std > 0, (new[at : at + len(f)] - f.mean(axis=1)) / std, np.nan)
    return out


def anomalies(stream: DataFrame) -> DataFrame:
    """Points far from the HISTORY points before them, with the history of each metric as state; within a batch in the order of (at, id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = np.array(state.get[0] if state.exists else [], dtype=np.float64)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        new = rows["value"].to_numpy(np.float64)
        z = _scores(past, new)
        far = np.abs(z) > FAR
        state.update((np.concatenate((past, new))[-HISTORY:].tolist(),))
        yield pd.DataFrame({"metric": key[0], "id": rows["id"].to_numpy()[far], "value": new[far], "z": z[far]})

    return stream.groupBy("metric").applyInPandasWithState(step, "metric string, id bigint, value double, z double", "past array<double>", "append", "NoTimeout")


def alert_sink(stream: DataFrame, thresholds: DataFrame, handle, every: str = "5 minutes", once: bool = False, checkpoint: str | None = None):
    """Start a stream that hands the values of each batch beyond their limits (``metric, min_value, max_value``) to ``handle``, periodically or over what is there."""
    def save(batch: DataFrame, number: int) -> None:
        met = batch.join(F.broadcast(thresholds), "metric")  # at most MOST_THRESHOLDS rows
        handle(met.where("value < min_value or value > max_value").select("metric", "id", "value"), number)

    if thresholds.count() > MOST_THRESHOLDS:
        raise ValueError(f"more than {MOST_THRESHOLDS} thresholds")
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint or f"{scratch_dir(stream.sparkSession)}/alerts-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def run_available(stream: DataFrame, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Run a stream over what is there into the shared folder and read it; with ``keys`` the last state of each."""
    spark = stream.sparkSession
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if not keys:
        return rows.drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("b")).select(*keys, "b.*")
