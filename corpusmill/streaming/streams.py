"""Structured Streaming: divergence guard, resumed work, running accuracy, up-time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def diverged(value: str = "kl", limit: float = 0.2) -> Column:
    """Whether a metric is not finite or above its limit; a missing one is 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return F.isnan(v) | (F.abs(v) == float("inf")) | (v > limit)


def guard(metrics: DataFrame, value: str = "kl", limit: float = 0.2, event: str | None = "optimizer_step") -> DataFrame:
    """The rows of a metrics stream (or table) at which a run has to stop. Needs no state."""
    rows = metrics.filter(F.col("event") == event) if event is not None else metrics
    return rows.filter(diverged(value, limit))


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of appended JSON line files; NaN and Infinity are read, other broken lines give nulls."""
    return spark.readStream.schema(schema).option("allowNonNumericNumbers", "true").json(path)


def stop_on_divergence(metrics: DataFrame, stop, checkpoint: str, value: str = "kl", limit: float = 0.2, event: str | None = "optimizer_step", once: bool = False) -> StreamingQuery:
    """Call stop(row) for the first diverged row of each batch."""

    def each(batch: DataFrame, _: int) -> None:
        first = batch.limit(1).collect()
        if first:
            stop(first[0])

    writer = guard(metrics, value, limit, event).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def unseen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows of keys that weren't there before, within the watermark: a row that is sent again is left out."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_accuracy(graded: DataFrame, time: str = "loaded_at", window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(started, rows, correct) of graded rows by the window they were loaded in; late rows count within the watermark."""
    w = F.window(time, window)
    return graded.withWatermark(time, delay).groupBy(w).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("correct").eqNullSafe(F.lit(True))).alias("correct")).select(F.col("window.start").alias("started"), "rows", "correct")


STATE = "started long, last long, pings long"


def _runs(times: np.ndarray, good: np.ndarray, limit: int) -> np.ndarray:
    """The number of the run of each ping in order; a new one begins at a failed ping, behind one, and behind a gap of more than limit seconds."""
    begins = np.ones(len(times), dtype=bool)
    begins[1:] = ~good[1:] | ~good[:-1] | (np.diff(times) > limit)
    return np.cumsum(begins)


def uptime_stream(pings: DataFrame, group: str = "endpoint", interval_s: int = 300) -> DataFrame:
    """(group, started_s, ended_s, pings, seconds) of up-time runs, written when a run has ended: by a failed ping, a gap, or silence of two intervals.

    pings: group, ts, ok, with a watermark on ts. The state is the open run; it comes before a batch's pings as one of them (a late
    ping counts at the time of the run's last), so a batch is cut into runs in one piece and its last good run is the next state.
    """
    limit = 2 * interval_s
    columns = [group, "started_s", "ended_s", "pings", "seconds"]

    def table(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: key[0], "started_s": runs["started"], "ended_s": runs["last"], "pings": runs["pings"], "seconds": (runs["last"] - runs["started"] + interval_s).astype(float)}, columns=columns)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([state.get] if state.exists else [], columns=["started", "last", "pings"]).astype("int64")
        if state.hasTimedOut:
            state.remove()
            yield table(key, held)
            return
        new = pd.concat(list(batches)).sort_values(["ts", "ok"])
        at = (pd.to_datetime(new["ts"]) - pd.Timestamp(0)) // pd.Timedelta(seconds=1)
        at = np.maximum(at.to_numpy(dtype="int64"), held["last"].max() if len(held) else np.iinfo("int64").min)
        rows = pd.concat([held.assign(ok=True), pd.DataFrame({"started": at, "last": at, "pings": 1, "ok": new["ok"].to_numpy(dtype=bool)})], ignore_index=True)
        good = rows["ok"].to_numpy(dtype=bool)
        rows["run"] = _runs(rows["last"].to_numpy(), good, limit)
        runs = rows[good].groupby("run").agg(started=("started", "first"), last=("last", "last"), pings=("pings", "sum"))
        if good[-1]:
            started, last, count = (int(x) for x in runs.iloc[-1])
            state.update((started, last, count))
            state.setTimeoutTimestamp((last + limit + 1) * 1000)
            runs = runs.iloc[:-1]
        elif state.exists:
            state.remove()
        yield table(key, runs)

    return pings.groupBy(group).applyInPandasWithState(step, f"{group} string, started_s long, ended_s long, pings long, seconds double", STATE, "append", "EventTimeTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over all that is there and write its rows as Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
