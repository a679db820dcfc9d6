"""Incremental forms for event streams: windowed signal statistics and daily quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.exprs import col


def window_stats(events: DataFrame, signal: str, ts: str, value: str, width: str = "1 hour",
                 late: str = "10 minutes") -> DataFrame:
    """Count, mean, std, min and max per signal and tumbling window.

    Works on a stream (late rows are dropped after the watermark) and on a batch. State
    is one small buffer per signal and open window; partial aggregation keeps a hot
    signal to one row per task and window.
    """
    v, t = col(value), col(ts).cast("timestamp")
    timed = events.withColumn("_t", t)
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", width).alias("w"), col(signal))
    stats = grouped.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                        F.min(v).alias("min"), F.max(v).alias("max"))
    return stats.select(col(signal), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "n", "mean", "std", "min", "max")


def sigma_alerts(stats: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Windows whose extreme value lies beyond sigma standard deviations of their mean."""
    high = (F.col("max") - F.col("mean")) > sigma * F.col("std")
    low = (F.col("mean") - F.col("min")) > sigma * F.col("std")
    return stats.where(high | low)


HISTORY = "window_start timestamp, n long, mean double, std double, min double, max double, past_n long, past_mean double, past_std double"


def with_history(stats: DataFrame, signal: str) -> DataFrame:
    """Add ``past_n``, ``past_mean``, ``past_std``: the moments of all values of the signal before the window.

    On a stream each signal keeps three numbers (count, mean, sum of squared distances), to which every
    closed window is merged in time order; the watermark closes windows in that order, and the state survives restarts.
    Spark takes this step on a stream of closed windows, such as the folder that ``run_to_folder`` wrote
    them to, not straight behind the aggregate. A batch sums the same over the windows before. No value is kept, however long the history.
    """
    kind = stats.schema[signal].dataType.simpleString()
    if stats.isStreaming:
        def merge(key, frames, state):
            n, mean, square = state.get if state.exists else (0, 0.0, 0.0)
            rows = pd.concat(list(frames)).sort_values("window_start")
            past = []
            for m, c, s in zip(rows["n"], rows["mean"], rows["std"]):
                past.append((n, mean if n else None, (square / (n - 1)) ** 0.5 if n > 1 else None))
                if m:
                    d, total = c - mean, n + m
                    square += (0.0 if m < 2 else s * s * (m - 1)) + d * d * n * m / total
                    mean, n = mean + d * m / total, total
            state.update((int(n), float(mean), float(square)))
            out = rows[["window_start", "n", "mean", "std", "min", "max"]].copy()
            out.insert(0, signal, key[0])
            for name, column in zip(("past_n", "past_mean", "past_std"), zip(*past)):
                out[name] = column
            yield out

        return stats.drop("window_end").groupBy(col(signal)).applyInPandasWithState(
            merge, f"`{signal}` {kind}, {HISTORY}", "n long, mean double, square double", "append", "NoTimeout")
    before = Window.partitionBy(col(signal)).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n").over(before), F.lit(0))
    total = F.sum(F.col("n") * F.col("mean")).over(before)
    # distances from the signal's overall mean, so that squares do not cancel
    centre = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(col(signal))) / F.sum("n").over(Window.partitionBy(col(signal)))
    ready = stats.drop("window_end").withColumn("_c", centre)
    inner = F.when(F.col("n") > 1, F.col("std") * F.col("std") * (F.col("n") - 1)).otherwise(0.0)
    far = F.col("mean") - F.col("_c")
    squares = F.sum(F.when(F.col("n") > 0, inner + F.col("n") * far * far)).over(before)
    shift = F.try_divide(total, n) - F.col("_c")
    ready = ready.withColumns({"past_n": n, "past_mean": F.try_divide(total, n), "_q": squares - n * shift * shift})
    return ready.withColumn("past_std", F.when(F.col("past_n") > 1, F.sqrt(F.greatest(F.col("_q"), F.lit(0.0)) / (F.col("past_n") - 1)))).drop("_c", "_q")


def history_alerts(stats: DataFrame, signal: str, sigma: float = 2.5, least: int = 30) -> DataFrame:
    """Windows with a value beyond sigma standard deviations of the signal's earlier values, once there are ``least`` of them."""
    known = with_history(stats, signal).where(F.col("past_n") >= least)
    high = F.col("max") - F.col("past_mean") > sigma * F.col("past_std")
    low = F.col("past_mean") - F.col("min") > sigma * F.col("past_std")
    return known.where(high | low)


def daily_quota(events: DataFrame, key: str, ts: str, limit: int = 5, late: str = "1 hour") -> DataFrame:
    """``(key, usage_date, requests, allowed, remaining)`` per key and day."""
    timed = events.withColumn("_t", col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_t", late)
    counted = timed.groupBy(col(key).alias("key"), F.window("_t", "1 day").alias("w")) \
                   .agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("key", F.to_date("w.start").alias("usage_date"), "requests",
                          F.least("requests", F.lit(limit)).alias("allowed"),
                          F.greatest(F.lit(limit) - F.col("requests"), F.lit(0)).alias("remaining"))


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Process what is available and stop; restarts continue from the checkpoint."""
    return (stream.writeStream.format("parquet").outputMode(mode)
            .option("path", folder).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
