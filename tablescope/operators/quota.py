"""Daily usage limits over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.exprs import col


def daily_usage(log: DataFrame, key: str, ts: str, limit: int = 5) -> DataFrame:
    """``(key, usage_date, requests, allowed, denied, remaining)`` per key and day."""
    n = F.count(F.lit(1))
    return (log.groupBy(col(key).alias("key"), F.to_date(col(ts)).alias("usage_date"))
               .agg(n.alias("requests"))
               .select("key", "usage_date", "requests",
                       F.least("requests", F.lit(limit)).alias("allowed"),
                       F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"),
                       F.greatest(F.lit(limit) - F.col("requests"), F.lit(0)).alias("remaining")))


def admitted(log: DataFrame, key: str, ts: str, order: list[str], limit: int = 5) -> DataFrame:
    """The requests within the limit, with their running count ``used``.

    A row-number filter up to a constant is cut down per task before the shuffle, so a
    key with very many requests sends at most ``limit`` rows per task.
    """
    w = Window.partitionBy(col(key), F.to_date(col(ts))).orderBy(*[col(c) for c in order])
    return log.withColumn("used", F.row_number().over(w)).where(F.col("used") <= limit)


def retain_recent(usage: DataFrame, date: str, days: int = 30) -> DataFrame:
    """Keep rows of the last ``days`` days, counted from the latest date."""
    latest = usage.agg(F.max(F.to_date(col(date)))).first()[0]
    return usage.where(F.to_date(col(date)) >= F.date_sub(F.lit(latest), days))
