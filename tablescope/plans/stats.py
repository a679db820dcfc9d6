"""Fused statistics: one aggregate for many columns, value counts for the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col, digest, parse_number, sample_kurtosis, sample_skew
from tablescope.functions.kinds import kinds
from tablescope.plans.runtime import lookup_join

Metric = Callable[[Column], Column]

# Aggregates per pass; wider passes leave generated code.
FIELDS_PER_PASS = 96


def long_aggregate(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric],
                   by: Sequence[str] = (), weight: int = 1) -> DataFrame:
    """``metrics`` of every column as rows ``(by..., column, metric...)``.

    All columns share one scan and one aggregate (split only when it gets too wide);
    the wide result is turned into rows after aggregation, when it is tiny. ``weight`` is
    the number of buffer fields of a metric, for metrics that need many.
    """
    per_pass = max(1, FIELDS_PER_PASS // max(1, weight * len(metrics)))
    out = None
    for start in range(0, len(columns), per_pass):
        part = _one_pass(df, columns[start:start + per_pass], metrics, by)
        out = part if out is None else out.unionByName(part)
    return out


def _one_pass(df, columns, metrics, by):
    aggs = [fn(col(c)).alias(f"m{i}_{j}")
            for i, c in enumerate(columns) for j, fn in enumerate(metrics.values())]
    wide = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"m{i}_{j}").alias(name) for j, name in enumerate(metrics)])
        for i, c in enumerate(columns)])
    return (wide.select(*[col(b) for b in by], F.explode(rows).alias("r"))
                .select(*[col(b) for b in by], "r.*"))


def as_double(fn: Metric) -> Metric:
    return lambda c: fn(c.cast("double")).cast("double")


NUMERIC_METRICS: dict[str, Metric] = {
    "n": F.count,
    "mean": as_double(F.avg),
    "std": as_double(F.stddev_samp),
    "min": as_double(F.min),
    "max": as_double(F.max),
}
SHAPE_METRICS: dict[str, Metric] = {
    "skew": as_double(sample_skew),
    "kurt": as_double(sample_kurtosis),
}


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                    shape: bool = False) -> DataFrame:
    metrics = {**NUMERIC_METRICS, **SHAPE_METRICS} if shape else NUMERIC_METRICS
    weight = 5 if shape else 1
    if columns and len(columns) * len(metrics) * weight > FIELDS_PER_PASS:
        found = power_sums(df, columns, by)
        return found if shape else found.drop("skew", "kurt")
    return long_aggregate(df, columns, metrics, by, weight)


def power_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, n, mean, std, min, max, skew, kurt)`` in two scans, whatever the number of columns.

    The first gives a pilot mean per column and group, the second sums of powers of the distance to it. Such sums add
    up, so they are combined before the shuffle, and a group or column of any size costs one row per task. Columns
    travel as rows of (column, value), which keeps generated code short for any width.
    """
    columns, by = list(columns), list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    flat = df.select(*[F.struct(col(b)).alias(k) for b, k in zip(by, keys)], *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    flat = flat.unpivot([F.col(k) for k in keys], [F.col(f"_c{i}") for i in range(len(columns))], "_col", "_x")
    keys = [*keys, "_col"]
    pilot = flat.groupBy(*keys).agg(F.avg("_x").alias("_p"))
    d = F.col("_x") - F.col("_p")
    s = lookup_join(flat, pilot, keys, "inner").groupBy(*keys).agg(
        F.count("_x").alias("n"), F.first("_p", ignorenulls=True).alias("_p"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.sum(d).alias("_s1"), F.sum(d * d).alias("_s2"), F.sum(d * d * d).alias("_s3"), F.sum(d * d * d * d).alias("_s4"))
    if not by:
        # a table without rows still has its columns
        every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f"_c{i}") for i in range(len(columns))])).alias("_col"))
        s = every.join(s, "_col", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    n, mean = F.col("n").cast("double"), F.try_divide(F.col("_s1"), F.col("n"))
    same = F.col("min") == F.col("max")
    s = s.withColumns({"_m": mean, "_m2": F.when(same, 0.0).otherwise(F.greatest(F.col("_s2") - F.col("_s1") * mean, F.lit(0.0))),
                       "_m3": F.col("_s3") - 3 * mean * F.col("_s2") + 2 * mean * mean * F.col("_s1"),
                       "_m4": F.col("_s4") - 4 * mean * F.col("_s3") + 6 * mean * mean * F.col("_s2") - 3 * mean * mean * mean * F.col("_s1")})
    g1 = F.coalesce(F.try_divide(F.sqrt(n) * F.col("_m3"), F.pow(F.col("_m2"), 1.5)), F.lit(0.0))
    g2 = F.try_divide(n * F.col("_m4"), F.col("_m2") * F.col("_m2")) - 3
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    kurt = F.when(n >= 4, F.coalesce((n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0)))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("_col", 3, 10).cast("int") + 1)
    return s.select(*[F.col(k).getField(b).alias(b) for k, b in zip(keys, by)], names.alias("column"), "n", (F.col("_p") + F.col("_m")).alias("mean"),
                    F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))).alias("std"), "min", "max", skew.alias("skew"), kurt.alias("kurt"))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_rows, n_missing, ratio)`` in one aggregate."""
    columns = list(columns or df.columns)
    counted = long_aggregate(df, columns, {
        "n_rows": lambda c: F.count(F.lit(1)),
        "n_missing": lambda c: F.count_if(c.isNull()),
    })
    ratio = F.coalesce(F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")), F.lit(0.0))
    return counted.withColumn("ratio", ratio)


def _as_text(df: DataFrame, columns: Sequence[str], short: bool) -> DataFrame:
    kind = kinds(df)
    out = []
    for name in columns:
        c = col(name)
        if kind[name] == "nested":
            c = F.to_json(F.struct(c.alias("v")))
            c = F.when(col(name).isNotNull(), c)
        elif kind[name] == "numeric":
            c = F.when(c == 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(c)
        c = c.cast("string")
        out.append((digest(c) if short else c).alias(name))
    return df.select(*out)


def value_counts(df: DataFrame, columns: Sequence[str], short: bool = False) -> DataFrame:
    """``(column, value, n)`` over the non-null values of many columns.

    One unpivot and one group-by; equal values are combined before the shuffle, so a
    value that fills a third of the table costs one row per task. ``short`` replaces
    long text by its digest, enough for counting.
    """
    text = _as_text(df, columns, short)
    flat = text.unpivot([], [col(c) for c in columns], "column", "value")
    return flat.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact ``(column, n_distinct)``; columns without values count zero."""
    columns = list(columns or df.columns)
    counted = value_counts(df, columns, short=True).groupBy("column").agg(F.count(F.lit(1)).alias("k"))
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    every = df.sparkSession.range(1).select(names.alias("column"))
    return (every.join(counted, "column", "left")
                 .select("column", F.coalesce("k", F.lit(0).cast("bigint")).alias("n_distinct")))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column ``(column, value)``; ties go to the smallest."""
    kind = kinds(df)
    numeric = [c for c in columns if kind[c] == "numeric"]
    counts = value_counts(df, columns)
    order = F.when(F.col("column").isin(numeric), parse_number(F.col("value"))) if numeric \
        else F.lit(None).cast("double")
    best = F.min(F.struct((-F.col("n")).alias("k"), order.alias("num"), F.col("value")))
    return counts.groupBy("column").agg(best.alias("b")).select("column", F.col("b.value").alias("value"))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column with their rank; ties by value."""
    from pyspark.sql import Window

    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
