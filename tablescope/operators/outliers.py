"""Outlier bounds (fit) and what to do with values outside them (apply)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import clip, col, outside
from tablescope.functions.kinds import numeric_columns
from tablescope.options import Options
from tablescope.plans.quantiles import quantile_row, quantiles
from tablescope.plans.stats import long_aggregate, numeric_summary

BOUNDS = "column string, n_values bigint, lower double, upper double, iqr double"


def bounds_table(df: DataFrame, columns: Sequence[str], method: str, width: float,
                 opts: Options = Options()) -> DataFrame:
    """``(column, n_values, lower, upper, iqr)``; ``width`` is the IQR factor or z threshold."""
    if not columns:
        return df.sparkSession.createDataFrame([], BOUNDS)
    if method == "zscore":
        s = numeric_summary(df, columns)
        spread = F.col("std") * width
        return s.select("column", F.col("n").alias("n_values"), (F.col("mean") - spread).alias("lower"),
                        (F.col("mean") + spread).alias("upper"), F.col("std").alias("iqr"))
    counts = long_aggregate(df, columns, {"n_values": F.count})
    q = quantiles(df, columns, (0.25, 0.75), (), opts).groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return counts.join(F.broadcast(q), "column").select(
        "column", "n_values", (F.col("q1") - width * iqr).alias("lower"),
        (F.col("q3") + width * iqr).alias("upper"), iqr.alias("iqr"))


def outlier_counts(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` with ``n_outliers``; the bounds (one row per column) become literals."""
    fitted = bounds.collect()
    if not fitted:
        return bounds.withColumn("n_outliers", F.lit(0).cast("bigint"))
    limit = {r["column"]: (r["lower"], r["upper"]) for r in fitted}
    aggs = F.array(*[F.struct(F.lit(c).alias("column"),
                              F.count_if(outside(col(c), lo, hi)).alias("n_outliers"))
                     for c, (lo, hi) in limit.items()])
    counts = df.agg(aggs.alias("a")).select(F.explode("a").alias("r")).select("r.*")
    known = df.sparkSession.createDataFrame([tuple(r) for r in fitted], bounds.schema)
    return known.join(F.broadcast(counts), "column")


def detect_outliers(df: DataFrame, method: str = "iqr", opts: Options = Options(),
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Summary ``(column, n_outliers, ratio, lower, upper)`` of columns that have outliers.

    IQR with factor 1.5 or absolute z above 3; the isolation forest lives in
    ``operators.isolation``.
    """
    columns = list(columns or numeric_columns(df))
    bounds = bounds_table(df, columns, method, 3.0 if method == "zscore" else 1.5, opts)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    # n is one row.
    return (outlier_counts(df, bounds).where("n_outliers > 0").crossJoin(F.broadcast(n))
            .select("column", "n_outliers", (F.col("n_outliers") / F.col("n_rows")).alias("ratio"),
                    "lower", "upper"))


def outlier_values(df: DataFrame, bounds: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """The offending values, long: ``(row_id..., column, value)``."""
    limit = {r["column"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    keep = df.select(*[col(c) for c in row_id], *[
        F.when(outside(col(c), lo, hi), col(c).cast("double")).alias(f"v{i}")
        for i, (c, (lo, hi)) in enumerate(limit.items())])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value"))
                      for i, c in enumerate(limit)])
    return (keep.select(*[col(c) for c in row_id], F.explode(cells).alias("r"))
                .select(*[col(c) for c in row_id], "r.*").where("value IS NOT NULL"))


def fit_outliers(df: DataFrame, plan: dict[str, str] | None = None, method: str = "iqr",
                 opts: Options = Options()) -> DataFrame:
    """Params ``(column, action, lower, upper, fill)`` for columns that have outliers.

    ``plan`` maps columns to clip, cap, winsorize, remove (to null) or fill_median;
    without it every such column is clipped.
    """
    found = detect_outliers(df, method, opts).collect()
    plan = {r["column"]: "clip" for r in found} if plan is None else plan
    rows = [r for r in found if r["column"] in plan]
    tails = [r["column"] for r in rows if plan[r["column"]] in ("cap", "winsorize")]
    mids = [r["column"] for r in rows if plan[r["column"]] == "fill_median"]
    edge = quantile_row(df, tails, (0.01, 0.99), opts)
    mid = quantile_row(df, mids, (0.5,), opts)
    out = []
    for r in rows:
        c = r["column"]
        lo, hi = edge.get(c, (r["lower"], r["upper"]))
        out.append((c, plan[c], lo, hi, mid[c][0] if c in mid else None))
    return df.sparkSession.createDataFrame(
        out, "column string, action string, lower double, upper double, fill double")


def apply_outliers(df: DataFrame, params: DataFrame) -> DataFrame:
    """Projection only; the fitted params (one row per column) become literals."""
    new = {}
    for r in params.collect():
        c = col(r["column"])
        if r["action"] == "remove":
            new[r["column"]] = F.when(~outside(c, r["lower"], r["upper"]), c)
        elif r["action"] == "fill_median":
            new[r["column"]] = F.when(outside(c, r["lower"], r["upper"]), F.lit(r["fill"])).otherwise(c)
        else:
            new[r["column"]] = clip(c, r["lower"], r["upper"])
    return df.withColumns(new) if new else df


def treat_outliers(df: DataFrame, columns: Sequence[str], opts: Options = Options()) -> tuple[DataFrame, list[str]]:
    """Cleaning step: clip, remove rows or flag, per options; returns the frame and a log.

    Columns with fewer than ten values are left alone. Removing rows changes the bounds
    of the columns after it, so that action refits column by column.
    """
    method, action = opts.outlier_method, opts.outlier_action
    if method == "none" or not columns:
        return df, []
    width = opts.iqr_factor if method == "iqr" else opts.zscore_threshold
    log: list[str] = []
    passes = [[c] for c in columns] if action == "remove" else [list(columns)]
    for group in passes:
        bounds = bounds_table(df, group, method, width, opts).where("n_values >= 10")
        for r in outlier_counts(df, bounds).where("n_outliers > 0").collect():
            name, lo, hi = r["column"], r["lower"], r["upper"]
            c = col(name)
            if action == "clip":
                df = df.withColumn(name, clip(c, lo, hi))
            elif action == "remove":
                df = df.where(~outside(c, lo, hi))
            elif action == "flag":
                df = df.withColumn(f"{name}_outlier", outside(c, lo, hi))
            log.append(f"outliers {action}: {name} ({r['n_outliers']:,})")
    return df, log
