"""Missing values: advice, fitted fills, column and row drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.functions.kinds import kinds
from tablescope.operators.windows import fill_along
from tablescope.options import Options
from tablescope.plans.quantiles import quantile_row
from tablescope.plans.stats import long_aggregate, missing_counts, modes

FILLS = "column string, method string, value string"
WINDOW_FILLS = {"forward_fill": "forward", "backward_fill": "backward"}


def advise(df: DataFrame, drop_threshold: float = 0.7) -> DataFrame:
    """``(column, n_missing, ratio, action)`` for columns with missing values."""
    numeric = [c for c, k in kinds(df).items() if k in ("numeric", "boolean")]
    is_numeric = F.col("column").isin(numeric) if numeric else F.lit(False)
    action = (F.when(F.col("ratio") >= drop_threshold, "drop_column")
              .when(is_numeric & (F.col("ratio") < 0.05), "fill_mean")
              .when(is_numeric, "fill_median")
              .otherwise("fill_mode"))
    return (missing_counts(df).where("n_missing > 0")
            .select("column", "n_missing", "ratio", action.alias("action")))


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95,
                        protect: Sequence[str | None] = ()) -> tuple[DataFrame, list[str]]:
    """Drop columns missing in at least ``threshold`` of the rows, key columns excepted."""
    kept = {c for c in protect if c}
    sparse = missing_counts(df).where(F.col("ratio") >= threshold).collect()
    names = [r["column"] for r in sparse if r["column"] not in kept]
    return df.drop(*[col(c) for c in names]), names


def fit_fills(df: DataFrame, plan: dict[str, str] | None = None, opts: Options = Options(),
              drop_threshold: float = 0.7) -> DataFrame:
    """Fitted params ``(column, method, value)``, values as text; one row per planned column."""
    if plan is None:
        plan = {r["column"]: r["action"] for r in advise(df, drop_threshold).collect()}
    plan = {c: m for c, m in plan.items() if c in df.columns}
    kind = kinds(df)
    known = {"drop_column", "drop_row", "fill_mean", "fill_median", "fill_mode", "fill_zero",
             "fill_unknown", *WINDOW_FILLS}
    default = lambda c: "fill_median" if kind[c] in ("numeric", "boolean") else "fill_mode"
    plan = {c: m if m in known else default(c) for c, m in plan.items()}
    using = lambda m: [c for c, x in plan.items() if x == m]
    value: dict[str, object] = {c: 0 for c in using("fill_zero")} | {c: "Unknown" for c in using("fill_unknown")}
    if using("fill_mean"):
        means = long_aggregate(df, using("fill_mean"), {"v": lambda c: F.avg(c.cast("double"))})
        value |= {r["column"]: r["v"] for r in means.collect()}
    value |= {c: v[0] for c, v in quantile_row(df, using("fill_median"), (0.5,), opts).items()}
    if using("fill_mode"):
        value |= {r["column"]: r["value"] for r in modes(df, using("fill_mode")).collect()}
    rows = [(c, m, None if value.get(c) is None else str(value[c])) for c, m in plan.items()]
    return df.sparkSession.createDataFrame(rows, FILLS)


def apply_fills(df: DataFrame, params: DataFrame, order: Sequence[str] | None = None,
                by: Sequence[str] = (), opts: Options = Options()) -> DataFrame:
    """Apply fitted params. Constant fills are one projection; ordered fills need ``order``."""
    plan = [r for r in params.collect() if r["column"] in df.columns]
    drop = [r["column"] for r in plan if r["method"] == "drop_column"]
    df = df.drop(*[col(c) for c in drop])
    rows = [r["column"] for r in plan if r["method"] == "drop_row"]
    if rows:
        df = df.dropna(subset=rows)
    kind, types = kinds(df), {f.name: f.dataType for f in df.schema}
    new = {}
    for r in plan:
        c = r["column"]
        if c in drop or r["value"] is None:
            continue
        # A fractional fill widens an integer column instead of truncating the value.
        fractional = kind[c] == "numeric" and "." in r["value"]
        target = "double" if fractional else types[c]
        new[c] = F.coalesce(col(c).cast(target), F.lit(r["value"]).cast(target))
    if new:
        df = df.withColumns(new)
    for method, direction in WINDOW_FILLS.items():
        names = [r["column"] for r in plan if r["method"] == method]
        if names:
            if not order:
                raise ValueError(f"{method} needs order columns")
            df = fill_along(df, names, order, by, direction, opts)
    return df


def handle_missing(df: DataFrame, plan: dict[str, str] | None = None, params: DataFrame | None = None,
                   order: Sequence[str] | None = None, by: Sequence[str] = (),
                   opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Fit (unless ``params`` are given) and apply; returns the frame and the params."""
    params = fit_fills(df, plan, opts) if params is None else params
    return apply_fills(df, params, order, by, opts), params
