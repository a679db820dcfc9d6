"""One forecast per series: normal equations of all series in one grouped pass.

Lag, rolling and calendar features are made in blocks, so a series of any length is spread over tasks.
The sums of their products are an ordinary grouped aggregate, combined before the shuffle; what is
solved per series is one small matrix. All series are then forecast together, step by step, from a table of one row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.exprs import col
from tablescope.functions.kinds import kinds
from tablescope.operators.learning.common import Analysis, failed
from tablescope.operators.learning.forecast import _features_of, history
from tablescope.operators.windows import forecast_feature_names, forecast_features, group_index
from tablescope.options import Options
from tablescope.plans.runtime import lookup_join, materialize

#: Complete feature rows that a series needs.
LEAST_ROWS = 20
#: Directions in which the features vary less than this part of the largest are left out of the fit.
RANK_TOLERANCE = 1e-10


def _scaled(names: Sequence[str], value_of, mean: Column, scale: Column) -> list[Column]:
    """Features in units of their series; calendar parts around their middle."""
    out = []
    for n in names:
        x = value_of(n).cast("double")
        if n == "dayofweek":
            out.append((x - 3.0) / 2.0)
        elif n == "month":
            out.append((x - 6.5) / 3.5)
        else:
            out.append(x / scale if "std" in n else (x - mean) / scale)
    return out


def _solve(p: int):
    """Least squares of smallest norm for each row of (sums of products, row-wise upper triangle; intercept and target last)."""
    upper = np.triu_indices(p + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(upper[0]))
            full = np.zeros((len(sums), p + 2, p + 2))
            full[:, upper[0], upper[1]] = sums
            full[:, upper[1], upper[0]] = sums
            gram, right = full[:, : p + 1, : p + 1], full[:, : p + 1, p + 1]
            values, vectors = np.linalg.eigh(gram)
            keep = values > RANK_TOLERANCE * values[:, -1:]
            inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
            weights = np.einsum("sij,sj,skj,sk->si", vectors, inverse, vectors, right)
            columns = [batch.column(c) for c in batch.schema.names if c != "sums"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(weights), pa.list_(pa.float64()))],
                                             [*[c for c in batch.schema.names if c != "sums"], "weights"])

    return run


def series_models(features: DataFrame, target: str, by: Sequence[str], names: Sequence[str], opts: Options = Options()) -> DataFrame:
    """(by..., _n, _train, _mean, _scale, weights): one linear model per series, fitted on rows marked ``is_train``.

    ``features`` holds ``_n``, ``_mean``, ``_scale`` of the row's series.
    """
    z = [*_scaled(names, col, F.col("_mean"), F.col("_scale")), F.lit(1.0), (col(target).cast("double") - F.col("_mean")) / F.col("_scale")]
    ready = features.where("is_train").select(*[col(b) for b in by], "_n", "_mean", "_scale", *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    products = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(len(z)) for j in range(i, len(z))]
    sums = ready.groupBy(*[col(b) for b in by], "_n", "_mean", "_scale").agg(
        F.count(F.lit(1)).alias("_train"), *[s.alias(f"_s{i}") for i, s in enumerate(products)])
    packed = sums.select(*[col(b) for b in by], "_n", "_train", "_mean", "_scale", F.array(*[f"_s{i}" for i in range(len(products))]).alias("sums"))
    schema = packed.drop("sums").schema.add("weights", T.ArrayType(T.DoubleType()))
    return packed.mapInArrow(_solve(len(names)), schema)


def predicted(names: Sequence[str], value_of) -> Column:
    """The model's value for a row that carries ``_mean``, ``_scale`` and ``weights``."""
    z = _scaled(names, value_of, F.col("_mean"), F.col("_scale"))
    out = F.col("weights")[len(z)]
    for i, c in enumerate(z):
        out = out + F.col("weights")[i] * c
    return F.col("_mean") + F.col("_scale") * out


def forecast_each(df: DataFrame, ts: str, target: str, by: Sequence[str], order: Sequence[str] | None = None,
                  steps: int = 7, opts: Options = Options()) -> Analysis:
    """A linear lag model and a forecast for every series (``by``) of a table.

    ``metrics`` has one row per series: rows, train and test rows, r2, rmse, mae on its last fifth; ``predictions``
    the test rows; ``tables["future"]`` the next ``steps`` values; ``tables["skipped"]`` the series with too few rows.
    Rows without a time, a value or a series are left out. Rows of a series with one time go by the row (see ``total_order``).
    """
    by = list(by)
    if not by:
        return failed("forecast", "no series column")
    if ts is None or ts not in df.columns or kinds(df)[ts] != "datetime":
        return failed("forecast", "no timestamp column")
    if target is None or target not in df.columns:
        return failed("forecast", "no target column")
    order = [c for c in (order or [ts]) if c not in by]
    source = df.select(*[col(c) for c in dict.fromkeys([*by, ts, *order, target])]).dropna(subset=[*by, ts, target])
    names = forecast_feature_names(opts)
    features = materialize(group_index(forecast_features(source, ts, target, order, by, opts), by, order, "_i", opts))
    value = col(target).cast("double")
    per = features.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_scale"))
    per = per.withColumn("_scale", F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(F.lit(1.0)))
    rows = lookup_join(features, per.where(F.col("_n") >= LEAST_ROWS), by, "inner", opts)
    rows = rows.withColumn("is_train", F.col("_i") < F.floor(F.col("_n") * (1 - opts.test_fraction)))
    models = materialize(series_models(rows, target, by, names, opts))
    if not models.take(1):
        return failed("forecast", f"no series has {LEAST_ROWS} rows after lags")
    test = lookup_join(rows.where("NOT is_train").drop("_n", "_mean", "_scale"), models, by, "inner", opts)
    scored = test.select(*[col(b) for b in by], *[col(c) for c in order], "_n", "_train", value.alias("actual"), predicted(names, col).alias("predicted"))
    error = F.col("actual") - F.col("predicted")
    n = F.count(F.lit(1))
    metrics = scored.groupBy(*[col(b) for b in by]).agg(
        F.first("_n").alias("rows"), F.first("_train").alias("train_rows"), n.alias("test_rows"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("actual") * n)).alias("r2"), F.sqrt(F.sum(error * error) / n).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"))
    counted = source.groupBy(*[col(b) for b in by]).agg(n.alias("rows"))
    skipped = lookup_join(counted, models.select(*[col(b) for b in by]), by, "left_anti", opts)
    last = lookup_join(history(source, ts, target, order, by, opts), models, by, "inner", opts)
    return Analysis("forecast", model_name="Linear Regression per series", target=target, feature_columns=tuple(names), metrics=metrics,
                    predictions=scored.drop("_n", "_train"), tables={"future": future_of_each(last, by, steps, opts), "skipped": skipped, "models": models})


def future_of_each(last: DataFrame, by: Sequence[str], steps: int = 7, opts: Options = Options()) -> DataFrame:
    """(by..., step, at, prediction): every series advances by its own model and its own last time step."""
    names = forecast_feature_names(opts)
    state, out = last, None
    for step in range(1, steps + 1):
        state = state.withColumn("at", F.timestamp_micros(F.unix_micros("at") + F.col("gap")))
        made = _features_of(F.col("past"), F.col("at"), opts)
        # written as columns first: a step's features are read once by the model and once by the next step
        state = state.withColumns({f"_f_{n}": c for n, c in made.items()}).withColumn("prediction", predicted(names, lambda n: F.col(f"_f_{n}")))
        part = state.select(*[col(b) for b in by], F.lit(step).alias("step"), "at", "prediction")
        out = part if out is None else out.unionByName(part)
        state = state.select(*[col(b) for b in by], "at", "gap", "_mean", "_scale", "weights",
                             F.concat(F.slice("past", 2, 10_000), F.array("prediction")).alias("past"))
        if step % 4 == 0 and step < steps:
            state = materialize(state)
    return out
