"""Time-series forecast with lag features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.functions.kinds import kinds
from tablescope.operators.learning import rules
from tablescope.operators.learning.common import (Analysis, assemble, failed, importance_table,
                                                  metrics_table, model_importances, regression_metrics,
                                                  spread)
from tablescope.operators.windows import chronological_split, forecast_feature_names, forecast_features, total_order
from tablescope.options import Options
from tablescope.plans.runtime import materialize


def forecast(df: DataFrame, ts: str | None, target: str | None, order: Sequence[str] | None = None,
             steps: int = 7, compat: bool = False, opts: Options = Options()) -> Analysis:
    """Linear against boosted trees on the last fifth of the series; best by RMSE."""
    spark = df.sparkSession
    if ts is None or ts not in df.columns or kinds(df)[ts] != "datetime":
        return failed("forecast", "no timestamp column")
    if target is None or target not in df.columns:
        return failed("forecast", "no target column")
    order = list(order or [ts])
    source = df.select(*[col(c) for c in dict.fromkeys([ts, target, *order])]).dropna(subset=[ts, target])
    n = source.count()
    if n < 30:
        return failed("forecast", f"too few rows: {n}")
    names = forecast_feature_names(opts)
    # The features are read by every fit; written once, they also cut the window lineage.
    table = materialize(forecast_features(source, ts, target, order, (), opts))
    if table.count() < 20:
        return failed("forecast", "too few rows after lags")
    data = chronological_split(table, order, 1 - opts.test_fraction, opts)
    data = assemble(data, names).withColumn("label", col(target).cast("double"))
    data = spread(data, n).persist()
    train, test = data.where("is_train"), data.where("NOT is_train")
    learners = {"Linear Regression": LinearRegression(),
                "Gradient Boosting": GBTRegressor(maxIter=opts.boosting_rounds, maxDepth=3, stepSize=0.1,
                                                  seed=opts.seed)}
    results, fitted = {}, {}
    for name, learner in learners.items():
        fitted[name] = learner.fit(train.select("features", "label"))
        results[name] = regression_metrics(fitted[name].transform(test)).first().asDict()
    best = min(results, key=lambda m: results[m]["rmse"])
    scored = fitted[best].transform(test).select(*[col(c) for c in order], F.col("label").alias("actual"),
                                                 F.col("prediction").alias("predicted"))
    weights = importance_table(spark, names, model_importances(fitted[best], names))
    metrics = metrics_table(spark, results)
    if compat:
        last = table.orderBy(*[col(c).desc() for c in order]).limit(1)
        future = frozen_steps(fitted[best], last, names, steps)
    else:
        future = future_steps(fitted[best], history(source, ts, target, order, (), opts), steps, opts)
    return Analysis("forecast", model_name=best, target=target, feature_columns=tuple(names),
                    metrics=metrics, importances=weights, predictions=scored, tables={"future": future},
                    recommendations=rules.forecast(metrics, best, weights), model=fitted[best])


def history(df: DataFrame, ts: str, target: str, order: Sequence[str], by: Sequence[str] = (),
            opts: Options = Options()) -> DataFrame:
    """One row per series: the last values (oldest first), last time and last time step."""
    depth = max(*opts.forecast_lags, *opts.forecast_windows)
    # the reverse of the order that the features were made in, ties included
    w = Window.partitionBy(*[col(b) for b in by] or [F.lit(0)]).orderBy(*[k.desc() for k in total_order(df, [*by, *order])[len(by):]])
    # The constant row-number filter is cut down per task before the shuffle.
    recent = df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= depth)
    entries = F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("p"), col(target).cast("double").alias("v"),
                                                   col(ts).cast("timestamp").alias("t"))))
    rows = recent.groupBy(*[col(b) for b in by]).agg(entries.alias("e")).where(F.size("e") == depth)
    return rows.select(*[col(b) for b in by], F.transform("e", lambda x: x["v"]).alias("past"),
                       F.element_at("e", -1)["t"].alias("at"),
                       (F.unix_micros(F.element_at("e", -1)["t"]) - F.unix_micros(F.element_at("e", -2)["t"])).alias("gap"))


def _features_of(past, at, opts: Options) -> dict:
    out = {f"lag_{k}": F.element_at(past, -k) for k in opts.forecast_lags}
    for w in opts.forecast_windows:
        window = F.slice(past, -w, w)
        mean = F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / w
        square = F.aggregate(window, F.lit(0.0), lambda a, x: a + x * x)
        out[f"roll_mean_{w}"] = mean
        out[f"roll_std_{w}"] = F.sqrt(F.greatest((square - w * mean * mean) / (w - 1), F.lit(0.0)))
    out["dayofweek"] = F.weekday(at)
    out["month"] = F.month(at)
    return out


def future_steps(model, last: DataFrame, steps: int = 7, opts: Options = Options()) -> DataFrame:
    """Recursive forecast ``(by..., step, at, prediction)`` with lags taken from real history.

    All series advance together: one ``transform`` per step over a table of one row each.
    """
    names = forecast_feature_names(opts)
    by = [c for c in last.columns if c not in ("past", "at", "gap")]
    state, out = last, None
    for step in range(1, steps + 1):
        state = state.withColumn("at", F.timestamp_micros(F.unix_micros("at") + F.col("gap")))
        ready = assemble(state.withColumns(_features_of(F.col("past"), F.col("at"), opts)), names)
        scored = model.transform(ready)
        part = scored.select(*[col(b) for b in by], F.lit(step).alias("step"), "at", "prediction")
        out = part if out is None else out.unionByName(part)
        state = scored.select(*[col(b) for b in by], "at", "gap", F.concat(
            F.slice("past", 2, 10_000), F.array("prediction")).alias("past"))
    return out


def frozen_steps(model, last: DataFrame, names: Sequence[str], steps: int = 7) -> DataFrame:
    """Compatibility form: only lags move (each takes the next shorter one), the rest stays.

    Step one predicts the last known row again.
    """
    lags = sorted((n for n in names if n.startswith("lag_")), key=lambda n: int(n[4:]))
    state, out = last.select(*[col(n).cast("double").alias(n) for n in names]), None
    for step in range(1, steps + 1):
        scored = model.transform(assemble(state, names))
        part = scored.select(F.lit(step).alias("step"), "prediction")
        out = part if out is None else out.unionByName(part)
        moved = {long: col(short) for short, long in zip(lags, lags[1:])}
        state = scored.select(*[(F.col("prediction") if n == lags[0] else moved.get(n, col(n))).alias(n)
                                for n in names])
    return out
