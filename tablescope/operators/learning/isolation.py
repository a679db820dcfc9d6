"""Anomaly detection with an isolation forest.

Trees are grown from small row samples, one group of a few hundred rows per tree, and
come back as a few hundred nodes each; scoring is vectorised over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col, outside
from tablescope.functions.kinds import numeric_columns
from tablescope.operators.learning import rules
from tablescope.operators.learning.clusters import _coordinates, _scaled
from tablescope.operators.learning.common import (Analysis, complete_cases, failed, metrics_table,
                                                  spread)
from tablescope.options import Options
from tablescope.plans.quantiles import quantile_row
from tablescope.plans.runtime import copy_hash, number_copies, ship_package

EULER = 0.5772156649015329
NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def average_depth(n: float) -> float:
    """Expected depth of an unsuccessful search among n rows; the leaf correction."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def contamination(df: DataFrame, columns: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Mean share of 1.5-IQR outliers over all columns, between 0.01 and 0.3."""
    used = list(columns)
    share = F.lit(0.0)
    for c, (q1, q3) in quantile_row(df, used, (0.25, 0.75), opts).items():
        reach = 1.5 * (q3 - q1)
        share = share + F.avg(outside(col(c), q1 - reach, q3 + reach).cast("double"))
    return df.agg(F.greatest(F.lit(0.01), F.least(F.lit(0.3), share / len(used))).alias("contamination"))


def tree_samples(df: DataFrame, columns: Sequence[str], n: int, opts: Options = Options()) -> DataFrame:
    """``(tree, features...)``: for every tree at most ``isolation_rows`` rows.

    A pool of trees * rows is drawn by the hash of a row and its copy number (a filter, then a top-n). Pools that are
    smaller, because the table is, are reused by all trees with their own order.
    """
    trees, size = opts.isolation_trees, opts.isolation_rows
    pool_rows = trees * size
    hashed = df.select(*[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    hashed = number_copies(hashed)
    names = [f"f{i}" for i in range(len(columns))]
    hashed = hashed.withColumn("_h", copy_hash(hashed, names, opts.seed)).drop("_copy")
    if n > 4 * pool_rows:
        # Keep about twice the pool before the exact top-n.
        keep = int(2 ** 64 * (2.0 * pool_rows / n)) - 2 ** 63
        narrowed = hashed.where(F.col("_h") <= keep)
        hashed = narrowed if narrowed.count() >= pool_rows else hashed
    pool = hashed.orderBy("_h", *[f"f{i}" for i in range(len(columns))]).limit(pool_rows)
    if n >= pool_rows:
        return pool.withColumn("tree", F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(trees)).cast("int")).drop("_h")
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    chosen = F.xxhash64("_h", "tree")
    limit = int(2 ** 64 * min(1.0, 1.5 * size / n)) - 2 ** 63 - 1
    return spread.where(chosen <= limit).withColumn("_h", chosen)


def _grow(seed: int, size: int):
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        names = [c for c in group.columns if c.startswith("f")]
        if "_h" in group.columns:
            group = group.sort_values("_h")
        data = group[names].to_numpy()[:size]
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(data), 2))))
        nodes: list[list] = []
        # Fields of a node: feature (-1 is a leaf), threshold, left, right, depth.
        todo = [(np.arange(len(data)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            part = data[rows]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
            if depth >= limit or len(spread) == 0:
                nodes.append([-1, 0.0, -1, -1, depth + average_depth(len(rows))])
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            goes = part[:, f] <= cut
            nodes.append([f, float(cut), -1, -1, float(depth)])
            todo += [(rows[goes], depth + 1, me, 0), (rows[~goes], depth + 1, me, 1)]
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out
    return grow


def fit_forest(df: DataFrame, columns: Sequence[str], n: int, opts: Options = Options()) -> DataFrame:
    """Node table of the forest."""
    ship_package(df.sparkSession)
    grow = _grow(opts.seed, opts.isolation_rows)
    return tree_samples(df, columns, n, opts).groupBy("tree").applyInPandas(grow, NODES)


def score(df: DataFrame, columns: Sequence[str], nodes: DataFrame, sample: int,
          name: str = "score") -> DataFrame:
    """Add the anomaly score, between -1 and 0; lower is more anomalous.

    The forest has at most trees * 2 * rows nodes, so its arrays travel with the task.
    """
    ship_package(df.sparkSession)
    table = nodes.toPandas()
    forest = []
    for _, t in table.groupby("tree", sort=True):
        t = t.sort_values("node")
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth")))
    norm = average_depth(sample) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def depth_score(*values: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in values])
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, threshold, left, right, depth in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            moving = every[feature[at] >= 0]
            while len(moving):
                spot = at[moving]
                goes = x[moving, feature[spot]] <= threshold[spot]
                at[moving] = np.where(goes, left[spot], right[spot])
                moving = moving[feature[at[moving]] >= 0]
            total += depth[at]
        return pd.Series(-np.power(2.0, -total / (len(shared.value) * norm)))

    return df.withColumn(name, depth_score(*[col(c).cast("double") for c in columns]))


def flag_anomalies(df: DataFrame, columns: Sequence[str], rate: float, opts: Options = Options()) -> DataFrame:
    """Rows with ``score`` and ``is_anomaly``: scores under the ``rate`` quantile.

    Scores are persisted because the threshold and the flags both need them.
    """
    n = df.count()
    nodes = fit_forest(df, columns, n, opts)
    scored = score(spread(df, n), columns, nodes, min(n, opts.isolation_rows)).persist()
    cut = quantile_row(scored, ["score"], (rate,), opts)["score"][0]
    return scored.withColumn("is_anomaly", F.col("score") < F.lit(cut))


def anomaly(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (),
            opts: Options = Options()) -> Analysis:
    """Scores, flags, coordinates and profiles of anomalous and normal rows."""
    spark = df.sparkSession
    columns = list(columns)[:opts.max_features]
    if not columns:
        return failed("anomaly", "no numeric columns")
    data = complete_cases(df, [*columns, *key])
    n = data.count()
    if n < 20:
        return failed("anomaly", f"too few rows: {n}")
    rate = contamination(data, columns, opts).first()["contamination"]
    flagged = flag_anomalies(data, columns, rate, opts)
    hits = flagged.where("is_anomaly").count()
    name = "Isolation Forest"
    table = metrics_table(spark, {name: {"anomalies": hits, "anomaly_pct": hits / n * 100,
                                         "normal": n - hits, "contamination": rate}})
    coords = _coordinates(_scaled(flagged, columns), [*key, "score", "is_anomaly"])
    return Analysis("anomaly", model_name=name, feature_columns=tuple(columns), metrics=table,
                    predictions=flagged, recommendations=rules.anomaly(table, name),
                    tables={"coordinates": coords, "profile": anomaly_profile(flagged, columns),
                            "contrast": contrast(flagged, columns),
                            "anomalies": flagged.where("is_anomaly").orderBy("score", *key).limit(100)})


def anomaly_profile(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, std, min, max of up to eight columns over the anomalous rows."""
    from tablescope.plans.stats import numeric_summary

    return numeric_summary(flagged.where("is_anomaly"), list(columns)).drop("n")


def contrast(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of up to six columns, anomalous against normal rows."""
    return flagged.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"),
                                             *[F.avg(col(c)).alias(c) for c in list(columns)])


def column_anomalies(df: DataFrame, rate: float | None = None, opts: Options = Options(),
                     columns: Sequence[str] | None = None) -> DataFrame:
    """One forest per numeric column: ``(column, n_outliers, ratio)``."""
    rate = opts.contamination if rate is None else rate
    out = None
    for c in columns or numeric_columns(df):
        flagged = flag_anomalies(df.select(col(c)).dropna(), [c], rate, opts)
        part = flagged.agg(F.lit(c).alias("column"), F.count_if("is_anomaly").alias("n_outliers"),
                           F.avg(F.col("is_anomaly").cast("double")).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out
