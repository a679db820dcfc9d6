"""Clustering and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.operators.learning import rules
from tablescope.operators.learning.common import (Analysis, assemble, complete_cases, failed,
                                                  fill_medians, metrics_table, moments, spread, standardize)
from tablescope.options import Options
from tablescope.plans.gram import pair_correlations

Z = "__z"


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a standardised ``features`` vector; original columns are kept."""
    out = standardize(df, columns, Z)
    scaled = [f"{c}{Z}" for c in columns]
    return assemble(out, scaled).drop(*[col(c) for c in scaled])


def best_kmeans(data: DataFrame, k: int, restarts: int, max_iter: int, seed: int):
    """Lowest training cost over several starts."""
    models = [KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(data) for i in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def davies_bouldin(labelled: DataFrame, centers: list, features: str = "features",
                   label: str = "cluster") -> float:
    """Mean over clusters of the worst (scatter + scatter) / centre distance.

    Scatter is one aggregate; the comparison is on k centres.
    """
    arr = vector_to_array(features)
    lits = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    gap = F.zip_with(arr, F.element_at(lits, F.col(label) + 1), lambda a, b: (a - b) * (a - b))
    dist = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))
    scatter = {r[label]: r["s"] for r in labelled.groupBy(label).agg(F.avg(dist).alias("s")).collect()}
    ids = sorted(scatter)
    apart = lambda i, j: sum((float(a) - float(b)) ** 2 for a, b in zip(centers[i], centers[j])) ** 0.5
    worst = [max((scatter[i] + scatter[j]) / (apart(i, j) or float("inf")) for j in ids if j != i) for i in ids]
    return sum(worst) / len(worst)


def cluster_profile(labelled: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Cluster size and mean of up to eight columns."""
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.avg(col(c)).alias(c) for c in list(columns)])


def clustering(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (),
               opts: Options = Options()) -> Analysis:
    """K-means, k from 2 to 8 by the best silhouette (squared Euclidean closed form)."""
    spark = df.sparkSession
    columns = list(columns)[:opts.max_features]
    if len(columns) < 2:
        return failed("clustering", "fewer than two numeric columns")
    data = complete_cases(df, [*columns, *key])
    n = data.count()
    if n < 20:
        return failed("clustering", f"too few rows: {n}")
    data = spread(_scaled(data, columns), n).persist()
    judge = ClusteringEvaluator(predictionCol="prediction", featuresCol="features")
    fitted, curve = {}, []
    for k in range(2, min(9, n // 5 + 2)):
        fitted[k] = best_kmeans(data, k, opts.kmeans_restarts, 20, opts.seed)
        curve.append((k, float(fitted[k].summary.trainingCost),
                      float(judge.evaluate(fitted[k].transform(data)))))
    best_k, _, silhouette = max(curve, key=lambda r: r[2])
    model = fitted[best_k]
    labelled = model.transform(data).withColumnRenamed("prediction", "cluster")
    results = {f"K-Means (K={best_k})": {
        "k": best_k, "silhouette": silhouette, "rows": n,
        "davies_bouldin": davies_bouldin(labelled, model.clusterCenters())}}
    name = next(iter(results))
    table = metrics_table(spark, results)
    data.unpersist()  # what is returned is computed again from the same rows when it is read
    return Analysis("clustering", model_name=name, feature_columns=tuple(columns), metrics=table,
                    predictions=labelled.drop("features"),
                    recommendations=rules.clustering(table, name), model=model,
                    tables={"curve": spark.createDataFrame(curve, "k int, inertia double, silhouette double"),
                            "profile": cluster_profile(labelled, columns),
                            "coordinates": _coordinates(labelled, ["cluster", *key])})


def quick_clusters(df: DataFrame, columns: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Exploratory clusters: medians for gaps, k from 2 to 5 by the sharpest drop in inertia.

    Returns all rows with ``cluster`` and two principal coordinates.
    """
    columns = list(columns)[:opts.max_features]
    n = df.count()
    data = spread(_scaled(fill_medians(df, columns, opts), columns), n).persist()
    fitted = {k: best_kmeans(data, k, opts.kmeans_restarts, 100, opts.seed)
              for k in range(2, max(3, min(6, n // 10 + 2)))}
    cost = {k: m.summary.trainingCost for k, m in fitted.items()}
    drop = {k: cost[k] / cost[k - 1] for k in fitted if k > 2 and cost[k - 1] > 0}
    best_k = min(drop, key=drop.get) if drop else 2
    labelled = fitted[best_k].transform(data).withColumnRenamed("prediction", "cluster")
    return _coordinates(labelled, [*df.columns, "cluster"])


def _coordinates(scaled: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Two principal coordinates next to the kept columns; sign as in ``loadings``."""
    width = len(scaled.select("features").first()["features"])
    model = PCA(k=min(2, width), inputCol="features", outputCol="_pc").fit(scaled)
    signs = _signs(model)
    arr = vector_to_array("_pc")
    second = arr[1] * signs[1] if width > 1 else F.lit(0.0)
    return model.transform(scaled).select(*[col(c) for c in keep], (arr[0] * signs[0]).alias("pc1"),
                                          second.alias("pc2"))


def _signs(model) -> list[float]:
    """Turn every component so that its largest weight is positive."""
    m = model.pc.toArray()
    return [1.0 if m[abs(m[:, j]).argmax(), j] > 0 else -1.0 for j in range(m.shape[1])]


@dataclass(frozen=True)
class Components:
    """One decomposition of standardised columns: everything that the component tables and views need."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    shares: tuple[float, ...]                 # of all components, largest first
    weights: tuple[tuple[float, ...], ...]    # one row per column, one entry per component

    def as_params(self, spark) -> DataFrame:
        """A small table for ``save_params``; ``Components.from_params`` reads it back."""
        rows = [(i, c, self.means[i], self.scales[i], self.shares[i], list(self.weights[i])) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "place int, column string, mean double, scale double, share double, weights array<double>")

    @staticmethod
    def from_params(params: DataFrame) -> Components:
        rows = sorted(params.collect(), key=lambda r: r["place"])
        return Components(tuple(r["column"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["scale"] for r in rows),
                          tuple(r["share"] for r in rows), tuple(tuple(r["weights"]) for r in rows))

    def place(self, df: DataFrame, k: int = 2) -> DataFrame:
        """Add ``pc1`` ... ``pck``: plain arithmetic on the columns, no model pass."""
        z = [(col(c).cast("double") - m) / (s or 1.0) for c, m, s in zip(self.columns, self.means, self.scales)]
        out = {}
        for j in range(k):
            terms = [c * self.weights[i][j] for i, c in enumerate(z)] if j < len(self.columns) else []
            out[f"pc{j + 1}"] = reduce(add, terms) if terms else F.lit(0.0)
        return df.withColumns(out)


def decompose(df: DataFrame, columns: Sequence[str], opts: Options = Options(), fill: bool = True) -> Components:
    """Components of standardised columns from the matrix of correlations: two scans for any width.

    Gaps take the median (``fill``), or their rows are left out. Only the matrix, one entry per pair of columns, reaches
    the driver. The largest weight of a component is positive; of equal ones the first column's.
    """
    columns = list(columns)[:opts.max_features]
    data = df.select(*[col(c) for c in columns])
    data = fill_medians(data, columns, opts) if fill else data.dropna(subset=columns)
    fitted = moments(data, columns)
    r = np.zeros((len(columns), len(columns)))
    for x in pair_correlations(data, columns).where("r IS NOT NULL").collect():
        r[x["i"], x["j"]] = r[x["j"], x["i"]] = x["r"]
    values, vectors = np.linalg.eigh(r)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    top = np.abs(vectors).max(axis=0)
    lead = (np.abs(vectors) >= top - 1e-9).argmax(axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(len(columns))] < 0, -1.0, 1.0)
    total = values.sum() or 1.0
    return Components(tuple(columns), tuple(float(fitted[c][0] or 0.0) for c in columns), tuple(float(fitted[c][1]) for c in columns),
                      tuple((values / total).tolist()), tuple(tuple(row) for row in vectors.tolist()))


def explained_variance(df: DataFrame, columns: Sequence[str], components: int = 10,
                       opts: Options = Options(), fitted: Components | None = None) -> DataFrame:
    """``(component, explained_pct, cumulative_pct)`` of standardised columns."""
    fitted = fitted or decompose(df, columns, opts)
    rows, total = [], 0.0
    for i, share in enumerate(fitted.shares[:components], 1):
        total += share * 100
        rows.append((i, share * 100, total))
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_pct double, cumulative_pct double")


def loadings(df: DataFrame, columns: Sequence[str], components: int = 6,
             opts: Options = Options(), fitted: Components | None = None) -> DataFrame:
    """``(feature, component, loading, rank)``; the largest weight of a component is positive."""
    fitted = fitted or decompose(df, columns, opts)
    names, rows = fitted.columns, []
    for j in range(min(components, len(names))):
        order = sorted(range(len(names)), key=lambda i: -round(abs(fitted.weights[i][j]), 9))
        rows += [(names[i], j + 1, fitted.weights[i][j], rank) for rank, i in enumerate(order, 1)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, component int, loading double, rank int")


def principal_coordinates(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                          opts: Options = Options(), fitted: Components | None = None) -> DataFrame:
    """Two-dimensional view of complete rows."""
    columns = list(columns)[:opts.max_features]
    rows = complete_cases(df, [*columns, *keep])
    fitted = fitted or decompose(rows, columns, opts, fill=False)
    return fitted.place(rows).select(*[col(c) for c in keep], "pc1", "pc2")
