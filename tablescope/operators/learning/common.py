"""Shared parts of the analyses: splits, scaling, metrics, results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col, row_hash
from tablescope.options import Options
from tablescope.plans.quantiles import quantile_row, quantiles
from tablescope.plans.runtime import copy_hash, lookup_join, number_copies
from tablescope.plans.stats import long_aggregate


SMALL_ROWS = 5_000_000
#: Rows from which a fit of trees takes at least TREE_PARTS tasks, as its work per row is large.
MANY_ROWS, TREE_PARTS = 1_000_000, 12
#: Rows of one task of an iterative fit on a larger table. Each task of a forest writes statistics of all open
#: nodes of all trees at every level, so their bytes follow the number of tasks.
ROWS_PER_PART = 1_500_000


@dataclass(frozen=True)
class Analysis:
    """Outcome of one analysis; tables are DataFrames, names are plain text."""

    kind: str
    success: bool = True
    error: str = ""
    model_name: str = ""
    target: str | None = None
    feature_columns: tuple[str, ...] = ()
    metrics: DataFrame | None = None          # (model, metric, value)
    importances: DataFrame | None = None      # (feature, importance)
    predictions: DataFrame | None = None
    recommendations: DataFrame | None = None  # (rule, message)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: object | None = None


def failed(kind: str, error: str) -> Analysis:
    return Analysis(kind, success=False, error=error)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns, rows without gaps only."""
    columns = list(dict.fromkeys(columns))
    return df.select(*[col(c) for c in columns]).dropna(subset=columns)


def count_and_order(df: DataFrame, columns: Sequence[str]) -> tuple[int, list[int]]:
    """Number of rows, and the positions of the columns from the one with the fewest values on."""
    found = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(col(c)) for c in columns]).first()
    return found[0], sorted(range(len(columns)), key=lambda i: found[i + 1])


def spread(df: DataFrame, rows: int, order: Sequence[int] | None = None) -> DataFrame:
    """Rows dealt to tasks by their own hash, in hash order, for iterative fits.

    The number of parts follows from the rows alone. So random starts, sums and fitted models are the same
    whatever the number of cores, files or earlier shuffles.

    ``order`` is for fits of trees, with the positions of the ``features`` from the one with the fewest values
    on. Where little but a label stands beside them, a few classes have a few hashes and a few tasks would get
    all rows, so the features are dealt by too. In a task, rows with like features follow each other: they take
    the same way down every tree and add to the same statistics.
    """
    parts = max(1, min(rows // 5_000, 8)) if rows <= SMALL_ROWS else -(-rows // ROWS_PER_PART)
    if order is not None and rows > MANY_ROWS:
        parts = max(parts, TREE_PARTS)
    plain = [f.name for f in df.schema if not isinstance(f.dataType, VectorUDT)]
    draw = row_hash(df.select(*[col(c) for c in plain]), 17)
    if order is None or parts == 1:
        return df.withColumn("_draw", draw).repartition(parts, "_draw").sortWithinPartitions("_draw").drop("_draw")
    dealt = df.withColumn("_draw", F.xxhash64(draw, vector_to_array("features"))).repartition(parts, "_draw")
    # a column of its own, or each comparison of the sort would turn vectors into arrays again
    dealt = dealt.withColumn("_values", vector_to_array("features"))
    return dealt.sortWithinPartitions(*[F.col("_values")[i] for i in order], "_draw").drop("_draw", "_values")


def doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: col(c).cast("double") for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(doubles(df, columns))


# --------------------------------------------------------------------- splits
def split_key(key: Sequence[str], seed: int):
    """52-bit row key for splits, portable (MD5), from key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def mark_split(df: DataFrame, test_fraction: float = 0.2, stratify: str | None = None,
               key: Sequence[str] | None = None, seed: int = 42, opts: Options = Options()) -> DataFrame:
    """Add ``is_train``: rows at or under the train quantile of their key, per class if stratified.

    The quantile is an aggregate per class, so a class with a third of the rows is never
    sorted in one task, and the split is the same on every run.
    """
    if key:
        keyed = df.withColumn("_key", split_key(key, seed))
    else:
        # every copy of a repeated row is drawn on its own
        numbered = number_copies(df)
        keyed = numbered.withColumn("_key", F.pmod(copy_hash(numbered, df.columns, seed), F.lit(2 ** 52)).cast("double")).drop("_copy")
    share = 1.0 - test_fraction
    if stratify is None:
        cut = quantile_row(keyed, ["_key"], (share,), opts)["_key"][0]
        return keyed.withColumn("is_train", F.col("_key") <= F.lit(cut)).drop("_key")
    cuts = quantiles(keyed, ["_key"], (share,), [stratify], opts).select(
        col(stratify), F.col("value").alias("_cut"))
    joined = lookup_join(keyed, cuts, [stratify], "inner", opts)
    return joined.withColumn("is_train", F.col("_key") <= F.col("_cut")).drop("_key", "_cut")


# --------------------------------------------------------------------- scaling
def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    found = long_aggregate(df, columns, {"m": lambda c: F.avg(c.cast("double")),
                                         "s": lambda c: F.stddev_pop(c.cast("double"))})
    return {r["column"]: (r["m"], r["s"] or 0.0) for r in found.collect()}


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Zero mean, unit population variance; constant columns become zero."""
    fitted = moments(df, columns)
    return df.withColumns({
        f"{c}{suffix}": (col(c).cast("double") - F.lit(m)) / F.lit(s if s > 0 else 1.0)
        for c, (m, s) in fitted.items()})


def fill_medians(df: DataFrame, columns: Sequence[str], opts: Options = Options()) -> DataFrame:
    mid = quantile_row(df, columns, (0.5,), opts)
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(mid[c][0])) for c in columns})


# --------------------------------------------------------------------- metrics
def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(r2, rmse, mae)`` in one pass over the predictions."""
    err = F.col(label) - F.col(prediction)
    n = F.count(F.lit(1))
    rest = F.sum(err * err)
    total = F.var_pop(label) * n
    return scored.agg((1 - F.try_divide(rest, total)).alias("r2"), F.sqrt(rest / n).alias("rmse"),
                      F.avg(F.abs(err)).alias("mae"))


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``."""
    return scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(matrix: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, support, precision, recall, f1)`` from a confusion table; 0 when undefined."""
    actual = matrix.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"))
    guessed = matrix.groupBy(F.col(prediction).alias("class")).agg(F.sum("n").alias("guessed"))
    hit = matrix.where(F.col(label) == F.col(prediction)).groupBy(F.col(label).alias("class")) \
                .agg(F.sum("n").alias("hits"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = actual.join(guessed, "class", "full").join(hit, "class", "left")
    precision, recall = part(zero("hits"), zero("guessed")), part(zero("hits"), zero("support"))
    return joined.select("class", zero("support").alias("support"), precision.alias("precision"),
                         recall.alias("recall"),
                         part(2 * precision * recall, precision + recall).alias("f1"))


def accuracy_and_f1(matrix: DataFrame, classes: int) -> tuple[float, float]:
    """Accuracy and F1: of class 1 for two classes, support-weighted otherwise."""
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    acc = matrix.agg((hits / F.sum("n")).alias("a")).first()["a"]
    per = class_metrics(matrix)
    if classes == 2:
        row = per.where(F.col("class") == 1).first()
        return acc, (row["f1"] if row else 0.0)
    return acc, per.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f")).first()["f"]


def metrics_table(spark, results: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(m, k, float(v)) for m, vals in results.items() for k, v in vals.items() if v is not None]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def importance_table(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    """``(feature, importance)``; one row per input column."""
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)],
                                 "feature string, importance double")


def model_importances(model, names: Sequence[str]) -> list[float]:
    """Tree importances, or absolute coefficients (first row for several classes)."""
    if hasattr(model, "featureImportances"):
        return list(model.featureImportances.toArray())
    if hasattr(model, "models"):
        stacked = [m.featureImportances.toArray() for m in model.models]
        return list(sum(stacked) / len(stacked))
    if getattr(model, "numClasses", None):
        matrix = model.coefficientMatrix.toArray()
        return [abs(float(x)) for x in matrix[0]]
    return [abs(float(x)) for x in model.coefficients]


def top_importances(table: DataFrame, k: int = 15) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)
