"""Categorical encoding: label codes and one-hot columns, fitted once and reused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.operators.windows import group_index
from tablescope.options import Options
from tablescope.plans.roles import detect_categorical
from tablescope.plans.runtime import lookup_join
from tablescope.plans.stats import distinct_counts, value_counts

PARAMS = "column string, method string, category string, code int"


def suggest(n_distinct: int, threshold: int = 10) -> str:
    """Two values: label; up to the threshold: one-hot; beyond: label."""
    return "onehot" if n_distinct != 2 and n_distinct <= threshold else "label"


def advise_encoding(df: DataFrame, columns: Sequence[str] | None = None, threshold: int = 10) -> DataFrame:
    """``(column, n_distinct, method)``."""
    columns = list(columns or detect_categorical(df, threshold))
    n = F.col("n_distinct")
    method = F.when((n != 2) & (n <= threshold), "onehot").otherwise("label")
    return distinct_counts(df, columns).select("column", "n_distinct", method.alias("method"))


def encoding_plan(df: DataFrame, plan=None, threshold: int = 10) -> dict[str, str]:
    """Normalise a plan: nothing, one method for all, a list of columns, or a mapping."""
    if isinstance(plan, dict):
        return {c: m for c, m in plan.items() if c in df.columns}
    if isinstance(plan, str):
        return {c: plan for c in detect_categorical(df, threshold)}
    columns = [c for c in plan if c in df.columns] if isinstance(plan, (list, tuple)) \
        else detect_categorical(df, threshold)
    if not columns:
        return {}
    found = {r["column"]: r["method"] for r in advise_encoding(df, columns, threshold).collect()}
    return {c: found[c] for c in columns}


def fit_encoding(df: DataFrame, plan=None, opts: Options = Options()) -> DataFrame:
    """Params ``(column, method, category, code)``; codes follow the byte order of the text.

    Codes are positions in a distributed sort, so a column may have any number of
    categories.
    """
    plan = encoding_plan(df, plan, opts.categorical_threshold)
    if not plan:
        return df.sparkSession.createDataFrame([], PARAMS)
    categories = value_counts(df, list(plan)).select("column", F.col("value").alias("category"))
    coded = group_index(categories, ["column"], ["category"], "code", opts)
    method = F.element_at(F.create_map(*[F.lit(x) for c, m in plan.items() for x in (c, m)]), F.col("column"))
    return coded.select("column", method.alias("method"), "category", "code")


def apply_encoding(df: DataFrame, params: DataFrame, unseen: int | None = None,
                   opts: Options = Options()) -> DataFrame:
    """Label columns are replaced by their code, one-hot columns by 0/1 columns at the end.

    Nulls stay null (label) or all-zero (one-hot). ``unseen`` is the code of categories
    that were not fitted; pass 0 for the first class.
    """
    methods = {r["column"]: (r["method"], r["n"]) for r in
               params.groupBy("column", "method").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = [c for c in df.columns if methods.get(c, ("",))[0] == "onehot"]
    wide = [c for c in hot if methods[c][1] > opts.onehot_limit]
    if wide:
        raise ValueError(f"more than {opts.onehot_limit} one-hot columns for {wide}; use label encoding")
    original = df.columns
    for c in [c for c in original if methods.get(c, ("",))[0] == "label"]:
        table = (params.where((F.col("column") == c) & (F.col("method") == "label"))
                 .select(F.col("category").alias("_text"), F.col("code").alias("_code")))
        joined = lookup_join(df.withColumn("_text", col(c).cast("string")), table, ["_text"], "left", opts)
        code = F.col("_code") if unseen is None else \
            F.when(F.col("_text").isNotNull(), F.coalesce("_code", F.lit(unseen)))
        df = joined.withColumn(c, code).drop("_text", "_code")
    if hot:
        fitted = params.where(F.col("column").isin(hot)).orderBy("column", "code").collect()
        dummies = {f"{r['column']}_{r['category']}":
                   F.coalesce((col(r["column"]).cast("string") == r["category"]).cast("int"), F.lit(0))
                   for c in hot for r in fitted if r["column"] == c}
        rest = [col(c) for c in original if c not in hot]
        df = df.select(*rest, *[e.alias(n) for n, e in dummies.items()])
    else:
        df = df.select(*[col(c) for c in original])
    return df


def encode(df: DataFrame, plan=None, params: DataFrame | None = None, unseen: int | None = None,
           opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Fit (unless ``params`` are given) and apply; returns the frame and the params."""
    params = fit_encoding(df, plan, opts) if params is None else params
    return apply_encoding(df, params, unseen, opts), params


def decode_labels(df: DataFrame, params: DataFrame, column: str, opts: Options = Options()) -> DataFrame:
    """Codes of a label-encoded column back to text; one-hot columns cannot be restored."""
    table = (params.where((F.col("column") == column) & (F.col("method") == "label"))
             .select(F.col("code").alias("_code"), F.col("category").alias("_text")))
    order = df.columns
    joined = lookup_join(df.withColumn("_code", col(column).cast("int")), table, ["_code"], "left", opts)
    return joined.withColumn(column, F.col("_text")).select(*[col(c) for c in order])
