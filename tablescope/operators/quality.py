"""Quality checks: missing values, duplicates, outliers, types, ranges, profile, score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col, digest, is_number
from tablescope.functions.kinds import kinds, numeric_columns, text_columns
from tablescope.operators.outliers import bounds_table, outlier_counts
from tablescope.options import NON_NEGATIVE_HINTS, Options
from tablescope.plans.roles import Roles, typology
from tablescope.plans.runtime import materialize
from tablescope.plans.stats import distinct_counts, long_aggregate, missing_counts, numeric_summary

ISSUES = "category string, column string, severity string, count bigint, pct double, detail string"


def duplicate_counts(df: DataFrame) -> DataFrame:
    """``(n_rows, n_duplicates)``: rows beyond the first of each set of equal rows.

    Equal rows are combined before the shuffle and long text travels as a digest.
    """
    text = set(text_columns(df))
    nested = {n for n, k in kinds(df).items() if k == "nested"}
    keys = [digest(col(c)) if c in text
            else F.to_json(F.struct(col(c))) if c in nested and "map<" in dict(df.dtypes)[c]
            else col(c) for c in df.columns]
    groups = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    groups = groups.groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def number_as_text(df: DataFrame) -> DataFrame:
    """Text columns that are mostly, but not wholly, numbers: ``(column, numeric_ratio)``."""
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, numeric_ratio double")
    share = lambda c: F.avg(F.when(is_number(c), 1.0).otherwise(0.0))
    found = long_aggregate(df, texts, {"numeric_ratio": share})
    return found.where((F.col("numeric_ratio") > 0.8) & (F.col("numeric_ratio") < 1.0))


def negative_counts(df: DataFrame) -> DataFrame:
    """Negative values where none belong, judged by the column name: ``(column, n_negative)``."""
    watched = [c for c in numeric_columns(df) if any(h in c.lower() for h in NON_NEGATIVE_HINTS)]
    if not watched:
        return df.sparkSession.createDataFrame([], "column string, n_negative bigint")
    found = long_aggregate(df, watched, {"n_negative": lambda c: F.count_if(c < 0)})
    return found.where("n_negative > 0")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, missing %, distinct, moments and a value sample.

    The sample is the smallest and the largest value as text, so it does not depend on row order.
    """
    kind = kinds(df)
    types = dict(df.dtypes)
    base = missing_counts(df).join(distinct_counts(df), "column")
    numbers = [c for c, k in kind.items() if k in ("numeric", "boolean")]
    if numbers:
        plain = df.select(*[col(c).cast("int").alias(c) if kind[c] == "boolean" else col(c) for c in numbers])
        base = base.join(numeric_summary(plain, numbers).drop("n"), "column", "left")
    else:
        base = base.select("*", *[F.lit(None).cast("double").alias(m) for m in ("mean", "std", "min", "max")])
    least = long_aggregate(df.select(*[
        (F.to_json(F.struct(col(c))) if kind[c] == "nested" else col(c).cast("string")).alias(c)
        for c in df.columns]), df.columns, {"low": F.min, "high": F.max})
    sample = F.array_distinct(F.array_compact(F.array("low", "high")))
    type_of = F.element_at(F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])]), F.col("column"))
    return (base.join(least, "column")
                .select("column", type_of.alias("type"), (F.col("ratio") * 100).alias("missing_pct"),
                        "n_distinct", "mean", "std", "min", "max", sample.alias("sample")))


@dataclass(frozen=True)
class Quality:
    summary: DataFrame    # one row
    issues: DataFrame     # one row per finding
    profile: DataFrame    # one row per column


def severity(pct, high: float, medium: float):
    return F.when(pct > high, "high").when(pct > medium, "medium").otherwise("low")


def missing_issues(df: DataFrame) -> DataFrame:
    pct = F.col("ratio") * 100
    return missing_counts(df).where("n_missing > 0").select(
        F.lit("missing").alias("category"), "column", severity(pct, 50, 20).alias("severity"),
        F.col("n_missing").alias("count"), pct.alias("pct"), F.lit("missing values").alias("detail"))


def duplicate_issues(counts: DataFrame) -> DataFrame:
    pct = F.col("n_duplicates") / F.col("n_rows") * 100
    return counts.where("n_duplicates > 0").select(
        F.lit("duplicate").alias("category"), F.lit("*").alias("column"),
        F.when(pct < 5, "medium").otherwise("high").alias("severity"),
        F.col("n_duplicates").alias("count"), pct.alias("pct"), F.lit("repeated rows").alias("detail"))


def outlier_issues(df: DataFrame, opts: Options = Options()) -> DataFrame:
    return quality_outliers(df, opts).select(
        F.lit("outlier").alias("category"), "column",
        severity(F.col("pct"), 10, 3).alias("severity"), F.col("n_outliers").alias("count"), "pct",
        F.lit("outside the interquartile fences").alias("detail"))


def range_issues(df: DataFrame) -> DataFrame:
    return negative_counts(df).select(
        F.lit("range_error").alias("category"), "column", F.lit("medium").alias("severity"),
        F.col("n_negative").alias("count"), F.lit(None).cast("double").alias("pct"),
        F.lit("negative values").alias("detail"))


def quality_outliers(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """``(column, n_values, lower, upper, n_outliers, pct)`` by the IQR rule of the quality check.

    Columns with fewer than ten values or no spread are skipped.
    """
    bounds = bounds_table(df, numeric_columns(df), "iqr", 2.5, opts)
    usable = bounds.where((F.col("n_values") >= 10) & (F.col("iqr") != 0))
    return (outlier_counts(df, usable).where("n_outliers > 0")
            .select("column", "n_values", "lower", "upper", "n_outliers",
                    (F.col("n_outliers") / F.col("n_values") * 100).alias("pct")))


def issues(df: DataFrame, opts: Options = Options(), duplicates: DataFrame | None = None) -> DataFrame:
    """All findings as one table; ``duplicates`` are counts that are already known."""
    repeated = duplicate_counts(df) if duplicates is None else duplicates
    parts = [missing_issues(df), duplicate_issues(repeated), outlier_issues(df, opts), range_issues(df)]
    return reduce(DataFrame.unionByName, parts)


def _quality_score(found: DataFrame, type_errors: DataFrame) -> DataFrame:
    """0-100: points off per finding, weighted by its percentage."""
    weight = (F.when(F.col("category") == "missing", F.col("pct") * 0.2)
              .when(F.col("category") == "duplicate", F.col("pct") * 0.5)
              .when(F.col("category") == "outlier", F.col("pct") * 0.1)
              .otherwise(1.0))
    off = found.select(weight.alias("off")).unionByName(type_errors.select(F.lit(2.0).alias("off")))
    total = F.coalesce(F.sum("off"), F.lit(0.0))
    return off.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total)).alias("quality_score"))


def quality_score(df: DataFrame, opts: Options = Options()) -> DataFrame:
    return _quality_score(issues(df, opts), number_as_text(df))


def quality(df: DataFrame, roles: Roles | None = None, opts: Options = Options()) -> Quality:
    """Summary, issue and profile tables of one DataFrame."""
    # Written once: the score, the summary and the reader all use these small tables.
    duplicates = materialize(duplicate_counts(df))
    found = materialize(issues(df, opts, duplicates))
    label, reason = typology(df, roles)
    summary = (_quality_score(found, number_as_text(df)).crossJoin(F.broadcast(duplicates))
               .select(F.col("n_rows").alias("total_rows"), F.lit(len(df.columns)).alias("total_cols"),
                       "quality_score", F.col("n_duplicates").alias("duplicate_rows"),
                       F.lit(label).alias("typology"), F.lit(reason).alias("reason")))
    return Quality(materialize(summary), found, profile(df))


def overview_score(df: DataFrame, missing_weight: float = 0.5, duplicate_weight: float = 1.5) -> DataFrame:
    """``100 - w1 * mean missing % - w2 * duplicate %``, not below zero."""
    miss = missing_counts(df).agg((F.avg("ratio") * 100).alias("m"))
    dup = duplicate_counts(df).select((F.col("n_duplicates") / F.col("n_rows") * 100).alias("d"))
    score = F.greatest(F.lit(0.0), 100 - missing_weight * F.col("m") - duplicate_weight * F.col("d"))
    # Both sides are one row.
    return miss.crossJoin(F.broadcast(dup)).select(
        F.col("m").alias("missing_pct"), F.col("d").alias("duplicate_pct"), score.alias("score"))


def profile_score(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short profile: ``100 - 50 * missing - 20 * duplicate`` ratios, and columns over 30 % missing."""
    score = overview_score(df, 0.5, 0.2).select("score")
    return score, missing_counts(df).where("ratio > 0.3").select("column", "ratio")


def high_missing(df: DataFrame) -> DataFrame:
    """Columns over 50 % (``high``) or over 20 % (``mid``) missing."""
    band = F.when(F.col("ratio") > 0.5, "high").otherwise("mid")
    return missing_counts(df).where("ratio > 0.2").select("column", "ratio", band.alias("band"))


def markdown(result: Quality) -> str:
    """Text view of a quality result (a few hundred short rows at most)."""
    s = result.summary.first()
    lines = [f"**Quality score:** {s['quality_score']:.1f}/100",
             f"**Rows:** {s['total_rows']:,} | **Columns:** {s['total_cols']}",
             f"**Duplicate rows:** {s['duplicate_rows']:,}", f"**Typology:** {s['typology']}"]
    found = result.issues.collect()
    for title, category, top in (("Missing", "missing", 15), ("Outliers", "outlier", 10)):
        rows = sorted((r for r in found if r["category"] == category), key=lambda r: -r["pct"])[:top]
        lines += ["", f"### {title}"]
        lines += [f"- `{r['column']}`: {r['count']:,} ({r['pct']:.1f}%)" for r in rows] or ["- none"]
    return "\n".join(lines)
