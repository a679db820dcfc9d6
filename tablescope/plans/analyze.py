"""Whole-table composites: analyse a table, run one analysis."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tablescope.operators import clean as cleaning
from tablescope.operators import explore, quality
from tablescope.operators.features import features
from tablescope.operators.learning import association, clusters, forecast, isolation, series_forecast, supervised
from tablescope.operators.learning.common import Analysis, failed
from tablescope.operators.learning.rules import proposals
from tablescope.options import TARGET_NAMES_ANALYSIS, TARGET_NAMES_EDA, Options
from tablescope.plans.roles import Roles, detect, find_target, summary_rows
from tablescope.sources.tables import read_table, write_features

KINDS = ("regression", "classification", "clustering", "anomaly", "timeseries", "association")


@dataclass
class Report:
    """Everything one pass over a table gives; tables are lazy DataFrames."""

    raw: DataFrame
    cleaned: DataFrame
    roles: Roles
    quality: quality.Quality
    tables: dict[str, DataFrame]
    insights: DataFrame
    stats: DataFrame | None
    proposals: DataFrame
    card: DataFrame
    log: list[str] = field(default_factory=list)
    saved_to: str | None = None


def exploration(df: DataFrame, roles: Roles, opts: Options = Options(),
                order: Sequence[str] | None = None, learn: bool = True) -> dict[str, DataFrame]:
    """The exploration tables that apply to this shape; a table that cannot be built is left out."""
    numbers = [c for c in roles.numbers(opts) if c in df.columns]
    categories = [c for c in roles.categorical if c in df.columns]
    pool = roles.shape == "signal_pool"
    series = roles.shape in ("signal_pool", "time_series")
    value = roles.value_num if roles.value_num in df.columns else (numbers[0] if numbers else None)
    order = list(order or [c for c in (roles.timestamp, *roles.id) if c in df.columns])
    out: dict[str, DataFrame] = {}

    def add(name: str, applies, build: Callable[[], DataFrame | None]) -> None:
        if not applies:
            return
        try:
            table = build()
        except Exception as exc:  # one failing table must not lose the others
            out.setdefault("_errors", df.sparkSession.createDataFrame([], "name string, error string"))
            out["_errors"] = out["_errors"].unionByName(df.sparkSession.createDataFrame(
                [(name, str(exc)[:500])], "name string, error string"))
            return
        if table is not None:
            out[name] = table

    add("overview", True, lambda: quality.overview_score(df))
    add("missing", True, lambda: explore.effective_missing(df, roles) if pool else
        explore.missing_counts(df).where("n_missing > 0"))
    add("null_pattern", True, lambda: explore.null_pattern(df))
    if pool and value:
        add("histogram", True, lambda: explore.signal_histogram(df, roles.signal, value, 8, opts.histogram_bins))
        add("describe", True, lambda: explore.describe(df, [value], [roles.signal], opts))
    else:
        add("histogram", numbers, lambda: explore.histogram(df, numbers, opts.histogram_bins))
        add("density", numbers, lambda: explore.density(df, numbers, opts.kde_points, opts.histogram_bins))
        add("describe", numbers, lambda: explore.describe(df, numbers, (), opts))
    add("boxes", numbers, lambda: explore.box_stats(df, numbers, (), opts))
    add("correlation", len(numbers) >= 3, lambda: explore.correlations(df, numbers))
    add("categories", categories, lambda: explore.category_counts(df, categories, opts.top_categories))
    if pool and value and roles.timestamp in df.columns:
        add("time_series", True, lambda: explore.signal_series(
            df, roles.signal, roles.timestamp, value, order, 6, opts))
        add("timeline", roles.value_text in df.columns, lambda: explore.event_timeline(
            df, roles.timestamp, roles.signal, roles.value_text, order))
    elif series and value and roles.timestamp in df.columns:
        add("time_series", True, lambda: explore.whole_series(df, roles.timestamp, value, order, opts))
    target = find_target(df, roles, TARGET_NAMES_EDA, 5)
    add("target", target, lambda: explore.target_distribution(df, target))
    if learn:
        # one decomposition serves both tables
        fitted = cache(lambda: clusters.decompose(df, numbers, opts))
        add("explained_variance", len(numbers) >= 3, lambda: clusters.explained_variance(df, numbers, 10, opts, fitted()))
        add("loadings", len(numbers) >= 3, lambda: clusters.loadings(df, numbers, 6, opts, fitted()))
        add("importance", target, lambda: supervised.forest_importance(df, numbers, target, opts))
        add("clusters", roles.shape == "wide_table" and len(numbers) >= 2 and len(df.take(20)) == 20,
            lambda: clusters.quick_clusters(df, numbers, opts))
    return out


def analyze(spark: SparkSession, source: str | DataFrame, opts: Options = Options(),
            out_dir: str | None = None, name: str = "table", order: Sequence[str] | None = None,
            learn: bool = True, progress: Callable[[str], None] = lambda step: None) -> Report:
    """Load, detect, check, clean, drop duplicates, derive, explore, propose, save.

    The feature table is persisted once, because exploration and analyses all read it.
    """
    progress("load")
    raw = source if isinstance(source, DataFrame) else read_table(spark, source)
    progress("detect")
    raw = cleaning.strip_names(raw)
    roles = detect(raw, opts)
    progress("quality")
    checked = quality.quality(raw, roles, opts)
    progress("clean")
    df, roles, log = cleaning.clean(raw, roles, opts)
    df = cleaning.drop_duplicate_rows(df)
    progress("features")
    df, made = features(df, roles, opts, order)
    df = df.persist()
    progress("explore")
    tables = exploration(df, roles, opts, order, learn)
    tables["schema"] = summary_rows(spark, roles)
    base = [roles.value_num] if roles.value_num in df.columns else []
    stats_of = [c for c in dict.fromkeys([*base, *roles.numbers(opts)]) if c in df.columns]
    report = Report(
        raw=raw, cleaned=df, roles=roles, quality=checked, tables=tables,
        insights=explore.insights(df, roles, opts),
        stats=explore.basic_stats(df, stats_of) if stats_of else None,
        proposals=proposals(df, roles, opts),
        card=explore.summary_card(raw, len(df.columns), checked.summary), log=log + made)
    if out_dir:
        progress("save")
        report.saved_to = write_features(df, out_dir, name)
    return report


def run_analysis(df: DataFrame, roles: Roles, kind: str, target: str | None = None,
                 key: Sequence[str] = (), opts: Options = Options()) -> Analysis:
    """Dispatch one analysis; problems come back as a failed result, not an exception."""
    numbers = [c for c in roles.numbers(opts) if c in df.columns]
    categories = [c for c in roles.categorical if c in df.columns]
    try:
        if kind == "regression":
            return supervised.regression(df, numbers, target, key, opts)
        if kind == "classification":
            target = target or find_target(df, roles, TARGET_NAMES_ANALYSIS, 10, squeeze_blanks=False)
            return supervised.classification(df, numbers, target, key, opts)
        if kind == "clustering":
            return clusters.clustering(df, numbers, key, opts)
        if kind == "anomaly":
            return isolation.anomaly(df, numbers, key, opts)
        if kind in ("timeseries", "forecast"):
            ts = roles.timestamp
            if roles.shape == "signal_pool" and roles.signal in df.columns:
                return series_forecast.forecast_each(df, ts, target or (numbers[0] if numbers else None), [roles.signal],
                                                     [ts, *key] if ts else None, opts=opts)
            return forecast.forecast(df, ts, target or (numbers[0] if numbers else None),
                                     [ts, *key] if ts else None, opts=opts)
        if kind == "association":
            return association.association(df, categories, numbers, opts)
    except Exception as exc:
        return failed(kind, str(exc))
    return failed(kind, f"unknown analysis: {kind}")
