"""Whole-table composites and streams."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.catalog.aggregates import _DIRTY_SCORE
from tablescope.catalog.base import R, fixture, query, rounded, scratch, table, union, with_fixture
from tablescope.catalog.learning import _E, _RULES
from tablescope.operators import clean, encode, missing, outliers, quality
from tablescope.operators.features import features
from tablescope.plans import roles as rl
from tablescope.plans.analyze import analyze, exploration, run_analysis
from tablescope.streaming import live


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n)``, one job per table; a table that failed is an error here."""
    if "_errors" in tables:
        raise RuntimeError(f"tables failed: {tables['_errors'].collect()}")
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query("C1_analyze", "select count(*) as n_rows, 6::bigint as raw_columns, 19::bigint as feature_columns, "
       "cast(0 as double) as missing_pct, count(*) - (select count(*) from (select distinct * from orders)) as n_duplicates from orders")
def c1(spark, d):
    report = analyze(spark, f"{d}/orders.parquet", order=["o_orderdate", "o_orderkey"], learn=False)
    return report.card.drop("quality_score")


@query("C2_clean", with_fixture("segment_gaps", "select c_custkey, coalesce(segment, (select segment from t where segment is not null "
       "group by 1 order by count(*) desc, segment limit 1)) as segment, "
       + R("coalesce(balance, (select quantile_cont(balance, 0.5) from t))", 4) + " as balance, "
       + R("cast(coalesce(nation, (select quantile_cont(nation, 0.5) from t)) as double)", 4) + " as nation from t"))
def c2(spark, d):
    df = fixture(spark, d, "segment_gaps")
    return rounded(clean.clean(df, rl.detect(df))[0], 4)


@query("C3_quality", with_fixture("dirty_lines", f"select count(*) as total_rows, cast(7 as int) as total_cols, {R(_DIRTY_SCORE)} as "
       "quality_score, count(*) - (select count(*) from (select distinct * from t)) as duplicate_rows, 'Time Series' as typology from t"))
def c3(spark, d):
    df = fixture(spark, d, "dirty_lines")
    return rounded(quality.quality(df, rl.detect(df)).summary.drop("reason"))


_V = "[p_partkey::double, p_size::double, p_retailprice]"


@query("C4_features", f"select p_partkey, {R(f'list_avg({_V})', 4)} as _row_mean, {R(f'list_stddev_samp({_V})', 4)} as _row_std, "
       f"{R(f'list_max({_V})', 4)} as _row_max, {R(f'list_min({_V})', 4)} as _row_min, "
       f"{R(f'list_max({_V}) - list_min({_V})', 4)} as _row_range from part")
def c4(spark, d):
    df = table(spark, d, "part")
    made, _ = features(df, rl.detect(df))
    return rounded(made.select("p_partkey", "_row_mean", "_row_std", "_row_max", "_row_min", "_row_range"), 4)


@query("C5_exploration")
def c5(spark, d):
    df = table(spark, d, "part")
    return counts(exploration(df, rl.detect(df)))


@query("C5_exploration_signals")
def c5_signals(spark, d):
    df = fixture(spark, d, "signal_pool")
    cleaned, roles, _ = clean.clean(df, rl.detect(df))
    return counts(exploration(cleaned, roles, order=["timestamp", "event_id"]))


def outcomes(spark, found) -> DataFrame:
    """One row per analysis and metric: (kind, success, error, model, metric, value); a failed analysis is one row with its reason."""
    schema = "kind string, success boolean, error string, model string, metric string, value double"
    rows = spark.createDataFrame([(f.kind, False, f.error, None, None, None) for f in found if not f.success], schema)
    for f in found:
        if f.success:
            rows = rows.unionByName(f.metrics.select(F.lit(f.kind).alias("kind"), F.lit(True).alias("success"), F.lit("").alias("error"),
                                                     "model", "metric", "value"))
    return rows


@query("C6_run_analysis")
def c6(spark, d):
    """Every kind of analysis on one table; those that do not fit it say why."""
    df = table(spark, d, "customer")
    roles = rl.detect(df)
    found = [run_analysis(df, roles, k, key=["c_custkey"] if k == "anomaly" else ()) for k in ("clustering", "association", "anomaly", "timeseries", "none")]
    return outcomes(spark, found)


_FACTS = {"itemsets": "(select count(*) from q)", "rules": "(select count(*) from found)", "max_lift": "(select max(lift) from found)",
          "max_confidence": "(select max(confidence) from found)", "min_support": "(select ms from k)", "columns": "4"}


# Line items with a column that goes with the quantity, so that there are rules.
_WEIGHED = "t as (select *, l_quantity * 2 + l_tax as weight from lineitem), " + _E.replace("from lineitem", "from t").replace("l_extendedprice", "weight")


@query("C6_run_analysis_association", f"with {_WEIGHED.format(limit='ms')}, found as ({_RULES}) " + union(
    [f"select 'association' as kind, true as success, '' as error, '{name}' as metric, " + R(f"{sql}::double", 8) + " as value" for name, sql in _FACTS.items()]))
def c6_association(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.expr("l_quantity * 2 + l_tax").alias("weight"))
    roles = replace(rl.detect(df), categorical=("l_returnflag", "l_linestatus"), numeric=("l_quantity", "weight"))
    return rounded(outcomes(spark, [run_analysis(df, roles, "association")]).drop("model"), 8)


@query("C7_fit_apply", with_fixture("segment_gaps", ", f as (select * from t where c_custkey % 2 = 0) "
       "select c_custkey, case when segment is null then null else cast((select count(distinct s.segment) from f s where "
       "s.segment < t.segment) as int) end as segment, "
       + R("coalesce(balance, (select avg(balance) from f))", 4) + " as balance from t where c_custkey % 2 = 1"))
def c7(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment", "balance")
    fit, rest = df.where("c_custkey % 2 = 0"), df.where("c_custkey % 2 = 1")
    fills = missing.fit_fills(fit, {"balance": "fill_mean"})
    codes = encode.fit_encoding(fit, {"segment": "label"})
    return rounded(encode.apply_encoding(missing.apply_fills(rest, fills), codes), 4)


@query("C7_outlier_fit_apply", with_fixture("lineitem_spike", ", f as (select quantile_cont(l_extendedprice, 0.25) q1, "
       "quantile_cont(l_extendedprice, 0.75) q3 from t where l_orderkey % 2 = 0) select l_orderkey, l_linenumber, "
       + R("least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))", 6)
       + " as l_extendedprice from t, f where l_orderkey % 2 = 1"))
def c7_outliers(spark, d):
    df = fixture(spark, d, "lineitem_spike").select("l_orderkey", "l_linenumber", "l_extendedprice")
    params = outliers.fit_outliers(df.where("l_orderkey % 2 = 0"), {"l_extendedprice": "clip"})
    return rounded(outliers.apply_outliers(df.where("l_orderkey % 2 = 1"), params), 6)


_HOUR = ("select event_type, date_trunc('hour', ts) as window_start, count(value) as n, " + R("avg(value)") + " as mean, "
         + R("stddev_samp(value)", 5) + " as std, min(value) as min, max(value) as max from events group by 1, 2")


def _naive(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("R1_window_stats", _HOUR)
def r1(spark, d):
    out = live.window_stats(table(spark, d, "events"), "event_type", "ts", "value")
    return rounded(_naive(out.drop("window_end")), std=5)


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("R1_window_stats_stream", f"select * from ({_HOUR}) where window_start + interval 1 hour <= "
       "(select max(ts) - interval 10 minute from events)")
def r1_stream(spark, d):
    folder = scratch(spark, "windows")
    stats = live.window_stats(_stream(spark, d), "event_type", "ts", "value")
    live.run_to_folder(stats, f"{folder}/data", f"{folder}/state").awaitTermination()
    return rounded(_naive(spark.read.parquet(f"{folder}/data").drop("window_end")), std=5)


@query("R1_sigma_alerts", f"select event_type, window_start from ({_HOUR.replace('hour', 'day')}) where max - mean > 2.5 * std or mean - min > 2.5 * std")
def r1_alerts(spark, d):
    out = live.sigma_alerts(live.window_stats(table(spark, d, "events"), "event_type", "ts", "value", "1 day"))
    return _naive(out.select("event_type", "window_start"))


_PAST = (f"h as ({_HOUR.replace(R('avg(value)'), 'avg(value)').replace(R('stddev_samp(value)', 5), 'stddev_samp(value)')}), "
         "e as (select event_type, date_trunc('hour', ts) as window_start, value from events), "
         "p as (select h.event_type, h.window_start, count(e.value) as past_n, avg(e.value) as past_mean, stddev_samp(e.value) as past_std, "
         "any_value(h.min) as low, any_value(h.max) as high from h left join e on e.event_type = h.event_type and e.window_start < h.window_start group by 1, 2), "
         "a as (select * from p where past_n >= 30 and (high - past_mean > 2.5 * past_std or past_mean - low > 2.5 * past_std))")
_ALERTS = f"select event_type, window_start, past_n, {R('past_mean', 5)} as past_mean, {R('past_std', 4)} as past_std from a"


def _alerts(found):
    return rounded(_naive(found.select("event_type", "window_start", "past_n", "past_mean", "past_std")), past_mean=5, past_std=4)


@query("R1_history_alerts", f"with {_PAST} {_ALERTS}")
def r1_history(spark, d):
    return _alerts(live.history_alerts(live.window_stats(table(spark, d, "events"), "event_type", "ts", "value"), "event_type"))


@query("R1_history_alerts_stream", f"with {_PAST} {_ALERTS} where window_start + interval 1 hour <= (select max(ts) - interval 10 minute from events)")
def r1_history_stream(spark, d):
    folder = scratch(spark, "alerts")
    stats = live.window_stats(_stream(spark, d), "event_type", "ts", "value")
    live.run_to_folder(stats, f"{folder}/stats", f"{folder}/stats_state").awaitTermination()
    closed = spark.readStream.schema(stats.schema).parquet(f"{folder}/stats")
    live.run_to_folder(live.history_alerts(closed, "event_type"), f"{folder}/data", f"{folder}/state").awaitTermination()
    return _alerts(spark.read.parquet(f"{folder}/data"))


_DAY = ("select user_id as key, cast(ts as date) as usage_date, count(*) as requests, least(count(*), 5) as allowed, "
        "greatest(5 - count(*), 0) as remaining from events group by 1, 2")


@query("R2_daily_quota", _DAY)
def r2(spark, d):
    return live.daily_quota(table(spark, d, "events"), "user_id", "ts")


@query("R2_daily_quota_stream", f"select * from ({_DAY}) where usage_date + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def r2_stream(spark, d):
    folder = scratch(spark, "quota")
    usage = live.daily_quota(_stream(spark, d), "user_id", "ts")
    live.run_to_folder(usage, f"{folder}/data", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/data")
