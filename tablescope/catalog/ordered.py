"""Window functions, sorts, top-k and plot tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from tablescope.catalog.aggregates import box_frame, box_sql, histogram_sql
from tablescope.catalog.base import R, fixture, num, query, rounded, table, union, with_fixture
from tablescope.operators import clean, explore, windows
from tablescope.options import Options

ORDER = ["ts", "event_id"]
BLOCKS = replace(Options(), block_rows=1000)   # forces many blocks at test size


def lag_sql(by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    lags = ", ".join(f"lag(value, {k}) over w as value_lag{k}" for k in (1, 2, 3, 7))
    frame = f"over ({part}order by ts, event_id rows between 6 preceding and current row)"
    return (f"select event_id, {lags}, {R(f'avg(value) {frame}')} as value_roll_mean_7, "
            f"{R(f'stddev_samp(value) {frame}', 5)} as value_roll_std_7 from events window w as ({part}order by ts, event_id)")


def lagged(spark, d, by, opts):
    out = windows.lag_features(table(spark, d, "events"), "value", ORDER, by, opts)
    return rounded(out.drop("ts", "user_id", "event_type", "value", "props"), value_roll_std_7=5)


@query("W1_lags_by_signal", lag_sql("event_type"))
def w1(spark, d):
    return lagged(spark, d, ["event_type"], Options())


@query("W1_lags_by_signal_blocks", lag_sql("event_type"))
def w1_blocks(spark, d):
    return lagged(spark, d, ["event_type"], BLOCKS)


@query("W2_lags_whole_table_blocks", lag_sql())
def w2(spark, d):
    return lagged(spark, d, [], BLOCKS)


_FW = "order by o_orderdate rows between {w} preceding and 1 preceding"
_FORECAST = with_fixture("daily_sales", ", f as (select o_orderdate, sales, " + ", ".join(
    [f"lag(sales, {k}) over (order by o_orderdate) as lag_{k}" for k in (1, 2, 3, 7, 14)]
    + [f"case when count(sales) over ({_FW.format(w=w)}) = {w} then avg(sales) over ({_FW.format(w=w)}) end as roll_mean_{w}, "
       f"case when count(sales) over ({_FW.format(w=w)}) = {w} then stddev_samp(sales) over ({_FW.format(w=w)}) end as roll_std_{w}"
       for w in (7, 14)])
    + ", cast(isodow(o_orderdate) - 1 as int) as dayofweek, cast(month(o_orderdate) as int) as month from t) "
      "select o_orderdate, sales, " + ", ".join(f"lag_{k}" for k in (1, 2, 3, 7, 14)) + ", " + ", ".join(
          f"{R(f'roll_mean_{w}', 3)} as roll_mean_{w}, {R(f'roll_std_{w}', 3)} as roll_std_{w}" for w in (7, 14))
    + ", dayofweek, month from f where lag_14 is not null and roll_std_14 is not null")


@query("W3_forecast_features", _FORECAST)
def w3(spark, d):
    return rounded(windows.forecast_features(fixture(spark, d, "daily_sales"), "o_orderdate", "sales"), 3)


@query("W3_forecast_features_blocks", _FORECAST)
def w3_blocks(spark, d):
    return rounded(windows.forecast_features(fixture(spark, d, "daily_sales"), "o_orderdate", "sales",
                                             opts=replace(Options(), block_rows=200)), 3)


@query("W4_moving_average", "select event_id, case when count(value) over w = 100 then " + R("avg(value) over w")
       + " end as moving_avg from events window w as (order by ts, event_id rows between 99 preceding and current row)")
def w4(spark, d):
    out = explore.whole_series(table(spark, d, "events"), "ts", "value", ORDER, BLOCKS)
    return rounded(out.select("event_id", "moving_avg"))


def fill_sql(by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return with_fixture("events_null", f"select event_id, last_value(value ignore nulls) over ({part}order by ts, event_id rows "
                        f"between unbounded preceding and current row) as forward, first_value(value ignore nulls) over ({part}order by "
                        "ts, event_id rows between current row and unbounded following) as backward from t")


def filled(spark, d, by, opts):
    df = fixture(spark, d, "events_null").withColumn("forward", F.col("value")).withColumn("backward", F.col("value"))
    df = windows.fill_along(df, ["forward"], ORDER, by, "forward", opts)
    return windows.fill_along(df, ["backward"], ORDER, by, "backward", opts).select("event_id", "forward", "backward")


@query("W5_ordered_fills", fill_sql("event_type"))
def w5(spark, d):
    return filled(spark, d, ["event_type"], Options())


@query("W5_ordered_fills_blocks", fill_sql())
def w5_blocks(spark, d):
    return filled(spark, d, [], BLOCKS)


_SIGMA = ("with s as (select event_type, avg(value) m, stddev_samp(value) sd from events group by 1) select event_id, "
          + R("m") + " as mean, " + R("sd") + " as std, abs(value - m) > 2.5 * sd as is_anomaly from events join s using (event_type)")


@query("W6_sigma_statistics", _SIGMA)
def w6(spark, d):
    out = explore.sigma_anomalies(table(spark, d, "events"), "event_type", "value")
    return rounded(out.select("event_id", "mean", "std", "is_anomaly"))


@query("F8_sigma_anomalies", f"select event_id from ({_SIGMA}) where is_anomaly")
def f8(spark, d):
    out = explore.sigma_anomalies(table(spark, d, "events"), "event_type", "value")
    return out.where("is_anomaly").select("event_id")


_SPLIT = ("select event_id, row_number() over (order by ts, event_id) <= floor(0.8 * (select count(*) from events)) as is_train from events")


@query("W7_chronological_split", _SPLIT)
def w7(spark, d):
    return windows.chronological_split(table(spark, d, "events").select("event_id", "ts"), ORDER).drop("ts")


@query("W7_chronological_split_blocks", _SPLIT)
def w7_blocks(spark, d):
    return windows.chronological_split(table(spark, d, "events").select("event_id", "ts"), ORDER, opts=BLOCKS).drop("ts")


@query("W8_row_numbers", "select event_id, row_number() over (order by ts, event_id) as _rn from events")
def w8(spark, d):
    return windows.number_rows(table(spark, d, "events").select("event_id", "ts"), ORDER, BLOCKS).drop("ts")


_DAY_ROWS = "select event_id, date_trunc('day', ts) as day, event_type, value from events"


@query("W1_lags_tied_stamps", f"select event_id, {', '.join(f'lag(value, {k}) over w as value_lag{k}' for k in (1, 2, 3, 7))}, "
       + R("avg(value) over (partition by event_type order by day, event_id rows between 6 preceding and current row)") + " as value_roll_mean_7 "
       f"from ({_DAY_ROWS}) window w as (partition by event_type order by day, event_id)")
def w1_tied(spark, d):
    """The order names the day only; the row decides among its many rows."""
    df = table(spark, d, "events").select("event_id", F.date_trunc("day", "ts").alias("day"), "event_type", "value")
    out = windows.lag_features(df, "value", ["day"], ["event_type"], BLOCKS)
    return rounded(out.drop("day", "event_type", "value", "value_roll_std_7"))


@query("W8_row_numbers_tied_stamps", f"select event_id, row_number() over (order by event_type, event_id) as _rn from ({_DAY_ROWS})")
def w8_tied(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value")
    return windows.number_rows(df, ["event_type"], BLOCKS).drop("event_type", "value")


@query("L1_time_order", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey")
def l1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("L2_top_signals", "select event_type, count(*) as n from events group by 1 order by n desc, 1 limit 6")
def l2(spark, d):
    return explore.top_signals(table(spark, d, "events"), "event_type", 6)


_TEXT = f"case when value is not null and {num('value')} is null then value end"


@query("L4_first_events", with_fixture("signal_pool", f"select event_id, {_TEXT} as event from t where {_TEXT} is not null "
       "order by \"timestamp\", event_id limit 500"))
def l4(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    out = explore.event_timeline(df, "timestamp", "signalname", "value_text", ["timestamp", "event_id"], first=500, top=1000)
    return out.select("event_id", "event")


@query("L5_top_importances")
def l5(spark, d):
    from tablescope.operators.learning.clusters import loadings
    return loadings(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).where("rank <= 8")


@query("L6_row_sample")
def l6(spark, d):
    return explore.sample_rows(table(spark, d, "lineitem"), 10_000)


@query("L7_plot_line", "select l_quantity, l_extendedprice, l_returnflag from lineitem")
def l7_line(spark, d):
    return explore.plot_data(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", "line", None)


@query("L7_plot_box", "with t as (select * from lineitem)" + box_frame("l_extendedprice", "l_returnflag")
       + box_sql("l_extendedprice", "l_returnflag"))
def l7_box(spark, d):
    return rounded(explore.plot_data(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", "box", None), 6)


@query("L7_plot_histogram", "with t as (select * from lineitem) " + union(
    [histogram_sql(c, 40) for c in ("l_quantity", "l_extendedprice")]))
def l7_histogram(spark, d):
    return explore.plot_data(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", kind="histogram",
                             sample=None).select("column", "bin", "n")


_HEAT = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("L7_plot_heatmap", union([f"select '{a}' as a, '{b}' as b, {R('max(1.0::double)' if a == b else f'corr({a}, {b})')} as r from customer"
                                 for a in _HEAT for b in _HEAT]))
def l7_heatmap(spark, d):
    return rounded(explore.plot_data(table(spark, d, "customer"), "c_custkey", "c_acctbal", kind="heatmap", sample=None))


@query("L7_plot_scatter")
def l7_scatter(spark, d):
    return explore.plot_data(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("L8_event_timeline", with_fixture("signal_pool", f""", e as (select event_id, "timestamp", signalname as signal, {_TEXT} as event
    from t where {_TEXT} is not null order by "timestamp", event_id limit 500),
    k as (select event from e group by 1 order by count(*) desc, event limit 10)
    select event_id, "timestamp", event, signal from e where event in (select event from k)"""))
def l8(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    return explore.event_timeline(df, "timestamp", "signalname", "value_text", ["timestamp", "event_id"], first=500)


@query("L8_event_timeline_whole", with_fixture("signal_pool", f""", e as (select event_id, "timestamp", signalname as signal, {_TEXT} as event
    from t where {_TEXT} is not null),
    k as (select event from e group by 1 order by count(*) desc, event limit 10)
    select event_id, "timestamp", event, signal from e where event in (select event from k)"""))
def l8_whole(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    return explore.event_timeline(df, "timestamp", "signalname", "value_text", ["timestamp", "event_id"])


@query("L9_signal_series", with_fixture("signal_pool", f""", v as (select signalname, "timestamp", event_id, {num('value')} as x from t),
    k as (select signalname from t where signalname is not null group by 1 order by count(*) desc, signalname limit 6),
    s as (select signalname, avg(x) m, stddev_samp(x) sd from v where x is not null group by 1)
    select event_id, x as value_num, abs(x - m) > 2.5 * sd as is_anomaly,
    case when count(x) over w = 20 then {R('avg(x) over w')} end as moving_avg
    from v join s using (signalname) where x is not null and signalname in (select signalname from k)
    window w as (partition by signalname order by "timestamp", event_id rows between 19 preceding and current row)"""))
def l9(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    out = explore.signal_series(df, "signalname", "timestamp", "value_num", ["timestamp", "event_id"])
    return rounded(out.select("event_id", "value_num", "is_anomaly", "moving_avg"))
