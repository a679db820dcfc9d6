"""Aggregations: quality checks, summaries, distributions, quotas."""

from pyspark.sql import functions as F

from tablescope.catalog.base import (R, each, fixture, fixture_sql, num, query, rounded, table, union,
                                     with_fixture)
from tablescope.operators import clean, explore, missing, outliers, quality, quota
from tablescope.operators.features import signal_statistics
from tablescope.operators.learning.common import class_metrics, confusion
from tablescope.plans import roles as rl
from tablescope.plans.stats import missing_counts, value_counts

GAPS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
DIRTY = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "price", "part_text", "l_returnflag"]
DIRTY_NUM = ["l_orderkey", "l_linenumber", "l_quantity", "price"]
WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RATIO = "(1 - count({c}) / cast(count(*) as double))"


@query("A1_missing", with_fixture("lineitem_gaps", each(GAPS,
       "select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_missing, "
       + R(RATIO) + " as ratio from t")))
def a1(spark, d):
    return rounded(missing_counts(fixture(spark, d, "lineitem_gaps")))


@query("A1_missing_nan", with_fixture("events_nan", "select 'value' as \"column\", count(*) as n_rows, "
       "count(case when isnan(value) then 1 end) as n_missing from t union all select 'event_id', count(*), 0 from t"))
def a1_nan(spark, d):
    from tablescope.functions.exprs import nan_to_null
    return missing_counts(nan_to_null(fixture(spark, d, "events_nan"))).select("column", "n_rows", "n_missing")


@query("A2_effective_missing", with_fixture("events_null", each(["event_id", "user_id"],
       "select '{c}' as \"column\", " + R(RATIO + " * 100") + " as missing_pct from t")))
def a2(spark, d):
    roles = rl.Roles("signal_pool", 1.0, signal="event_type", value="value", timestamp="ts")
    return rounded(explore.effective_missing(fixture(spark, d, "events_null"), roles))


@query("A3_duplicates", with_fixture("customer_dup",
       "select count(*) as n_rows, count(*) - (select count(*) from (select distinct * from t)) as n_duplicates from t"))
def a3(spark, d):
    return quality.duplicate_counts(fixture(spark, d, "customer_dup"))


def fences(c: str, k: float, by: str = "") -> str:
    g = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return (f"select {g}quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) lo, "
            f"quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) hi, "
            f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) iqr, count({c}) n from t{tail}")


def outlier_sql(columns: list[str], k: float, row: str) -> str:
    """``row`` sees column c, lo, hi, n and m (the number of outliers)."""
    return union([
        f"select {row.format(c=c)} from (select lo, hi, n, count(case when {c} < lo or {c} > hi then 1 end) m, "
        f"count(*) rows_ from t, ({fences(c, k)}) b where n >= 10 and iqr <> 0 group by lo, hi, n) where m > 0"
        for c in columns])


SPIKE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("A4_quality_outliers", with_fixture("lineitem_spike", outlier_sql(SPIKE, 2.5,
       "'{c}' as \"column\", n as n_values, " + R("lo", 6) + " as lower, " + R("hi", 6) + " as upper, "
       "m as n_outliers, " + R("m * 100.0 / n") + " as pct")))
def a4(spark, d):
    return rounded(quality.quality_outliers(fixture(spark, d, "lineitem_spike")))


@query("A5_iqr_bounds", with_fixture("lineitem_spike", union([
    f"select '{c}' as \"column\", n as n_values, {R('lo', 6)} as lower, {R('hi', 6)} as upper, {R('iqr', 6)} as iqr "
    f"from ({fences(c, 2.5)})" for c in SPIKE])))
def a5(spark, d):
    return rounded(outliers.bounds_table(fixture(spark, d, "lineitem_spike"), SPIKE, "iqr", 2.5), 6)


@query("A5_z_bounds", with_fixture("lineitem_spike", each(SPIKE,
       "select '{c}' as \"column\", count({c}) as n_values, " + R("avg({c}) - 3.5 * stddev_samp({c})", 3) + " as lower, "
       + R("avg({c}) + 3.5 * stddev_samp({c})", 3) + " as upper, " + R("stddev_samp({c})", 3) + " as iqr from t")))
def a5_z(spark, d):
    return rounded(outliers.bounds_table(fixture(spark, d, "lineitem_spike"), SPIKE, "zscore", 3.5), 3)


@query("A6_outlier_summary", with_fixture("lineitem_spike", outlier_sql(SPIKE, 1.5,
       "'{c}' as \"column\", m as n_outliers, " + R("m / cast(rows_ as double)", 8) + " as ratio, "
       + R("lo", 6) + " as lower, " + R("hi", 6) + " as upper")))
def a6(spark, d):
    return rounded(outliers.detect_outliers(fixture(spark, d, "lineitem_spike")), 6, ratio=8)


@query("A6_zscore_summary", with_fixture("lineitem_spike", union([
    f"select '{c}' as \"column\", m as n_outliers, {R('m / cast(n as double)', 8)} as ratio, {R('lo', 3)} as lower, "
    f"{R('hi', 3)} as upper from (select lo, hi, count(*) n, count(case when {c} < lo or {c} > hi then 1 end) m from t, "
    f"(select avg({c}) - 3 * stddev_samp({c}) lo, avg({c}) + 3 * stddev_samp({c}) hi from t) b group by lo, hi) where m > 0"
    for c in SPIKE])))
def a6_z(spark, d):
    return rounded(outliers.detect_outliers(fixture(spark, d, "lineitem_spike"), "zscore"), 3, ratio=8)


@query("A6_outlier_values", with_fixture("lineitem_spike", union([
    f"select l_orderkey, l_linenumber, '{c}' as \"column\", {R(c, 3)} as value from t, ({fences(c, 1.5)}) b "
    f"where {c} < lo or {c} > hi" for c in ("l_quantity", "l_extendedprice")])))
def a6_values(spark, d):
    df = fixture(spark, d, "lineitem_spike")
    bounds = outliers.bounds_table(df, ["l_quantity", "l_extendedprice"], "iqr", 1.5)
    return rounded(outliers.outlier_values(df, bounds, ["l_orderkey", "l_linenumber"]), 3)


@query("A7_number_as_text", with_fixture("orders_text_num", "select 'custkey_text' as \"column\", "
       + R(f"avg(case when {num('custkey_text')} is not null then 1.0 else 0 end)") + " as numeric_ratio from t "
       f"having avg(case when {num('custkey_text')} is not null then 1.0 else 0 end) between 0.8000001 and 0.9999999"))
def a7(spark, d):
    return rounded(quality.number_as_text(fixture(spark, d, "orders_text_num")))


@query("A8_negative_counts", with_fixture("part_neg",
       "select 'price' as \"column\", count(case when price < 0 then 1 end) as n_negative from t"))
def a8(spark, d):
    return quality.negative_counts(fixture(spark, d, "part_neg"))


_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_NUMS = ("c_custkey", "c_nationkey", "c_acctbal")


@query("A9_profile", union([
    f"select '{c}' as \"column\", '{t}' as type, cast(100 - 100.0 * count({c}) / count(*) as double) as missing_pct, "
    f"count(distinct {c}) as n_distinct, " + (
        f"{R(f'avg({c})', 4)} as mean, {R(f'stddev_samp({c})', 4)} as std, cast(min({c}) as double) as min, "
        f"cast(max({c}) as double) as max" if c in _NUMS else
        "null::double as mean, null::double as std, null::double as min, null::double as max") + " from customer"
    for c, t in _TYPES.items()]))
def a9(spark, d):
    return rounded(quality.profile(table(spark, d, "customer")).drop("sample"), 4)


_DIRTY_SCORE = ("greatest(0.0, least(100.0, 100.0"
                + "".join(f" - 20.0 * (select {RATIO.format(c=c)} from t)" for c in DIRTY)
                + " - 50.0 * (select 1 - (select count(*) from (select distinct * from t)) / cast(count(*) as double) from t)"
                + "".join(f" - 0.1 * coalesce((select x from ({outlier_sql([c], 2.5, 'm * 100.0 / n as x')})), 0)"
                          for c in DIRTY_NUM)
                + f" - 2.0 * (select case when avg(case when {num('part_text')} is not null then 1.0 else 0 end) > 0.8 and "
                  f"avg(case when {num('part_text')} is not null then 1.0 else 0 end) < 1 then 1 else 0 end from t)"
                + "".join(f" - (select case when min({c}) < 0 then 1.0 else 0 end from t)" for c in ("l_quantity", "price"))
                + "))")


@query("A10_quality_score", with_fixture("dirty_lines", f"select {R(_DIRTY_SCORE)} as quality_score"))
def a10(spark, d):
    return rounded(quality.quality_score(fixture(spark, d, "dirty_lines")))


def _sev(x: str, high: int, mid: int) -> str:
    return f"case when {x} > {high} then 'high' when {x} > {mid} then 'medium' else 'low' end"


@query("A11_issues", with_fixture("dirty_lines", "select * from (" + union([
    *[f"select 'missing' as category, '{c}' as \"column\", {_sev(f'100 * {RATIO.format(c=c)}', 50, 20)} as severity, "
      f"count(*) - count({c}) as \"count\", {R(f'100 * {RATIO.format(c=c)}')} as pct from t having count({c}) < count(*)"
      for c in DIRTY],
    "select 'duplicate', '*', case when 100.0 * (n - k) / n < 5 then 'medium' else 'high' end, n - k, "
    + R("100.0 * (n - k) / n") + " from (select count(*) n, (select count(*) from (select distinct * from t)) k from t) where n > k",
    outlier_sql(DIRTY_NUM, 2.5, "'outlier', '{c}', " + _sev("m * 100.0 / n", 10, 3) + ", m, " + R("m * 100.0 / n")),
    *[f"select 'range_error', '{c}', 'medium', count(case when {c} < 0 then 1 end), null from t having min({c}) < 0"
      for c in ("l_quantity", "price")]]) + ")"))
def a11(spark, d):
    return rounded(quality.issues(fixture(spark, d, "dirty_lines")).drop("detail"))


_MISS = "(" + " + ".join(f"(select {RATIO.format(c=c)} from t)" for c in DIRTY) + f") / {len(DIRTY)}"
_DUP = "(select 1 - (select count(*) from (select distinct * from t)) / cast(count(*) as double) from t)"


@query("A12_overview_score", with_fixture("dirty_lines", f"select {R(f'100 * {_MISS}')} as missing_pct, "
       f"{R(f'100 * {_DUP}')} as duplicate_pct, {R(f'greatest(0, 100 - 50 * {_MISS} - 150 * {_DUP})')} as score"))
def a12(spark, d):
    return rounded(quality.overview_score(fixture(spark, d, "dirty_lines")))


@query("A13_profile_score", with_fixture("dirty_lines",
       f"select {R(f'greatest(0, 100 - 50 * {_MISS} - 20 * {_DUP})')} as score"))
def a13(spark, d):
    return rounded(quality.profile_score(fixture(spark, d, "dirty_lines"))[0])


_MOMENTS = (R("avg({c})", 4) + " as mean, " + R("stddev_samp({c})", 4) + " as std, " + R("cast(min({c}) as double)", 4)
            + " as min, " + R("cast(max({c}) as double)", 4) + " as max")


@query("A14_basic_stats", with_fixture("lineitem_gaps", each(GAPS[2:6],
       "select '{c}' as \"column\", " + _MOMENTS + " from t")))
def a14(spark, d):
    return rounded(explore.basic_stats(fixture(spark, d, "lineitem_gaps"), GAPS[2:6]), 4)


_DESC = ("count({c}) as n, " + _MOMENTS + ", " + R("quantile_cont({c}, 0.25)", 4) + " as q1, "
         + R("quantile_cont({c}, 0.5)", 4) + " as median, " + R("quantile_cont({c}, 0.75)", 4) + " as q3, "
         + R("skewness({c})", 5) + " as skew, " + R("kurtosis({c})", 5) + " as kurt")


@query("A15_describe", with_fixture("lineitem_gaps", each(GAPS[:6],
       "select '{c}' as \"column\", " + _DESC + " from t")))
def a15(spark, d):
    return rounded(explore.describe(fixture(spark, d, "lineitem_gaps"), GAPS[:6]), 4, skew=5, kurt=5)


@query("A16_describe_by_signal", f"with t as (select signalname, {num('value')} as value_num from "
       f"({fixture_sql('signal_pool')})) select signalname, 'value_num' as \"column\", {_DESC.format(c='value_num')} "
       "from t group by signalname")
def a16(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    return rounded(explore.describe(df, ["value_num"], ["signalname"]), 4, skew=5, kurt=5)


@query("A17_signal_statistics", "select event_type, " + R("avg(value)") + " as sig_mean, " + R("stddev_samp(value)")
       + " as sig_std, min(value) as sig_min, max(value) as sig_max, count(value) as sig_count from events group by 1")
def a17(spark, d):
    return rounded(signal_statistics(table(spark, d, "events"), "event_type", "value"))


_CORR = [f"select '{a}' as a, '{b}' as b, {R(f'corr({a}, {b})', 6)} as r from t" for a in GAPS[:6] for b in GAPS[:6] if a != b]


@query("A18_correlations", with_fixture("lineitem_gaps", union(
    _CORR + [f"select '{a}', '{a}', max(1.0::double) from t" for a in GAPS[:6]])))
def a18(spark, d):
    return rounded(explore.correlations(fixture(spark, d, "lineitem_gaps"), GAPS[:6]))


@query("A19_strong_pairs", "with t as (select l_quantity, l_quantity * 2 + l_tax as doubled, l_discount from lineitem) "
       "select * from (" + union([f"select '{a}' as a, '{b}' as b, {R(f'corr({a}, {b})')} as r from t" for a, b in
                                  (("l_quantity", "doubled"), ("l_quantity", "l_discount"), ("doubled", "l_discount"))])
       + ") where abs(r) > 0.7")
def a19(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_quantity", "l_quantity * 2 + l_tax as doubled", "l_discount")
    return rounded(explore.strong_pairs(df, df.columns))


@query("A20_skewed_columns", with_fixture("lineitem_spike", "select * from (" + each(
    SPIKE, "select '{c}' as \"column\", " + R("skewness({c})", 5) + " as skew from t") + ") where abs(skew) > 2"))
def a20(spark, d):
    return rounded(explore.skewed_columns(fixture(spark, d, "lineitem_spike"), SPIKE), 5)


@query("A21_constant_columns", with_fixture("columns_constant", each(
    ["c_custkey", "c_mktsegment", "constant_text", "constant_number"],
    "select '{c}' as \"column\" from t having count(distinct {c}) <= 1")))
def a21(spark, d):
    return explore.constant_columns(fixture(spark, d, "columns_constant"))


@query("A22_signal_inventory", with_fixture("signal_pool", f"""select (select count(distinct signalname) from t) as n_signals,
    signalname as top_signal, count(*) as top_count, (select count({num('value')}) from t) as numeric_rows
    from t group by signalname order by count(*) desc, signalname limit 1"""))
def a22(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    return explore.signal_inventory(df, "signalname", "value_num")


_SG = ["c_custkey", "balance", "sparse", "nation"]


@query("A23_insights", with_fixture("segment_gaps", "select * from (" + union([
    *[f"select case when {RATIO.format(c=c)} > 0.5 then 'high_missing' else 'mid_missing' end as kind, '{c}' as subject, "
      f"{R(RATIO.format(c=c))} as value from t having {RATIO.format(c=c)} > 0.2" for c in [*_SG, "segment"]],
    "select 'duplicate_rows', '*', cast(count(*) - (select count(*) from (select distinct * from t)) as double) from t",
    "select 'strong_pairs', '*', cast(sum(case when not isnan(r) and abs(r) > 0.7 then 1 else 0 end) as double) from (" + union(
        [f"select corr({a}, {b}) r from t" for i, a in enumerate(_SG) for b in _SG[i + 1:]]) + ") having "
    "sum(case when not isnan(r) and abs(r) > 0.7 then 1 else 0 end) > 0",
    *[f"select 'high_skew', '{c}', {R(f'skewness({c})')} from t having abs(skewness({c})) > 2" for c in _SG],
    *[f"select 'constant', '{c}', 1.0 from t having count(distinct {c}) <= 1" for c in [*_SG, "segment"]]]) + ")"))
def a23(spark, d):
    df = fixture(spark, d, "segment_gaps")
    roles = rl.Roles("wide_table", 1.0, numeric=tuple(_SG), categorical=("segment",))
    return rounded(explore.insights(df, roles))


@query("A23_insights_signals", with_fixture("signal_pool", f"""select * from (
    select 'duplicate_rows' as kind, '*' as subject, cast(count(*) - (select count(*) from (select distinct * from t)) as double) as value from t
    union all select 'signals', '*', cast(count(distinct signalname) as double) from t
    union all (select 'top_signal', signalname, cast(count(*) as double) from t group by 2 order by count(*) desc, 2 limit 1)
    union all select 'numeric_rows', 'value_num', cast(count({num('value')}) as double) from t
    union all select 'mid_missing', 'value_num', {R(f"1 - count({num('value')}) / cast(count(*) as double)")} from t
        having 1 - count({num('value')}) / cast(count(*) as double) > 0.2
    union all select 'high_missing', 'value_text', {R(f"1 - count(case when {num('value')} is null then value end) / cast(count(*) as double)")} from t)"""))
def a23_signals(spark, d):
    raw = fixture(spark, d, "signal_pool")
    roles = rl.with_split(rl.detect(raw), "value_num", "value_text")
    return rounded(explore.insights(clean.split_mixed(raw, "value"), roles))


_MODE = "(select segment from t where segment is not null group by 1 order by count(*) desc, segment limit 1)"


@query("A24_imputation", with_fixture("segment_gaps", f"select c_custkey, coalesce(segment, {_MODE}) as segment, "
       + R("coalesce(balance, (select avg(balance) from t))", 4) + " as balance, "
       + R("coalesce(nation, (select quantile_cont(nation, 0.5) from t))", 4) + " as nation from t"))
def a24(spark, d):
    df = fixture(spark, d, "segment_gaps").drop("sparse")
    return rounded(missing.handle_missing(
        df, {"segment": "fill_mode", "balance": "fill_mean", "nation": "fill_median"})[0], 4)


@query("A25_imputation_advice", with_fixture("segment_gaps", "select * from (" + union([
    f"select '{c}' as \"column\", count(*) - count({c}) as n_missing, {R(RATIO.format(c=c))} as ratio, "
    f"case when {RATIO.format(c=c)} >= 0.7 then 'drop_column' "
    + ("" if c == "segment" else f"when {RATIO.format(c=c)} < 0.05 then 'fill_mean' ")
    + f"else '{'fill_mode' if c == 'segment' else 'fill_median'}' end as action from t"
    for c in [*_SG, "segment"]]) + ") where n_missing > 0"))
def a25(spark, d):
    return rounded(missing.advise(fixture(spark, d, "segment_gaps")))


@query("A26_type_counts", "select type, cast(n as int) as n from (values ('bigint', 3), ('int', 1), ('double', 4), ('string', 2), "
       "('timestamp_ntz', 1)) v(type, n) where (select count(*) from lineitem) > 0")
def a26(spark, d):
    return explore.type_counts(table(spark, d, "lineitem"))


@query("A26_role_counts")
def a26_roles(spark, d):
    return explore.role_counts(spark, rl.detect(table(spark, d, "part")))


def histogram_sql(column: str, bins: int, source: str = "t", label: str | None = None) -> str:
    return (f"select '{label or column}' as \"column\", cast(case when hi > lo then least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) "
            f"else 0 end as int) as bin, count(*) as n from {source}, (select min({column})::double lo, max({column})::double hi from {source}) b "
            f"where {column} is not null group by 1, 2")


@query("A27_histogram", with_fixture("lineitem_gaps", union([histogram_sql(c, 30) for c in GAPS[2:6]])))
def a27(spark, d):
    return explore.histogram(fixture(spark, d, "lineitem_gaps"), GAPS[2:6]).select("column", "bin", "n")


@query("A27_signal_histogram", "with top as (select event_type from events group by 1 order by count(*) desc, event_type limit 8), "
       "b as (select event_type, min(value) lo, max(value) hi from events group by 1) select event_type, "
       "cast(least(floor((value - lo) / ((hi - lo) / 30)), 29) as int) as bin, count(*) as n from events join b using (event_type) "
       "where event_type in (select event_type from top) group by 1, 2")
def a27_signal(spark, d):
    return explore.signal_histogram(table(spark, d, "events"), "event_type", "value").select("event_type", "bin", "n")


def kde_sql(c: str) -> str:
    return (f"select '{c}' as \"column\", cast(i as int) as point, {R('x', 4)} as x, "
            f"{R('sum(w * exp(-0.5 * power((x - v) / h, 2))) * (hi - lo) / 30 / (h * sqrt(2 * pi()))', 3)} as y from ("
            f"select v, w, i, lo, hi, sd * power(n, -0.2) as h, lo + i * (hi - lo) / 199 as x from "
            f"(select {c} v, count(*) w from lineitem group by 1), (select count(*) n, stddev_samp({c}) sd, min({c}) lo, max({c}) hi "
            f"from lineitem), range(200) r(i)) group by i, x, lo, hi, h")


@query("A28_density", union([kde_sql(c) for c in ("l_quantity", "l_discount")]))
def a28(spark, d):
    return rounded(explore.density(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]), 4, y=3)


def box_sql(c: str, by: str = "", source: str = "t") -> str:
    g = f"{by}, " if by else ""
    using = f"join b using ({by})" if by else ", b"
    return (f"select {g}'{c}' as \"column\", {R('q1', 6)} as q1, {R('mid', 6)} as median, {R('q3', 6)} as q3, "
            f"{R('lo', 6)} as lower_fence, {R('hi', 6)} as upper_fence, "
            f"cast(min(case when {c} >= lo and {c} <= hi then {c} end) as double) as low_whisker, "
            f"cast(max(case when {c} >= lo and {c} <= hi then {c} end) as double) as high_whisker, "
            f"count(case when {c} < lo or {c} > hi then 1 end) as n_outliers from t {using} group by {g}q1, mid, q3, lo, hi")


def box_frame(c: str, by: str = "") -> str:
    g, tail = (f"{by}, ", f" group by {by}") if by else ("", "")
    return (f", q as (select {g}quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.5) mid, quantile_cont({c}, 0.75) q3 from t{tail}), "
            f"b as (select *, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi from q) ")


@query("A29_box_stats", with_fixture("lineitem_spike", box_frame("l_extendedprice") + box_sql("l_extendedprice")))
def a29(spark, d):
    return rounded(explore.box_stats(fixture(spark, d, "lineitem_spike"), ["l_extendedprice"]), 6)


@query("A29_box_by_group", with_fixture("lineitem_spike",
       box_frame("l_extendedprice", "l_returnflag") + box_sql("l_extendedprice", "l_returnflag")))
def a29_group(spark, d):
    return rounded(explore.box_stats(fixture(spark, d, "lineitem_spike"), ["l_extendedprice"], ["l_returnflag"]), 6)


@query("A29_box_outliers", with_fixture("lineitem_spike", "select l_orderkey, l_linenumber, 'l_extendedprice' as \"column\", "
       f"{R('l_extendedprice', 3)} as value from t, ({fences('l_extendedprice', 1.5)}) b where l_extendedprice < lo or l_extendedprice > hi"))
def a29_points(spark, d):
    return rounded(explore.box_outliers(fixture(spark, d, "lineitem_spike"), ["l_extendedprice"],
                                        ["l_orderkey", "l_linenumber"]), 3)


_CATS = ["p_name", "p_brand", "p_type"]


@query("A30_categories", "select \"column\", value, n, cast(rank as int) as rank from (select *, row_number() over "
       "(partition by \"column\" order by n desc, value) as rank from (" + each(
           _CATS, "select '{c}' as \"column\", {c} as value, count(*) as n from part group by 2") + ")) where rank <= 15")
def a30(spark, d):
    return explore.category_counts(table(spark, d, "part"), _CATS, 15)


@query("A31_target_distribution", with_fixture("segment_gaps", "select segment as value, count(*) as n, "
       + R("100.0 * count(*) / (select count(*) from t)") + " as pct from t where segment is not null group by 1"))
def a31(spark, d):
    return rounded(explore.target_distribution(fixture(spark, d, "segment_gaps"), "segment"))


@query("A32_null_pattern")
def a32(spark, d):
    return explore.null_pattern(fixture(spark, d, "lineitem_gaps"))


@query("A33_summary_card", with_fixture("dirty_lines", "select (select count(*) from t) as n_rows, 7::bigint as raw_columns, "
       f"12::bigint as feature_columns, {R(f'100 * {_MISS}')} as missing_pct, (select count(*) - (select count(*) from "
       f"(select distinct * from t)) from t) as n_duplicates, {R(_DIRTY_SCORE)} as quality_score"))
def a33(spark, d):
    df = fixture(spark, d, "dirty_lines")
    return rounded(explore.summary_card(df, 12, quality.quality(df).summary))


@query("A34_class_imbalance", "select " + R("max(n) / cast(min(n) as double)")
       + " as imbalance from (select count(*) n from labels group by quality)")
def a34(spark, d):
    return rounded(explore.class_imbalance(table(spark, d, "labels"), "quality"))


_GUESS = "case when l_quantity > 30 then 'A' when l_quantity > 15 then 'N' else 'R' end"


@query("A35_confusion", f"select l_returnflag as label, {_GUESS} as prediction, count(*) as n from lineitem group by 1, 2")
def a35(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.expr(_GUESS).alias("prediction"))
    return confusion(df)


@query("A35_class_metrics", f"""with p as (select l_returnflag as a, {_GUESS} as g from lineitem),
    c as (select distinct a as class from p union select distinct g from p),
    s as (select class, (select count(*) from p where a = class) support, (select count(*) from p where g = class) guessed,
          (select count(*) from p where a = class and g = class) hits from c),
    f as (select class, support, hits / cast(guessed as double) as precision, hits / cast(support as double) as recall from s)
    select class, support, {R('precision')} as precision, {R('recall')} as recall,
    {R('2 * precision * recall / (precision + recall)')} as f1 from f""")
def a35_metrics(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.expr(_GUESS).alias("prediction"))
    return rounded(class_metrics(confusion(df)))


_USE = "select key, cast(ts as date) as usage_date, count(*) as n from t group by 1, 2"


@query("A36_daily_usage", with_fixture("quota_log", "select key, usage_date, n as requests, least(n, 5) as allowed, "
       f"greatest(n - 5, 0) as denied, greatest(5 - n, 0) as remaining from ({_USE})"))
def a36(spark, d):
    return quota.daily_usage(fixture(spark, d, "quota_log"), "key", "ts", 5)


@query("A36_admitted", with_fixture("quota_log", "select event_id, key, ts, cast(used as int) as used from (select *, row_number() over "
       "(partition by key, cast(ts as date) order by ts, event_id) as used from t) where used <= 5"))
def a36_rows(spark, d):
    return quota.admitted(fixture(spark, d, "quota_log"), "key", "ts", ["ts", "event_id"], 5)


@query("A00_value_counts", each(["l_returnflag", "l_linestatus"],
       "select '{c}' as \"column\", {c} as value, count(*) as n from lineitem group by 2"))
def values(spark, d):
    return value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
