"""Statistical learning operators."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.catalog.base import R, fixture, query, rounded, scratch, table, union, with_fixture
from tablescope.operators import windows
from tablescope.operators.learning import association as assoc
from tablescope.operators.learning import clusters, forecast, isolation, rules, series_forecast, supervised
from tablescope.operators.learning.common import (mark_split, metrics_table, moments,
                                                  regression_metrics, standardize, top_importances)
from tablescope.operators.windows import forecast_feature_names
from tablescope.plans import roles as rl
from tablescope.sources import models

WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def wide(spark, d):
    return fixture(spark, d, "lineitem_wide")


def named(parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables: ``(name, n)``."""
    counted = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


@query("M1_regression")
def m1(spark, d):
    return supervised.regression(wide(spark, d), ["l_extendedprice", *WIDE], "l_extendedprice", ["l_orderkey"]).metrics


_PRED = "l_quantity * 2000 + l_tax * 1000"


@query("M1_regression_metrics", f"with p as (select l_extendedprice y, {_PRED} as p from lineitem) select "
       + R("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))") + " as r2, " + R("sqrt(avg((y - p) * (y - p)))", 3)
       + " as rmse, " + R("avg(abs(y - p))", 3) + " as mae from p")
def m1_metrics(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_extendedprice as label", f"{_PRED} as prediction")
    return rounded(regression_metrics(df), 3, r2=6)


@query("M2_residuals")
def m2(spark, d):
    found = supervised.regression(wide(spark, d), ["l_extendedprice", "l_quantity"], "l_extendedprice", ["l_orderkey"])
    return found.predictions


@query("M3_classification")
def m3(spark, d):
    df = wide(spark, d).withColumn("returned", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no"))
    return supervised.classification(df, WIDE, "returned", ["l_orderkey"]).metrics


def _key52(cols: list[str], seed: int = 42) -> str:
    return "('0x' || substr(md5('" + str(seed) + "'" + "".join(f" || '|' || {c}" for c in cols) + "), 1, 13))::bigint::double"


_S = f"(select *, {_key52(['o_orderkey'])} as k from orders)"


@query("M4_stratified_split", f"with s as (select * from {_S}), c as (select o_orderstatus, quantile_cont(k, 0.8) as cut from s group by 1) "
       "select o_orderkey, o_orderstatus, k <= cut as is_train from s join c using (o_orderstatus)")
def m4(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return mark_split(df, 0.2, "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "is_train")


@query("M4_random_split", f"with s as (select * from {_S}) select o_orderkey, k <= (select quantile_cont(k, 0.8) from s) as is_train from s")
def m4_random(spark, d):
    return mark_split(table(spark, d, "orders").select("o_orderkey"), 0.2, None, ["o_orderkey"])


PART = ["p_size", "p_retailprice", "p_partkey"]


@query("M5_clustering")
def m5(spark, d):
    found = clusters.clustering(table(spark, d, "part"), PART)
    return found.metrics


@query("M5_cluster_curve")
def m5_curve(spark, d):
    return clusters.clustering(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]).tables["curve"]


@query("M6_cluster_profile", "select cluster, count(*) as n, " + R("avg(p_size)") + " as p_size, " + R("avg(p_retailprice)")
       + " as p_retailprice from (select *, cast(p_size % 4 as int) as cluster from part) group by 1")
def m6(spark, d):
    labelled = table(spark, d, "part").withColumn("cluster", (F.col("p_size") % 4).cast("int"))
    return rounded(clusters.cluster_profile(labelled, ["p_size", "p_retailprice"]))


@query("M7_quick_clusters")
def m7(spark, d):
    return clusters.quick_clusters(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"),
                                   ["p_size", "p_retailprice"])


def _rate(c: str) -> str:
    return (f"(select avg(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1.0 else 0 end) from t, "
            f"(select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from t) b)")


_FIVE = ["l_extendedprice", "l_quantity"]


@query("M8_contamination", with_fixture("lineitem_spike", "select " + R(
    f"greatest(0.01, least(0.3, ({' + '.join(_rate(c) for c in _FIVE)}) / 2.0))", 8) + " as contamination"))
def m8_rate(spark, d):
    return rounded(isolation.contamination(fixture(spark, d, "lineitem_spike"), _FIVE), 8)


@query("M8_anomaly_scores")
def m8(spark, d):
    found = isolation.anomaly(fixture(spark, d, "lineitem_spike"), _FIVE, ["l_orderkey", "l_linenumber"])
    return found.predictions


@query("M9_column_forests")
def m9(spark, d):
    return isolation.column_anomalies(fixture(spark, d, "lineitem_spike"), 0.1, columns=["l_quantity", "l_extendedprice"])


_FLAG = "(l_extendedprice > 90000)"


@query("M10_anomaly_contrast", f"select {_FLAG} as is_anomaly, count(*) as n, " + R("avg(l_quantity)") + " as l_quantity, "
       + R("avg(l_extendedprice)", 3) + " as l_extendedprice from lineitem group by 1")
def m10(spark, d):
    flagged = table(spark, d, "lineitem").withColumn("is_anomaly", F.expr(_FLAG))
    return rounded(isolation.contrast(flagged, ["l_quantity", "l_extendedprice"]), l_extendedprice=3)


@query("M10_anomaly_profile", union([
    f"select '{c}' as \"column\", {R(f'avg({c})', 4)} as mean, {R(f'stddev_samp({c})', 4)} as std, min({c}) as min, "
    f"max({c}) as max from lineitem where {_FLAG}" for c in ("l_quantity", "l_extendedprice")]))
def m10_profile(spark, d):
    flagged = table(spark, d, "lineitem").withColumn("is_anomaly", F.expr(_FLAG))
    return rounded(isolation.anomaly_profile(flagged, ["l_quantity", "l_extendedprice"]), 4)


@query("M11_forecast")
def m11(spark, d):
    return forecast.forecast(fixture(spark, d, "daily_sales"), "o_orderdate", "sales").metrics


# A straight line per event type over its rows in time order, with its own level and slope.
_LINES = ("l as (select event_type, row_number() over (partition by event_type order by ts, event_id) as nth from events), "
          "p as (select event_type, count(*) as n, length(event_type) * 100.0::double as level, length(event_type) * 0.25::double as slope from l group by 1)")


def _lines(spark, d):
    numbered = windows.group_index(table(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], "nth")
    size = F.length("event_type")
    # daily stamps, three rows of a series share each stamp's hour with other series
    return numbered.select("event_type", F.expr("cast(timestamp '2020-01-01 00:00:00' as timestamp) + make_dt_interval(nth)").alias("at"),
                           (size * 100.0 + size * 0.25 * (F.col("nth") + 1)).alias("reading"))


@query("M11_forecast_per_signal", f"with {_LINES} select event_type, cast(k as int) as step, " + R("level + slope * (n + k)", 3)
       + " as prediction from p, range(1, 8) s(k)")
def m11_per_signal(spark, d):
    found = series_forecast.forecast_each(_lines(spark, d), "at", "reading", ["event_type"])
    return rounded(found.tables["future"].drop("at"), 3)


@query("M11_forecast_per_signal_fit", f"with {_LINES} select event_type, n - 14 as \"rows\", cast(floor((n - 14) * 0.8) as bigint) as train_rows, "
       "n - 14 - cast(floor((n - 14) * 0.8) as bigint) as test_rows, 1.0::double as r2, 0.0::double as rmse, 0.0::double as mae from p")
def m11_per_signal_fit(spark, d):
    return rounded(series_forecast.forecast_each(_lines(spark, d), "at", "reading", ["event_type"]).metrics, 3)


@query("M12_future_steps")
def m12(spark, d):
    from pyspark.ml.regression import LinearRegression

    from tablescope.operators.learning.common import assemble
    from tablescope.operators.windows import forecast_features

    sales = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.sum("o_totalprice").alias("sales"))
    made = forecast_features(sales, "o_orderdate", "sales", ["o_orderdate"], ["o_orderpriority"])
    model = LinearRegression(labelCol="sales").fit(assemble(made, forecast_feature_names()))
    last = forecast.history(sales, "o_orderdate", "sales", ["o_orderdate"], ["o_orderpriority"])
    return forecast.future_steps(model, last, 7)


# Items of line items: two flags and two tercile bins.
_E = ("e as (select quantile_cont(l_quantity, 1/3.0) qa, quantile_cont(l_quantity, 2/3.0) qb, "
      "quantile_cont(l_extendedprice, 1/3.0) pa, quantile_cont(l_extendedprice, 2/3.0) pb from lineitem), "
      "r as (select row_number() over () as rid, l_returnflag, l_linestatus, "
      "case when l_quantity <= qa then 'l_quantity_low' when l_quantity <= qb then 'l_quantity_mid' else 'l_quantity_high' end as b1, "
      "case when l_extendedprice <= pa then 'l_extendedprice_low' when l_extendedprice <= pb then 'l_extendedprice_mid' "
      "else 'l_extendedprice_high' end as b2 from lineitem, e), "
      "i as (select rid, unnest(['l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus, 'l_quantity_bin=' || b1, "
      "'l_extendedprice_bin=' || b2]) as x from r), m as (select count(*)::double as c from lineitem), "
      "s as (select [x] as items, count(*) as n from i group by 1 union all "
      "select [a.x, b.x], count(*) from i a join i b on a.rid = b.rid and a.x < b.x group by 1 union all "
      "select [a.x, b.x, z.x], count(*) from i a join i b on a.rid = b.rid and a.x < b.x join i z on a.rid = z.rid and b.x < z.x group by 1), "
      "p as (select items, n, n / c as support from s, m), "
      "k as (select case when count(case when support >= 0.3 then 1 end) >= 5 then 0.3 when count(case when support >= 0.2 then 1 end) >= 5 "
      "then 0.2 when count(case when support >= 0.1 then 1 end) >= 5 then 0.1 else 0.05 end as ms from p), "
      "q as (select items, n, support from p, k where support >= {limit})")
_CATS, _NUMS = ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]


def _binned(spark, d):
    df = assoc.terciles(table(spark, d, "lineitem"), _NUMS)
    return df, [*_CATS, "l_quantity_bin", "l_extendedprice_bin"]


def _flat(c):
    return F.array_join(c, " & ")


@query("M13_itemsets", f"with {_E.format(limit='0.05')} select array_to_string(items, ' & ') as items, cast(len(items) as int) as size, n, "
       + R("support", 8) + " as support from q")
def m13(spark, d):
    sets = assoc.frequent_itemsets(*_binned(spark, d), 0.05)
    return rounded(sets.withColumn("items", _flat("items")), 8)


@query("M13_adaptive_itemsets", f"with {_E.format(limit='ms')} select array_to_string(items, ' & ') as items, n from q")
def m13_adaptive(spark, d):
    sets, _ = assoc.adaptive_itemsets(*_binned(spark, d))
    return sets.select(_flat("items").alias("items"), "n")


_RULES = ("select array_to_string(a.items, ' & ') as antecedent, array_to_string(b.items, ' & ') as consequent, " + R("u.support", 9)
          + " as support, " + R("u.support / a.support", 9) + " as confidence, " + R("u.support / a.support / b.support", 9)
          + " as lift from q u join q a on len(a.items) < len(u.items) and list_has_all(u.items, a.items) join q b on "
          "len(a.items) + len(b.items) = len(u.items) and list_has_all(u.items, b.items) and not list_has_any(a.items, b.items) "
          "where u.support / a.support / b.support >= 1")


@query("M13_rules", f"with {_E.format(limit='0.05')} {_RULES}")
def m13_rules(spark, d):
    found = assoc.association_rules(assoc.frequent_itemsets(*_binned(spark, d), 0.05))
    return rounded(found.withColumns({c: _flat(c) for c in ("antecedent", "consequent")}), 9)


@query("L3_top_rules", f"with {_E.format(limit='0.05')} select array_to_string(a.items, ' & ') as antecedent, array_to_string(b.items, ' & ') "
       "as consequent, " + R("u.support / a.support / b.support", 9) + " as lift " + _RULES[_RULES.index("from q u"):]
       + " order by u.support / a.support / b.support desc, u.support / a.support desc, a.items, b.items limit 20")
def l3(spark, d):
    found = assoc.association_rules(assoc.frequent_itemsets(*_binned(spark, d), 0.05))
    return rounded(assoc.top_rules(found).select(_flat("antecedent").alias("antecedent"),
                                                 _flat("consequent").alias("consequent"), "lift"), 9)


@query("M13_association")
def m13_analysis(spark, d):
    df = table(spark, d, "lineitem").withColumn("weight", F.col("l_quantity") * 2 + F.col("l_tax"))
    return assoc.association(df, _CATS, ["l_quantity", "weight"]).metrics


@query("L3_top_itemsets", f"with {_E.format(limit='0.05')} select array_to_string(items, ' & ') as items, n from q "
       "order by support desc, items limit 20")
def l3_sets(spark, d):
    top = assoc.top_itemsets(assoc.frequent_itemsets(*_binned(spark, d), 0.05))
    return top.select(_flat("items").alias("items"), "n")


@query("M14_explained_variance")
def m14(spark, d):
    return clusters.explained_variance(wide(spark, d), WIDE)


_PAIR = ["l_quantity", "l_extendedprice"]
_ANGLE = ("z as (select l_orderkey, l_linenumber, (l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem) as a, "
          "(l_extendedprice - (select avg(l_extendedprice) from lineitem)) / (select stddev_pop(l_extendedprice) from lineitem) as b from lineitem), "
          "c as (select corr(l_quantity, l_extendedprice) as r from lineitem)")


# The matrix of two columns has eigenvalues 1 + r and 1 - r, and vectors at 45 degrees.
@query("M14_explained_variance_pair", f"with {_ANGLE} select 1 as component, " + R("50 * (1 + abs(r))") + " as explained_pct, " + R("50 * (1 + abs(r))")
       + " as cumulative_pct from c union all select 2, " + R("50 * (1 - abs(r))") + ", 100.0::double from c")
def m14_pair(spark, d):
    return rounded(clusters.explained_variance(wide(spark, d), _PAIR))


@query("M15_loadings_pair", f"with {_ANGLE}, w as (select case when r >= 0 then 1 else -1 end as s from c) select * from (select 'l_quantity' as feature, 1 as component, "
       + R("sqrt(0.5)") + " as loading, 1 as rank union all select 'l_extendedprice', 1, " + R("s * sqrt(0.5)") + ", 2 from w union all "
       "select 'l_quantity', 2, " + R("sqrt(0.5)") + ", 1 union all select 'l_extendedprice', 2, " + R("-s * sqrt(0.5)") + ", 2 from w)")
def m15_pair(spark, d):
    return rounded(clusters.loadings(wide(spark, d), _PAIR))


@query("M16_coordinates_pair", f"with {_ANGLE}, w as (select case when r >= 0 then 1 else -1 end as s from c) select l_orderkey, l_linenumber, "
       + R("sqrt(0.5) * (a + s * b)", 5) + " as pc1, " + R("sqrt(0.5) * (a - s * b)", 5) + " as pc2 from z, w")
def m16_pair(spark, d):
    fitted = clusters.decompose(wide(spark, d), _PAIR)
    path = scratch(spark, "components")
    models.save_params(fitted.as_params(spark), path)
    again = clusters.Components.from_params(models.load_params(spark, path))
    return rounded(again.place(wide(spark, d)).select("l_orderkey", "l_linenumber", "pc1", "pc2"), 5)


@query("M15_loadings")
def m15(spark, d):
    return clusters.loadings(wide(spark, d), WIDE)


@query("M16_coordinates")
def m16(spark, d):
    return clusters.principal_coordinates(wide(spark, d), WIDE[:5], ["l_orderkey"])


@query("M17_forest_importance")
def m17(spark, d):
    return top_importances(supervised.forest_importance(wide(spark, d), WIDE[:5], "l_returnflag"))


@query("M18_standardize", "select l_orderkey, " + ", ".join(
    f"{R(f'({c} - avg({c}) over ()) / stddev_pop({c}) over ()')} as {c}" for c in ("l_quantity", "l_tax")) + " from lineitem")
def m18(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    return rounded(standardize(df, ["l_quantity", "l_tax"]))


@query("M19_model_selection", "select 'mean' as model, " + R("sqrt(avg(power(l_extendedprice - m, 2)))", 3)
       + " as rmse from lineitem, (select avg(l_extendedprice) m from lineitem) union all select 'per_unit', "
       + R("sqrt(avg(power(l_extendedprice - l_quantity * 2000, 2)))", 3) + " from lineitem")
def m19(spark, d):
    df = table(spark, d, "lineitem")
    mean = moments(df, ["l_extendedprice"])["l_extendedprice"][0]
    guesses = {"mean": F.lit(mean), "per_unit": F.col("l_quantity") * 2000}
    results = {m: regression_metrics(df.select(F.col("l_extendedprice").alias("label"), g.alias("prediction"))).first().asDict()
               for m, g in guesses.items()}
    picked = metrics_table(spark, results).where("metric = 'rmse'")
    return rounded(picked.select("model", F.col("value").alias("rmse")), 3)


_L = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query("M20_proposals", "with n as (select count(*) c, count(distinct l_returnflag) k from lineitem) "
       f"select 'regression' as kind, 'l_orderkey' as target, array_to_string({_list(_L[1:6])}, ',') as inputs from n where c > 50 "
       f"union all select 'classification', 'l_returnflag', array_to_string({_list(_L[:6])}, ',') from n where k between 2 and 5 "
       f"union all select 'clustering', null, array_to_string({_list(_L)}, ',') from n where c >= 30 "
       "union all select 'forecast', 'l_orderkey', 'l_shipdate' from n "
       f"union all select 'anomaly', null, array_to_string({_list(_L)}, ',') from n "
       f"union all select 'causal', 'l_orderkey', array_to_string({_list(_L[1:5])}, ',') from n")
def m20(spark, d):
    from tablescope.options import Options
    df = table(spark, d, "lineitem")
    return rules.proposals(df, rl.detect(df), Options(reference_inputs=True)).withColumn("inputs", F.array_join("inputs", ","))


@query("M21_recommendations", f"with p as (select l_extendedprice y, {_PRED} as p from lineitem), m as (select "
       "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2 from p) select 'retrain' as rule from m "
       "union all select 'low_r2' from m where r2 < 0.5 union all select 'high_r2' from m where r2 > 0.95")
def m21(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_extendedprice as label", f"{_PRED} as prediction")
    found = metrics_table(spark, {"given": regression_metrics(df).first().asDict()})
    return rules.regression(found, "given").select("rule")
