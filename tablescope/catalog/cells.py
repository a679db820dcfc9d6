"""Projections, scalar functions, filters, joins and set operations."""

from pyspark.sql import functions as F

from tablescope.catalog.base import (R, each, fixture, fixture_sql, num, query, rounded, table, with_fixture)
from tablescope.functions.exprs import is_number
from tablescope.functions.text import client_key, dedup_lines
from tablescope.operators import clean, encode, missing, outliers, quota
from tablescope.operators.features import (calendar_features, calendar_parts, ratio_features,
                                           row_statistics, signal_features)
from tablescope.operators.learning.association import item_sets, terciles
from tablescope.options import Options

# ------------------------------------------------------------------ P: scalar work


@query("P1_parse_dates", "select o_orderkey, case when o_orderkey % 20 = 0 then null else o_orderdate end as day, "
       "o_orderdate as moment from orders")
def p1(spark, d):
    out = clean.parse_dates(fixture(spark, d, "date_strings"), ["day", "moment"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("day", "moment")})


@query("P2_split_mixed", with_fixture("signal_pool", f"select event_id, {num('value')} as value_num, "
       f"case when value is not null and {num('value')} is null then value end as value_text from t"))
def p2(spark, d):
    return clean.split_mixed(fixture(spark, d, "signal_pool"), "value").select("event_id", "value_num", "value_text")


@query("P2_split_counts", with_fixture("signal_pool", f"select count({num('value')}) as n_numeric, "
       f"count(case when {num('value')} is null then value end) as n_text from t"))
def p2_counts(spark, d):
    return clean.split_counts(fixture(spark, d, "signal_pool"), "value")


@query("P3_is_number", with_fixture("orders_text_num",
       f"select o_orderkey, {num('custkey_text')} is not null as numeric from t"))
def p3(spark, d):
    return fixture(spark, d, "orders_text_num").select("o_orderkey", is_number(F.col("custkey_text")).alias("numeric"))


_CAL = ("cast(year(ts) as int) as ts_year, cast(month(ts) as int) as ts_month, cast(day(ts) as int) as ts_day, "
        "cast(hour(ts) as int) as ts_hour, cast(isodow(ts) - 1 as int) as ts_weekday")


@query("P4_calendar_parts", f"select event_id, {_CAL} from events")
def p4(spark, d):
    return calendar_parts(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query("P5_calendar_features", f"select event_id, 1999 as ts_year, {_CAL.split(', ', 1)[1]}, "
       "cast(quarter(ts) as int) as ts_quarter, case when isodow(ts) >= 6 then 1 else 0 end as ts_is_weekend from events")
def p5(spark, d):
    start = table(spark, d, "events").select("event_id", "ts", F.lit(1999).alias("ts_year"))
    return calendar_features(start, "ts").drop("ts")


_ROW = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("P6_row_statistics", with_fixture("lineitem_gaps", f"""
    , v as (select *, row_number() over () as rid from t),
    u as (select rid, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as x from v),
    s as (select rid, avg(x) m, stddev_samp(x) sd, max(x) hi, min(x) lo from u group by rid)
    select l_orderkey, l_linenumber, l_tax, {R('m', 5)} as _row_mean, {R('sd', 5)} as _row_std,
    {R('hi', 5)} as _row_max, {R('lo', 5)} as _row_min, {R('hi - lo', 5)} as _row_range
    from v join s using (rid)""".replace("t as", "t as", 1)))
def p6(spark, d):
    out = row_statistics(fixture(spark, d, "lineitem_gaps"), list(_ROW))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_tax", "_row_mean", "_row_std", "_row_max", "_row_min",
                              "_row_range"), 5)


@query("P7_ratio_features", with_fixture("part_neg",
       f"select p_partkey, {R('cast(amount as double) / nullif(price, 0)', 8)} as _ratio_amount_price from t"))
def p7(spark, d):
    out = ratio_features(fixture(spark, d, "part_neg"), ["price", "amount", "total"])
    return rounded(out.select("p_partkey", "_ratio_amount_price"), 8)


_B = """b as (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3,
    median(l_extendedprice) mid, quantile_cont(l_extendedprice, 0.01) p01,
    quantile_cont(l_extendedprice, 0.99) p99 from t),
    f as (select *, q1 - {k} * (q3 - q1) lo, q3 + {k} * (q3 - q1) hi from b)"""


def spike(k: float, select: str) -> str:
    return with_fixture("lineitem_spike", f", {_B.format(k=k)} {select}")


def treated(spark, d, action, **opts):
    df = fixture(spark, d, "lineitem_spike")
    return outliers.treat_outliers(df, ["l_extendedprice"], Options(outlier_action=action, **opts))[0]


@query("P8_clip", spike(2.5, f"select l_orderkey, l_linenumber, {R('least(greatest(l_extendedprice, lo), hi)', 6)} "
                             "as l_extendedprice from t, f"))
def p8(spark, d):
    return rounded(treated(spark, d, "clip").select("l_orderkey", "l_linenumber", "l_extendedprice"), 6)


@query("P9_flag", spike(2.5, "select l_orderkey, l_linenumber, (l_extendedprice < lo or l_extendedprice > hi) "
                             "as l_extendedprice_outlier from t, f"))
def p9(spark, d):
    return treated(spark, d, "flag").select("l_orderkey", "l_linenumber", "l_extendedprice_outlier")


def fitted(spark, d, action):
    df = fixture(spark, d, "lineitem_spike").select("l_orderkey", "l_linenumber", "l_extendedprice")
    params = outliers.fit_outliers(df, {"l_extendedprice": action})
    return rounded(outliers.apply_outliers(df, params), 6)


_OUT = "l_extendedprice < lo or l_extendedprice > hi"


@query("P10_outlier_to_null", spike(1.5, f"select l_orderkey, l_linenumber, {R(f'case when {_OUT} then null else l_extendedprice end', 6)} "
                                         "as l_extendedprice from t, f"))
def p10(spark, d):
    return fitted(spark, d, "remove")


@query("P10_outlier_to_median", spike(1.5, f"select l_orderkey, l_linenumber, {R(f'case when {_OUT} then mid else l_extendedprice end', 6)} "
                                           "as l_extendedprice from t, f"))
def p10_median(spark, d):
    return fitted(spark, d, "fill_median")


@query("P11_winsorize", spike(1.5, f"select l_orderkey, l_linenumber, {R('least(greatest(l_extendedprice, p01), p99)', 6)} "
                                   "as l_extendedprice from t, f"))
def p11(spark, d):
    return fitted(spark, d, "winsorize")


@query("P12_constant_fills", with_fixture("segment_gaps",
       "select c_custkey, coalesce(segment, 'Unknown') as segment, coalesce(balance, 0) as balance from t"))
def p12(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment", "balance")
    return missing.handle_missing(df, {"segment": "fill_unknown", "balance": "fill_zero"})[0]


@query("P13_label_codes", with_fixture("segment_gaps",
       "select c_custkey, case when segment is not null then cast((select count(distinct s.segment) from t s "
       "where s.segment < t.segment) as int) end as segment from t"))
def p13(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment")
    return encode.encode(df, {"segment": "label"})[0]


@query("P13_label_unseen", with_fixture("segment_gaps",
       "select c_custkey, case when segment is null then null when segment = 'MACHINERY' then 0 else cast((select "
       "count(distinct s.segment) from t s where s.segment < t.segment and s.segment <> 'MACHINERY') as int) end as segment from t"))
def p13_unseen(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment")
    params = encode.fit_encoding(df.where("segment <> 'MACHINERY'"), {"segment": "label"})
    return encode.apply_encoding(df, params, unseen=0)


@query("P14_decode_labels", with_fixture("segment_gaps", "select c_custkey, segment from t"))
def p14(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment")
    coded, params = encode.encode(df, {"segment": "label"})
    return encode.decode_labels(coded, params, "segment")


_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("P15_onehot", with_fixture("segment_gaps", "select c_custkey, " + ", ".join(
    f'coalesce(cast(segment = \'{s}\' as int), 0) as "segment_{s}"' for s in _SEG) + " from t"))
def p15(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment")
    return encode.encode(df, {"segment": "onehot"})[0]


_ADVISE = ("case when count(distinct {c}) <> 2 and count(distinct {c}) <= 10 then 'onehot' else 'label' end as method")


@query("P16_encoding_advice", each(["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"],
       "select '{c}' as \"column\", count(distinct {c}) as n_distinct, " + _ADVISE + " from lineitem"))
def p16(spark, d):
    return encode.advise_encoding(table(spark, d, "lineitem"),
                                  ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"])


@query("P17_encoding_params", "select 'l_returnflag' as \"column\", 'onehot' as method, l_returnflag as category, "
       "cast(row_number() over (order by l_returnflag) - 1 as int) as code from (select distinct l_returnflag from lineitem) "
       "union all select 'l_linestatus', case when (select count(distinct l_linestatus) from lineitem) = 2 then 'label' "
       "else 'onehot' end, l_linestatus, cast(row_number() over (order by l_linestatus) - 1 as int) "
       "from (select distinct l_linestatus from lineitem)")
def p17(spark, d):
    return encode.fit_encoding(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


_T = "e as (select quantile_cont({c}, 1/3.0) a, quantile_cont({c}, 2/3.0) b from lineitem)"


@query("P18_terciles", f"with {_T.format(c='l_extendedprice')} select l_orderkey, l_extendedprice, "
       "case when l_extendedprice <= a then 'l_extendedprice_low' when l_extendedprice <= b then 'l_extendedprice_mid' "
       "else 'l_extendedprice_high' end as l_extendedprice_bin from lineitem, e")
def p18(spark, d):
    return terciles(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_extendedprice"])


@query("P19_item_sets", "select ['l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus] as items, "
       "count(*) as n from lineitem group by 1")
def p19(spark, d):
    sets = item_sets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    return sets.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


_FWD = ("case when event_id % 3 = 0 then ' 10.0.0.' || (user_id % 256) || ' , 172.16.0.1' "
        "when event_id % 3 = 1 then '' end")
_ADDR = "case when event_id % 7 <> 0 then '192.168.1.' || (user_id % 200) end"


@query("P20_client_key", f"select event_id, substr(sha256(coalesce(case when length({_FWD}) > 0 then "
       f"trim(split_part({_FWD}, ',', 1)) end, {_ADDR}, 'unknown')), 1, 32) as client from events")
def p20(spark, d):
    ev = table(spark, d, "events").select("event_id", F.expr(_FWD).alias("f"), F.expr(_ADDR).alias("a"))
    return ev.select("event_id", client_key(F.col("f"), F.col("a")).alias("client"))


_LINES = r"""with l as (select doc_id, i, regexp_replace(s, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') as line from (
      select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as s from documents)),
    k as (select *, row_number() over (partition by doc_id, left(line, 25) order by i) as rn from l where line <> ''),
    j as (select doc_id, string_agg(line, chr(10) order by i) as body from k where rn = 1 group by doc_id),
    a as (select d.doc_id, coalesce(body, '') as body from documents d left join j using (doc_id))"""


@query("P21_line_dedup", _LINES + r""" select doc_id, case when length(body) > 600
    then regexp_replace(left(body, 600), '\n[^\n]*$', '') || chr(10) || '...' else body end as text from a""")
def p21(spark, d):
    return table(spark, d, "documents").select("doc_id", dedup_lines(F.col("text")).alias("text"))


@query("P21_line_dedup_whole", _LINES + " select doc_id, md5(body) as digest, cast(length(body) as int) as n from a")
def p21_whole(spark, d):
    text = dedup_lines(F.col("text"), max_chars=None)
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("n"))


@query("P22_half_even", "select p_partkey, cast(round_even(p_retailprice * 0.5 + p_size * 0.25, 0) as double) as price from part")
def p22(spark, d):
    c = F.bround(F.col("p_retailprice") * 0.5 + F.col("p_size") * 0.25, 0)
    return table(spark, d, "part").select("p_partkey", c.cast("double").alias("price"))


# ------------------------------------------------------------------ F: filters


@query("F1_complete_cases", with_fixture("lineitem_gaps",
       "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from t "
       "where l_quantity is not null and l_extendedprice is not null"))
def f1(spark, d):
    return fixture(spark, d, "lineitem_gaps").dropna(subset=["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("F2_remove_outlier_rows", with_fixture("lineitem_gaps", """,
    b1 as (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 from t),
    t1 as (select t.* from t, b1 where l_extendedprice is null or not (l_extendedprice < q1 - 0.3 * (q3 - q1)
           or l_extendedprice > q3 + 0.3 * (q3 - q1))),
    b2 as (select quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.75) q3 from t1)
    select t1.l_orderkey, l_linenumber, l_quantity, l_extendedprice from t1, b2 where l_quantity is null or not
    (l_quantity < q1 - 0.3 * (q3 - q1) or l_quantity > q3 + 0.3 * (q3 - q1))"""))
def f2(spark, d):
    out, _ = outliers.treat_outliers(fixture(spark, d, "lineitem_gaps"), ["l_extendedprice", "l_quantity"],
                                     Options(outlier_action="remove", iqr_factor=0.3))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("F3_drop_sparse", with_fixture("segment_gaps", "select c_custkey, segment, balance, nation from t"))
def f3(spark, d):
    return missing.drop_sparse_columns(fixture(spark, d, "segment_gaps"), 0.95)[0]


@query("F4_drop_by_plan", with_fixture("segment_gaps", "select c_custkey, balance, nation from t"))
def f4(spark, d):
    df = fixture(spark, d, "segment_gaps")
    return missing.handle_missing(df, {"segment": "drop_column", "sparse": "drop_column"})[0]


@query("F4_drop_rows_by_plan", with_fixture("segment_gaps", "select c_custkey, segment from t where segment is not null"))
def f4_rows(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "segment")
    return missing.handle_missing(df, {"segment": "drop_row"})[0]


_TOP2 = "(select event_type from events group by 1 order by count(*) desc, event_type limit 2)"


@query("F5_top_signal_rows", f"select event_id, event_type, value from events where event_type in {_TOP2}")
def f5(spark, d):
    from tablescope.operators.explore import top_signals
    from tablescope.plans.runtime import semi_join
    ev = table(spark, d, "events")
    return semi_join(ev, top_signals(ev, "event_type", 2), ["event_type"], bounded=True).select(
        "event_id", "event_type", "value")


@query("F6_text_events", with_fixture("signal_pool",
       f"select event_id, value as value_text from t where value is not null and {num('value')} is null"))
def f6(spark, d):
    out = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    return out.where(F.col("value_text").isNotNull()).select("event_id", "value_text")


@query("F7_frequent_events", "select doc_id, source from documents where source in (select source from documents "
       "group by 1 order by count(*) desc, source limit 10)")
def f7(spark, d):
    from tablescope.operators.explore import top_signals
    from tablescope.plans.runtime import semi_join
    docs = table(spark, d, "documents").select("doc_id", "source")
    return semi_join(docs, top_signals(docs, "source", 10), ["source"], bounded=True).select("doc_id", "source")


@query("F9_rule_filter", "with n as (select count(*) c from lineitem), r as (select l_returnflag a, l_linestatus b, "
       "count(*) k from lineitem group by 1, 2) select a, b, " + R(
           "k * cast((select c from n) as double) / ((select count(*) from lineitem where l_returnflag = a) * "
           "cast((select count(*) from lineitem where l_linestatus = b) as double))", 8)
       + " as lift from r where k * cast((select c from n) as double) >= (select count(*) from lineitem where "
         "l_returnflag = a) * cast((select count(*) from lineitem where l_linestatus = b) as double)")
def f9(spark, d):
    from tablescope.operators.learning.association import association_rules, frequent_itemsets
    sets = frequent_itemsets(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], 0.0001)
    rules = association_rules(sets, 1.0)
    left, right = F.col("antecedent")[0], F.col("consequent")[0]
    picked = rules.where(left.startswith("l_returnflag"))
    name = lambda c: F.element_at(F.split(c, "="), -1)
    return rounded(picked.select(name(left).alias("a"), name(right).alias("b"), "lift"), 8)


@query("F10_high_missing", with_fixture("segment_gaps", "select * from (" + each(
    ["c_custkey", "segment", "balance", "sparse", "nation"],
    "select '{c}' as \"column\", " + R("1 - count({c}) / cast(count(*) as double)")
    + " as ratio, case when 1 - count({c}) / cast(count(*) as double) > 0.5 then 'high' else 'mid' end as band from t")
    + ") where ratio > 0.2"))
def f10(spark, d):
    from tablescope.operators.quality import high_missing
    return rounded(high_missing(fixture(spark, d, "segment_gaps")))


@query("F11_retention", "select cast(ts as date) as usage_date, count(*) as n from events where cast(ts as date) >= "
       "(select max(cast(ts as date)) - 3 from events) group by 1")
def f11(spark, d):
    usage = table(spark, d, "events").groupBy(F.to_date("ts").alias("usage_date")).agg(F.count(F.lit(1)).alias("n"))
    return quota.retain_recent(usage, "usage_date", 3)


# ------------------------------------------------------------------ J and U


_SIG = (f"s as (select signalname, avg({num('value')}) m, stddev_samp({num('value')}) sd, min({num('value')}) lo, "
        f"max({num('value')}) hi, count({num('value')}) n from t where signalname is not null group by 1)")


@query("J1_signal_features", with_fixture("signal_pool", f", {_SIG} select event_id, {R('m')} as sig_mean, "
       f"{R('sd')} as sig_std, lo as sig_min, hi as sig_max, n as sig_count from t left join s using (signalname)"))
def j1(spark, d):
    df = clean.split_mixed(fixture(spark, d, "signal_pool"), "value")
    out = signal_features(df, "signalname", "value_num").select(
        "event_id", "sig_mean", "sig_std", "sig_min", "sig_max", "sig_count")
    return rounded(out)


@query("J1_null_keys", "with t as (select event_id, value, case when event_id % 11 = 0 then null else event_type end as sig "
       "from events), s as (select sig, count(value) n from t where sig is not null group by 1) "
       "select event_id, n as sig_count from t left join s using (sig)")
def j1_null(spark, d):
    df = table(spark, d, "events").select(
        "event_id", "value", F.expr("case when event_id % 11 = 0 then null else event_type end").alias("sig"))
    return signal_features(df, "sig", "value").select("event_id", "sig_count")


@query("J2_dummies", "select o_orderkey, cast(o_orderstatus = 'F' as int) as \"o_orderstatus_F\", "
       "cast(o_orderstatus = 'O' as int) as \"o_orderstatus_O\", cast(o_orderstatus = 'P' as int) as \"o_orderstatus_P\" from orders")
def j2(spark, d):
    return encode.encode(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": "onehot"})[0]


@query("J3_membership", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def j3(spark, d):
    from tablescope.plans.runtime import semi_join
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return semi_join(table(spark, d, "orders"), rich, ["o_custkey"]).select("o_orderkey")


@query("U1_distinct_rows", "select * from customer")
def u1(spark, d):
    return clean.drop_duplicate_rows(fixture(spark, d, "customer_dup"))


@query("U1_keep_first", "select cast(min(event_id) as bigint) as event_id, event_type, user_id from events group by event_type, user_id")
def u1_first(spark, d):
    return clean.keep_first(table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_id"])


@query("U2_union_all", fixture_sql("customer_dup"))
def u2(spark, d):
    c = table(spark, d, "customer")
    return c.unionByName(c.where("c_custkey % 7 = 0"))
