"""Shape, roles, typology and targets."""

from pyspark.sql import functions as F

from tablescope.catalog.base import (R, fixture, num, query, rounded, table, union,
                                     with_fixture)
from tablescope.options import TARGET_NAMES_EDA, Options
from tablescope.plans import roles as rl

# Physical kinds of the columns the SQL checks need.
COLUMNS = {
    "events": {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "t", "value": "n", "props": "t"},
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"},
    "part": {"p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n", "p_retailprice": "n"},
    "documents": {"doc_id": "n", "text": "t", "lang": "t", "source": "t", "n_chars": "n"},
    "conversations": {"conv_id": "n", "turn": "n", "role": "t", "text": "t"},
    "embeddings": {"vec_id": "n", "embedding": "x", "label": "n"},
    "lineitem": {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
                 "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t",
                 "l_linestatus": "t", "l_shipdate": "d"},
}


def role_sql(source: str, columns: dict[str, str], extra: str = "") -> str:
    parts = []
    for c, kind in columns.items():
        d, n = f"count(distinct {c})", "count(*)"
        if kind == "n":
            named = "true" if "id" in c else "false"
            role = (f"case when {named} and {d} > 0.8 * {n} then 'id' "
                    f"when {d} <= 20 and {d} < 0.05 * {n} then 'categorical' else 'numeric' end")
        elif kind == "t":
            share = f"count({num(c)}) / cast({n} as double)"
            role = (f"case when count({c}) > 0.05 * {n} and {share} > 0.05 and {share} < 0.95 then 'mixed' "
                    f"when {d} <= 50 or {d} < 0.05 * {n} then 'categorical' else 'text' end")
        else:
            role = "'datetime'" if kind == "d" else "'nested'"
        tail = "" if kind in "dx" else f" from {source}"
        parts.append(f"select {extra}'{c}' as \"column\", {role} as role{tail}")
    return union(parts)


def scores_sql(n_from: str, parts: list[str]) -> str:
    names = ("signal_pool", "time_series", "wide_table", "cross_tab")
    return union([f"select '{s}' as shape, {R(f'cast({e} as double)', 4)} as score from {n_from}"
                  for s, e in zip(names, parts)])


def scores(df):
    return rounded(rl.shape_scores(df), 4)


@query("T1_shape_scores", with_fixture("signal_pool", scores_sql("t", [
    f"least(1.0, 0.9 + case when count({num('value')}) / cast(count(*) as double) > 0.1 and "
    f"count({num('value')}) / cast(count(*) as double) < 0.95 then 0.1 else 0 end + "
    "case when count(*) > 250 then 0.05 else 0 end)",
    "0.9 + 0 * count(*)", "0.5 + 0 * count(*)", "0.1 + 0 * count(*)"])))
def t1(spark, d):
    return scores(fixture(spark, d, "signal_pool"))


@query("T2_signal_score", "select 'benchmark' as name, " + R("cast(0.4 + case when count(*) > 100 then 0.05 else 0 end as double)", 4)
       + " as score from benchmark union all select 'events', "
       + R("cast(0.3 + case when count(*) > 300 then 0.05 else 0 end as double)", 4) + " from events")
def t2(spark, d):
    parts = [rl.shape_scores(table(spark, d, n)).where("shape = 'signal_pool'")
             .select(F.lit(n).alias("name"), "score") for n in ("benchmark", "events")]
    return rounded(parts[0].unionByName(parts[1]), 4)


@query("T3_time_score", scores_sql("lineitem", [
    "0.2 + case when count(*) > 550 then 0.05 else 0 end", "1.0 + 0 * count(*)", "0.9 + 0 * count(*)",
    "0.1 + 0 * count(*)"]))
def t3(spark, d):
    return scores(table(spark, d, "lineitem"))


@query("T4_wide_score", scores_sql("customer", [
    "case when count(*) > 250 then 0.05 else 0 end", "0.0 * count(*)", "0.5 + 0 * count(*)", "0.1 + 0 * count(*)"]))
def t4(spark, d):
    return scores(table(spark, d, "customer"))


@query("T5_cross_score", scores_sql("pages", [
    "case when count(*) > 150 then 0.05 else 0 end", "0.0 * count(*)", "0.3 + 0 * count(*)",
    "case when count(*) < 200 then 0.5 else 0.1 end"]))
def t5(spark, d):
    return scores(table(spark, d, "pages"))


@query("T6_key_columns", union([
    f"select '{t}' as table_name, '{k}' as kind, '{c}' as \"column\", count({c}) as n from {t}"
    for t, k, c in (("lineitem", "timestamp", "l_shipdate"), ("orders", "timestamp", "o_orderdate"),
                    ("events", "value", "value"), ("benchmark", "signal", "item_id"))]))
def t6(spark, d):
    out = None
    for name in ("lineitem", "orders", "events", "benchmark"):
        df = table(spark, d, name)
        for kind, c in zip(("signal", "value", "timestamp"), rl.key_columns(df)):
            if c:
                part = df.agg(F.lit(name).alias("table_name"), F.lit(kind).alias("kind"),
                              F.lit(c).alias("column"), F.count(c).alias("n"))
                out = part if out is None else out.unionByName(part)
    return out


ROLE_TABLES = ("events", "customer", "part", "documents", "conversations", "embeddings")


@query("T7_column_roles", with_fixture("signal_pool", union(
    [role_sql(t, COLUMNS[t], f"'{t}' as table_name, ") for t in ROLE_TABLES]
    + [role_sql("t", {"value": "t"}, "'signal_pool' as table_name, ")])))
def t7(spark, d):
    out = None
    for name in ROLE_TABLES:
        part = rl.roles_table(table(spark, d, name)).select(F.lit(name).alias("table_name"), "column", "role")
        out = part if out is None else out.unionByName(part)
    pool = rl.roles_table(fixture(spark, d, "signal_pool"), ["value"])
    return out.unionByName(pool.select(F.lit("signal_pool").alias("table_name"), "column", "role"))


def roles_as_rows(spark, found):
    return spark.createDataFrame(found.as_rows(), "column string, role string")


_VALUES = [c for c, k in COLUMNS["lineitem"].items() if k == "n"]


@query("T8_time_series_roles", union(
    ["select 'l_shipdate' as \"column\", 'timestamp' as role"]
    + [f"select '{c}', 'value_column'" for c in _VALUES]
    + [role_sql("lineitem", {"l_returnflag": "t", "l_linestatus": "t"})]))
def t8(spark, d):
    return roles_as_rows(spark, rl.detect(table(spark, d, "lineitem")))


@query("T9_forced_shape", role_sql("lineitem", COLUMNS["lineitem"]))
def t9(spark, d):
    return roles_as_rows(spark, rl.detect(table(spark, d, "lineitem"), Options(force_schema="wide_table")))


@query("T10_typology", union([
    "select 'events' as table_name, case when count(distinct event_id) > 0.8 * count(*) "
    "then 'Entity Data' else 'Static Wide Table' end as typology from events",
    "select 'lineitem', case when count(*) > 0 then 'Time Series' end from lineitem",
    "select 'customer', case when count(*) > 0 then 'Static Wide Table' end from customer",
    "select 'signal_pool', case when count(*) > 0 then 'Event/Signal Data' end from events"]))
def t10(spark, d):
    frames = {t: table(spark, d, t) for t in ("events", "lineitem", "customer")}
    frames["signal_pool"] = fixture(spark, d, "signal_pool")
    rows = [(t, rl.typology(df, rl.detect(df))[0]) for t, df in frames.items()]
    return spark.createDataFrame(rows, "table_name string, typology string")


@query("T11_target", union([
    "select 'lineitem' as table_name, case when count(distinct l_returnflag) between 2 and 5 "
    "then 'l_returnflag' end as target from lineitem",
    "select 'labels', case when count(distinct quality) between 2 and 5 then 'quality' end from labels",
    "select 'embeddings', case when count(*) > 0 then 'label' end from embeddings"]))
def t11(spark, d):
    rows = []
    for name in ("lineitem", "labels", "embeddings"):
        df = table(spark, d, name)
        rows.append((name, rl.find_target(df, rl.detect(df), TARGET_NAMES_EDA, 5)))
    return spark.createDataFrame(rows, "table_name string, target string")


@query("T12_categorical_columns", "select * from (" + union(
    [f"select '{c}' as \"column\" from lineitem having count(distinct {c}) between 2 and 10" for c in _VALUES]
    + ["select 'l_returnflag'", "select 'l_linestatus'"]) + ")")
def t12(spark, d):
    found = rl.detect_categorical(table(spark, d, "lineitem"), 10)
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("T13_role_summary")
def t13(spark, d):
    df = fixture(spark, d, "signal_pool")
    return rl.summary_rows(spark, rl.detect(df))


@query("T14_clean_names", "select c_custkey as Cust_Key, c_name as name_0, c_nationkey as NAME_1, "
       "c_acctbal as balance, c_mktsegment as seg_ment from customer")
def t14(spark, d):
    messy = table(spark, d, "customer").toDF(" Cust-Key ", "name!", "NAME", "balance($)", "seg. ment")
    return rl.sanitize(messy)
