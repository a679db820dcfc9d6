"""Registry of runnable queries, each with the SQL that gives the same rows.

Inputs are the given tables, or dirty variants derived from them by the same expression
in both engines. Doubles are rounded here, not in the operators, so that sums taken in a
different order compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.plans.runtime import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {
    "signal_pool": """select event_type as signalname, ts as `timestamp`,
        case when event_id % 10 = 0 then event_type when event_id % 17 = 0 then null
             else cast(value as string) end as value, user_id, event_id from {events}""",
    "events_null": """select event_id, ts, event_type,
        case when event_id % 13 = 0 then null else value end as value,
        case when event_id % 3 = 0 then null else user_id end as user_id from {events}""",
    "events_nan": """select event_id,
        case when event_id % 29 = 0 then cast('NaN' as double) else value end as value from {events}""",
    "customer_dup": """select * from {customer}
        union all select * from {customer} where c_custkey % 7 = 0""",
    "orders_text_num": """select o_orderkey,
        case when o_orderkey % 25 = 0 then 'n/a' else cast(o_custkey as string) end as custkey_text
        from {orders}""",
    "part_neg": """select p_partkey,
        case when p_partkey % 50 = 0 then -p_retailprice else p_retailprice end as price,
        p_size as amount, case when p_partkey % 40 = 0 then 0 else p_size end as total from {part}""",
    "lineitem_spike": """select l_orderkey, l_linenumber, l_quantity, l_returnflag,
        l_extendedprice * case when l_orderkey % 500 = 0 then 100 else 1 end as l_extendedprice
        from {lineitem}""",
    "lineitem_wide": """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag from {lineitem}""",
    "lineitem_gaps": """select l_orderkey, l_linenumber,
        case when l_orderkey % 7 = 0 then null else l_quantity end as l_quantity,
        case when l_orderkey % 5 = 0 then null else l_extendedprice end as l_extendedprice,
        case when l_orderkey % 35 = 0 then null else l_discount end as l_discount,
        l_tax, l_returnflag from {lineitem}""",
    "daily_sales": """select o_orderdate, round(sum(o_totalprice), 2) as sales from {orders}
        group by o_orderdate""",
    "quota_log": """select event_id, cast(user_id % 50 as string) as key, ts from {events}""",
    "date_strings": """select o_orderkey,
        case when o_orderkey % 20 = 0 then 'x' else substr(cast(o_orderdate as string), 1, 10) end as day,
        cast(o_orderdate as string) as moment from {orders}""",
    "segment_gaps": """select c_custkey,
        case when c_custkey % 6 = 0 then null else c_mktsegment end as segment,
        case when c_custkey % 4 = 0 then null else c_acctbal end as balance,
        case when c_custkey % 50 = 0 then c_acctbal end as sparse,
        case when c_custkey % 40 = 0 then null else c_nationkey end as nation from {customer}""",
    "dirty_lines": """with base as (select l_orderkey, l_linenumber, l_shipdate,
        case when l_orderkey % 7 = 0 then null else l_quantity end as l_quantity,
        l_extendedprice * case when l_orderkey % 500 = 0 then -100 else 1 end as price,
        case when l_orderkey % 40 = 0 then 'n/a' else cast(l_partkey as string) end as part_text,
        l_returnflag from {lineitem})
        select * from base union all select * from base where l_orderkey % 9 = 0""",
    "columns_constant": """select c_custkey, c_mktsegment, 'same' as constant_text,
        case when c_custkey % 3 = 0 then 7 end as constant_number from {customer}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def fixture_sql(name: str) -> str:
    return FIXTURES[name].format(**{t: t for t in TABLES}).replace("`", '"')


def with_fixture(name: str, body: str) -> str:
    """SQL over a fixture, called ``t`` in ``body``."""
    return f"with t as ({fixture_sql(name)}) {body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns; keyword arguments give digits for single columns."""
    types = dict(df.dtypes)
    return df.select(*[
        (F.round(col(c), special.get(c, digits)) + F.lit(0.0)).alias(c) if types[c] in ("double", "float")
        else col(c) for c in df.columns])


def R(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expr}, {digits}) + 0)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Number parsing as SQL.
NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def num(c: str) -> str:
    return f"(case when regexp_full_match(trim({c}), '{NUMBER}') then try_cast(trim({c}) as double) end)"


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


def each(columns: list[str], template: str) -> str:
    """One SELECT per column; ``{c}`` is the column."""
    return union([template.format(c=c) for c in columns])
