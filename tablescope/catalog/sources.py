"""Scans and sinks."""

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablescope.catalog.base import R, fixture, query, rounded, scratch, table, with_fixture
from tablescope.operators.features import features
from tablescope.operators.learning.common import assemble
from tablescope.operators.missing import apply_fills, fit_fills
from tablescope.plans.roles import detect
from tablescope.sources import models, tables


@query("S1_csv_scan", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_scan(spark, d):
    src = table(spark, d, "customer")
    path = tables.write_table(src, scratch(spark, "customer") + ".csv", "csv")
    return tables.read_table(spark, path, schema=src.schema)


@query("S1_csv_scan_inferred",
       "select cast(c_nationkey as int) as c_nationkey, count(*) as n, "
       f"{R('sum(c_acctbal)', 2)} as balance from customer group by 1")
def csv_inferred(spark, d):
    path = tables.write_table(table(spark, d, "customer"), scratch(spark, "customer") + ".csv", "csv")
    got = tables.read_table(spark, path).groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))
    return rounded(got, 2)


@query("S2_json_scan", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def json_scan(spark, d):
    src = table(spark, d, "part")
    path = tables.write_table(src, scratch(spark, "part") + ".jsonl", "json")
    return tables.read_table(spark, path, schema=src.schema)


@query("S3_parquet_scan", "select event_type, count(*) as n, min(ts) as first_ts from events group by 1")
def parquet_scan(spark, d):
    return tables.read_table(spark, f"{d}/events.parquet").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("S3_tsv_scan", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def tsv_scan(spark, d):
    src = table(spark, d, "supplier")
    path = tables.write_table(src, scratch(spark, "supplier") + ".tsv", "tsv")
    return tables.read_table(spark, path, schema=src.schema)


@query("S4_format_dispatch",
       "select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def dispatch(spark, d):
    return tables.read_table(spark, f"{d}/lineitem.parquet").where("l_quantity > 45").select(
        "l_orderkey", "l_quantity")


@query("S5_encoding", "select doc_id, lang, cast(length(regexp_replace(text, '[\\r\\n\\t]', ' ', 'g')) as bigint) "
       "as n_chars, md5(regexp_replace(text, '[\\r\\n\\t]', ' ', 'g')) as digest from documents")
def encoding(spark, d):
    src = table(spark, d, "documents").select(
        "doc_id", "lang", F.regexp_replace("text", r"[\r\n\t]", " ").alias("text"))
    path = tables.write_table(src, scratch(spark, "documents") + ".csv", "csv")
    found = tables.detect_encoding(spark, path)
    got = tables.read_table(spark, path, encoding=found, schema=src.schema)
    return got.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("S6_file_info")
def info(spark, d):
    return tables.file_info(spark, d)


@query("S7_bounded_scan")
def bounded(spark, d):
    from tablescope.operators.explore import first_rows
    return first_rows(table(spark, d, "lineitem"))


@query("S8_feature_sink", "select count(*) as n, count(distinct c_custkey) as keys from customer")
def feature_sink(spark, d):
    df = table(spark, d, "customer")
    made, _ = features(df, detect(df))
    path = tables.write_features(made, scratch(spark, "out"), "customer")
    return tables.read_table(spark, path).agg(F.count(F.lit(1)).alias("n"),
                                              F.countDistinct("c_custkey").alias("keys"))


@query("S9_table_sink", with_fixture("segment_gaps", "select c_custkey, segment, balance from t"))
def sink(spark, d):
    src = fixture(spark, d, "segment_gaps").select("c_custkey", "segment", "balance")
    path = tables.write_table(src, scratch(spark, "segment") + ".jsonl", "json")
    return tables.read_table(spark, path, schema=src.schema)


@query("S10_model_files",
       "select l_returnflag, count(*) as n from lineitem group by 1")
def model_files(spark, d):
    data = assemble(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    model = LinearRegression(labelCol="l_extendedprice").fit(data)
    path = scratch(spark, "model")
    models.save_model(model, path, {"target": "l_extendedprice"})
    loaded, meta = models.load_model(spark, path)
    scored = loaded.transform(data).where(F.col("prediction").isNotNull())
    assert meta["target"] == "l_extendedprice"
    return scored.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("S11_stage_files", "select count(*) as n from lineitem")
def stage_files(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    path = scratch(spark, "stages")
    models.save_stages([VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features"),
                        LinearRegression(labelCol="l_extendedprice")], path)
    data = table(spark, d, "lineitem")
    scored = Pipeline(stages=models.load_stages(path)).fit(data).transform(data)
    return scored.agg(F.count("prediction").alias("n"))


@query("S12_params_files", with_fixture("segment_gaps",
       f"select c_custkey, {R('coalesce(balance, (select quantile_cont(balance, 0.5) from t))', 4)} as balance from t"))
def params_files(spark, d):
    df = fixture(spark, d, "segment_gaps").select("c_custkey", "balance")
    path = scratch(spark, "params")
    models.save_params(fit_fills(df, {"balance": "fill_median"}), path)
    return rounded(apply_fills(df, models.load_params(spark, path)), 4)


@query("S13_chunk_union", "select o_orderkey, o_custkey, o_totalprice from orders")
def chunk_union(spark, d):
    src = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    odd, even = scratch(spark, "odd") + ".parquet", scratch(spark, "even") + ".parquet"
    tables.write_table(src.where("o_orderkey % 2 = 1"), odd, "parquet")
    tables.write_table(src.where("o_orderkey % 2 = 0"), even, "parquet")
    return tables.read_table(spark, [odd, even])
