"""Small inputs with results worked out by hand."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablescope.functions.exprs import is_number, parse_date, parse_number, sample_kurtosis, sample_skew
from tablescope.functions.text import client_key, dedup_lines
from tablescope.operators import encode, missing, outliers
from tablescope.operators.features import ratio_pairs, row_statistics
from tablescope.plans import roles as rl
from tablescope.sources import tables

MISSING = [(25.0, "VIP", 1000.0, None), (30.0, None, 2000.0, None), (None, "general", None, None),
           (35.0, "VIP", None, None), (40.0, None, 5000.0, None), (None, "general", 6000.0, None)]


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(MISSING, "age double, grade string, purchase double, all_missing string")


def test_imputation_advice(gaps):
    found = {r["column"]: (r["action"], round(r["ratio"], 4)) for r in missing.advise(gaps).collect()}
    assert found == {"age": ("fill_median", 0.3333), "grade": ("fill_mode", 0.3333),
                     "purchase": ("fill_median", 0.3333), "all_missing": ("drop_column", 1.0)}


def test_imputation(gaps):
    out, params = missing.handle_missing(gaps)
    assert out.columns == ["age", "grade", "purchase"]
    assert {r["column"]: r["value"] for r in params.collect()} == {
        "age": "32.5", "grade": "VIP", "purchase": "3500.0", "all_missing": None}
    assert out.where("age IS NULL OR grade IS NULL OR purchase IS NULL").count() == 0
    again = missing.apply_fills(gaps, params)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_unknown_fill_uses_default_and_order_is_needed(gaps):
    out, params = missing.handle_missing(gaps.select("age"), {"age": "no_such_method"})
    assert params.first()["method"] == "fill_median" and out.where("age IS NULL").count() == 0
    with pytest.raises(ValueError):
        missing.handle_missing(gaps, {"age": "forward_fill"})


def test_integer_column_widens_for_fractional_fill(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (4,), (5,), (4,)], "v int").where("v IS NULL OR v < 5")
    out, _ = missing.handle_missing(df, {"v": "fill_mean"})
    assert sorted(r["v"] for r in out.collect())[2] == pytest.approx(2.75)


@pytest.fixture
def planted(spark):
    rows = [(i, 40.0 + i % 21) for i in range(95)] + [(95 + i, v) for i, v in enumerate((200.0, 250.0, -50.0, 300.0, 350.0))]
    return spark.createDataFrame(rows, "id int, v double")


def test_planted_outliers(planted):
    row = outliers.detect_outliers(planted, columns=["v"]).first()
    assert row["n_outliers"] == 5 and row["ratio"] == pytest.approx(0.05)
    bounds = outliers.bounds_table(planted, ["v"], "iqr", 1.5)
    found = outliers.outlier_values(planted, bounds, ["id"])
    assert sorted(r["id"] for r in found.collect()) == [95, 96, 97, 98, 99]
    clipped = outliers.apply_outliers(planted, outliers.fit_outliers(planted))
    low, high = clipped.agg(F.min("v"), F.max("v")).first()
    assert row["lower"] <= low and high <= row["upper"]


@pytest.mark.parametrize("action", ["clip", "cap", "winsorize", "remove", "fill_median"])
def test_outlier_actions_keep_nulls(spark, planted, action):
    df = planted.unionByName(spark.createDataFrame([(100, None)], "id int, v double"))
    out = outliers.apply_outliers(df, outliers.fit_outliers(df, {"v": action}))
    assert out.where("id = 100").first()["v"] is None
    assert out.where("v >= 350").count() == 0


def test_zscore_bounds_of_constant_column(spark):
    df = spark.createDataFrame([(1.0,)] * 12, "v double")
    assert outliers.detect_outliers(df, "zscore").count() == 0


PEOPLE = [(i + 1, g, r, "MF"[i % 2]) for i, (g, r) in enumerate(zip(
    "VIP basic VIP new basic VIP basic VIP new basic".split(), "S B S D B S D S B D".split()))]


def test_encoder(spark):
    df = spark.createDataFrame(PEOPLE, "customer_id int, grade string, region string, gender string")
    assert rl.detect_categorical(df, 10) == ["customer_id", "grade", "region", "gender"]
    out, params = encode.encode(df)
    assert len(out.columns) == 17 and "gender" in out.columns
    codes = {r["category"]: r["code"] for r in params.where("column = 'gender'").collect()}
    assert codes == {"F": 0, "M": 1}
    assert encode.suggest(2) == "label" and encode.suggest(10) == "onehot" and encode.suggest(11) == "label"


def test_encoding_plan_forms(spark):
    df = spark.createDataFrame(PEOPLE, "customer_id int, grade string, region string, gender string")
    assert encode.encoding_plan(df, "label") == dict.fromkeys(df.columns, "label")
    assert encode.encoding_plan(df, ["grade", "nope"]) == {"grade": "onehot"}
    assert encode.encoding_plan(df, {"gender": "onehot", "nope": "label"}) == {"gender": "onehot"}


def test_label_nulls_and_unseen(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    df = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    params = encode.fit_encoding(fit, {"c": "label"})
    assert sorted(r["c"] is None for r in encode.apply_encoding(df, params).collect()) == [False, True, True]
    compat = [r["c"] for r in encode.apply_encoding(df, params, unseen=0).collect()]
    assert sorted(compat, key=lambda v: (v is None, v)) == [0, 1, None]


NUMBERS = [(" 12 ", 12.0), ("10d", None), ("1f", None), ("nan", None), ("inf", math.inf), ("-inf", -math.inf),
           ("1e3", 1000.0), ("0x10", None), ("1_000", None), ("+5", 5.0), ("", None), ("1,000", None),
           ("True", None), (".5", 0.5), ("5.", 5.0), (None, None)]


def test_numeric_strings(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(NUMBERS)], "i int, s string")
    got = {r["i"]: (r["v"], r["ok"]) for r in df.select("i", parse_number(F.col("s")).alias("v"),
                                                        is_number(F.col("s")).alias("ok")).collect()}
    assert got == {i: (v, v is not None) for i, (_, v) in enumerate(NUMBERS)}


def test_date_strings(spark):
    rows = ["2024-01-02 03:04:05", "2024-01-02", "20240102", "2021", "x", "2024-01-02T03:04:05",
            "2024-01-02 03:04:05.25", "2024/01/02", "2024-13-45"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    got = [r["d"] for r in df.select("i", parse_date(F.col("s")).alias("d")).orderBy("i").collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), datetime(2024, 1, 2), datetime(2021, 1, 1), None,
                   datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 250000), datetime(2024, 1, 2), None]


def test_shape_statistics_match_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.5, 9.0, 40.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    skew, kurt = df.agg(sample_skew(F.col("v")), sample_kurtosis(F.col("v"))).first()
    assert skew == pytest.approx(pd.Series(values).skew()) and kurt == pytest.approx(pd.Series(values).kurt())
    flat = spark.createDataFrame([(1.0,)] * 5, "v double").agg(sample_skew(F.col("v")), sample_kurtosis(F.col("v"))).first()
    assert tuple(flat) == (0.0, 0.0)
    few = df.limit(2).agg(sample_skew(F.col("v")), sample_kurtosis(F.col("v"))).first()
    assert tuple(few) == (None, None)


def test_line_dedup(spark):
    long = "same start of twenty-five chars "
    text = f"  first \n\n{long}A\n{long}B\nfirst\nlast\t"
    df = spark.createDataFrame([(text,), ("",), (None,), ("x" * 700,), ("\n".join(f"{i:03d} " + "y" * 60 for i in range(20)),)], "t string")
    got = [r["t"] for r in df.select(dedup_lines(F.col("t")).alias("t")).collect()]
    assert got[0] == f"first\n{long}A\nlast"
    assert got[1] == "" and got[2] == ""
    assert got[3] == "x" * 600 + "\n..."
    assert got[4].endswith("\n...") and got[4].count("\n") == 9


def test_client_key(spark):
    import hashlib

    df = spark.createDataFrame([(" 1.2.3.4 , 9.9.9.9", "5.5.5.5"), ("", "5.5.5.5"), (None, None)], "f string, a string")
    want = [hashlib.sha256(s.encode()).hexdigest()[:32] for s in ("1.2.3.4", "5.5.5.5", "unknown")]
    assert [r["k"] for r in df.select(client_key(F.col("f"), F.col("a")).alias("k")).collect()] == want


def test_names():
    assert rl.clean_names([" a b ", "a.b", "A_B", "x-y!", "a_b_0"]) == ["a_b_1", "a_b_2", "A_B_3", "x_y", "a_b_0"]
    assert rl.find_column(["Reading_Time", "Value", "my_val"], ("value", "val")) == "Value"
    assert rl.find_column(["tag", "x"], ("value",)) is None
    assert ratio_pairs(["amount", "price", "total", "count"]) == [("amount", "price"), ("count", "total")]


def test_row_statistics_with_gaps(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, None, None)], "a double, b double, c double")
    got = [tuple(r)[3:] for r in row_statistics(df, ["a", "b", "c"]).collect()]
    assert got[0] == pytest.approx((2.0, math.sqrt(2.0), 3.0, 1.0, 2.0))
    assert got[1] == (None,) * 5
    assert got[2] == (2.0, None, 2.0, 2.0, 0.0)
    assert row_statistics(df, ["a", "b"]).columns == df.columns


def test_csv_round_trip(spark, tmp_path):
    rows = [(i, 20 + i % 50, 1000 + i * 37) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "customer_id int, age int, purchase int")
    path = tables.write_table(df, str(tmp_path / "t.csv"), "csv")
    back = tables.read_table(spark, path)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == rows


def test_csv_keeps_quotes_and_reads_empty_text_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, ""), (3, None)], "i int, s string")
    path = tables.write_table(df, str(tmp_path / "q.csv"), "csv")
    back = tables.read_table(spark, path, schema=df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, 'say "hi", ok'), (2, None), (3, None)]


@pytest.mark.parametrize("encoding", ["utf-8", "cp949", "latin1"])
def test_encodings(spark, tmp_path, encoding):
    word = "café ÿþ" if encoding == "latin1" else "결과"
    file = tmp_path / f"{encoding}.csv"
    file.write_bytes(f"name,n\n{word},1\n".encode(encoding))
    assert tables.detect_encoding(spark, str(file)) == encoding
    row = tables.read_table(spark, str(file)).first()
    assert row["name"] == word and row["n"] == 1


def test_source_guard(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.exe").write_text("a")
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.exe"))
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert tables.read_table(spark, str(tmp_path / "a.json")).count() == 2
