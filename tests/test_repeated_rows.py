"""Samples, splits and forests on repeated rows; JSON folders and encodings over all files."""

import pytest
from pyspark.sql import functions as F

from tablescope.operators.explore import plot_data, sample_rows
from tablescope.operators.learning.common import mark_split
from tablescope.operators.learning.isolation import tree_samples
from tablescope.options import Options
from tablescope.plans.runtime import number_copies
from tablescope.sources import tables


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, None)] * 2, "i int, s string")
    got = sorted((r.i, r._copy) for r in number_copies(df).collect())
    assert got == [(1, k) for k in range(1, 6)] + [(2, 1), (2, 2)]


def test_sample_holds_repeated_rows_in_their_share(spark):
    df = spark.range(20_000).selectExpr("id").union(spark.range(10_000).selectExpr("cast(-1 as bigint)"))
    got = sample_rows(df, 600, 1)
    assert got.count() == 600 and 140 <= got.where("id = -1").count() <= 260
    assert sorted(got.collect()) == sorted(sample_rows(df.repartition(7), 600, 1).collect())


def test_split_of_few_distinct_rows(spark):
    df = spark.range(3000).selectExpr("id % 3 as k", "cast(id % 3 as double) as x")
    share = mark_split(df, 0.2).agg(F.avg(F.col("is_train").cast("double"))).first()[0]
    assert 0.75 <= share <= 0.85


def test_every_tree_gets_its_rows(spark):
    df = spark.range(9000).selectExpr("cast(id % 3 as double) as x")
    opts = Options(isolation_trees=10, isolation_rows=64)
    trees = tree_samples(df, ["x"], 9000, opts).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("f0").alias("d")).collect()
    assert len(trees) == 10 and all(t.d == 3 and t.n >= 40 for t in trees)


def test_plot_statistics_use_all_rows(spark):
    df = spark.range(30_000).selectExpr("id as x", "cast(id as double) as y")
    total = plot_data(df, "x", "y", kind="histogram").groupBy("column").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in total} == {30_000}


@pytest.mark.parametrize("suffix", ["json", "jsonl"])
def test_json_folder_reads_back(spark, tmp_path, suffix):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as s").repartition(4)
    path = tables.write_table(df, str(tmp_path / f"x.{suffix}"), "json")
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_json_document_over_lines(spark, tmp_path):
    file = tmp_path / "y.json"
    file.write_text('[\n {"a": 1},\n {"a": 2}\n]\n')
    assert sorted(r.a for r in tables.read_table(spark, str(file)).collect()) == [1, 2]


def test_encoding_is_decided_by_the_last_bytes(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"name,n\n" + b"plain,1\n" * 200_000)
    (folder / "b.csv").write_bytes(b"name,n\nplain,1\n" + "결과,2\n".encode("cp949"))
    assert tables.detect_encoding(spark, str(folder)) == "cp949"
    (folder / "c.csv").write_bytes("name,n\n결과,2\n".encode())
    with pytest.raises(ValueError, match="different encodings"):
        tables.detect_encoding(spark, str(folder))
