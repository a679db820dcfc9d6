"""Properties of the learning operators."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators.learning import association, binned, clusters, forecast, isolation, supervised
from tablescope.operators.learning.common import (accuracy_and_f1, assemble, class_metrics, confusion, mark_split,
                                                  standardize, spread)
from tablescope.options import Options
from tablescope.plans import roles as rl
from tablescope.plans.analyze import analyze, run_analysis

FAST = replace(Options(), trees=8, boosting_rounds=4, forest_depth=4, kmeans_restarts=1, isolation_trees=40, isolation_rows=64)


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id") * 7919 % 1000 / 100.0
    z = F.col("id") * 104729 % 997 / 100.0
    noise = (F.col("id") * 31 % 17) / 100.0
    return spark.range(600).select("id", x.alias("x"), z.alias("z"), (3 * x - 2 * z + noise).alias("y"),
                                   F.when(x + z > 12, "b").when(x > 7, "c").otherwise("a").alias("kind"))


def test_ridge_matches_closed_form(rows):
    data = rows.select("x", "z", "y").toPandas()
    n = len(data)
    model = supervised.regressors(n, data["y"].std(ddof=0))["Ridge Regression"].fit(
        assemble(rows, ["x", "z"]).withColumn("label", F.col("y")))
    X = data[["x", "z"]].to_numpy()
    Xc, yc = X - X.mean(0), data["y"].to_numpy() - data["y"].mean()
    want = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-7)


def test_regression(rows):
    found = supervised.regression(rows, ["y", "x", "z"], opts=FAST)
    assert found.success and found.target == "y" and found.feature_columns == ("x", "z")
    table = {(r["model"], r["metric"]): r["value"] for r in found.metrics.collect()}
    assert len(table) == 12
    assert table[("Linear Regression", "r2")] > 0.999
    assert table[(found.model_name, "r2")] == max(v for (m, k), v in table.items() if k == "r2")
    assert found.predictions.count() == 120
    assert {r["rule"] for r in found.recommendations.collect()} == {"high_r2", "retrain", "top_feature"}
    assert sum(r["n"] for r in found.tables["residual_histogram"].collect()) == 120


@pytest.mark.parametrize("target,classes", [("kind", 3), ("side", 2)])
def test_classification(rows, target, classes):
    df = rows.withColumn("side", F.when(F.col("kind") == "a", "left").otherwise("right"))
    found = supervised.classification(df, ["x", "z"], target, opts=FAST)
    table = {(r["model"], r["metric"]): r["value"] for r in found.metrics.collect()}
    assert len(table) == 6 and all(0 <= v <= 1 for v in table.values())
    assert table[(found.model_name, "f1")] > 0.8
    matrix = found.tables["confusion"]
    assert matrix.select("actual").distinct().count() == classes
    assert len(found.importances.collect()) == 2


def test_f1_matches_hand_count(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(1.0, 0.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    accuracy, f1 = accuracy_and_f1(confusion(df), 2)
    assert accuracy == pytest.approx(8 / 11) and f1 == pytest.approx(2 * 0.6 * 0.75 / 1.35)
    lost = spark.createDataFrame([(0.0, 1.0)], "label double, prediction double")
    assert [r["f1"] for r in class_metrics(confusion(lost)).collect()] == [0.0, 0.0]


def test_splits_are_exact_and_repeatable(rows):
    marked = mark_split(rows, 0.2, "kind", ["id"])
    share = marked.groupBy("kind").agg(F.avg(F.col("is_train").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 0.8) <= 1.0 / r["n"] + 1e-9 for r in share)
    again = mark_split(rows.repartition(3), 0.2, "kind", ["id"])
    assert marked.select("id", "is_train").exceptAll(again.select("id", "is_train")).count() == 0


def test_standardize_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(map(tuple, standardize(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    c = F.col("id") % 3
    jitter = lambda k: (F.col("id") * k % 13) / 20.0
    return spark.range(150).select("id", (c * 10 + jitter(7)).alias("a"), (c * c * 6 + jitter(5)).alias("b"), c.alias("truth"))


def test_clustering_finds_blobs(blobs):
    found = clusters.clustering(blobs, ["a", "b"], ["id", "truth"], FAST)
    table = {r["metric"]: r["value"] for r in found.metrics.collect()}
    assert table["k"] == 3 and 0.8 < table["silhouette"] <= 1 and 0 < table["davies_bouldin"] < 0.5
    pairs = found.predictions.select("truth", "cluster").distinct().count()
    assert pairs == 3 and found.tables["curve"].count() == 7
    assert sum(r["n"] for r in found.tables["profile"].collect()) == 150
    assert clusters.quick_clusters(blobs, ["a", "b"], FAST).select("cluster").distinct().count() in (2, 3)


def test_principal_components(rows):
    shares = [r["explained_pct"] for r in clusters.explained_variance(rows, ["x", "z", "y"]).collect()]
    data = rows.select("x", "z", "y").toPandas()
    want = np.sort(np.linalg.eigvalsh(data.corr().to_numpy()))[::-1] / 3 * 100
    assert shares == pytest.approx(list(want), abs=1e-6)
    table = clusters.loadings(rows, ["x", "z", "y"])
    assert table.where("rank = 1 AND loading <= 0").count() == 0
    assert clusters.principal_coordinates(rows, ["x", "z"], ["id"]).count() == 600


def test_isolation_ranks_planted_rows_first(spark):
    base = spark.range(500).select("id", (F.col("id") * 7 % 50 / 10.0).alias("a"), (F.col("id") * 11 % 50 / 10.0).alias("b"))
    odd = spark.createDataFrame([(1000 + i, 30.0 + i, -20.0 - i) for i in range(4)], "id bigint, a double, b double")
    df = base.unionByName(odd)
    found = isolation.anomaly(df, ["a", "b"], ["id"], FAST)
    worst = [r["id"] for r in found.predictions.orderBy("score").limit(4).collect()]
    assert sorted(worst) == [1000, 1001, 1002, 1003]
    table = {r["metric"]: r["value"] for r in found.metrics.collect()}
    assert abs(table["anomalies"] - round(504 * table["contamination"])) <= 1
    low, high = found.predictions.agg(F.min("score"), F.max("score")).first()
    assert -1 <= low < high < 0
    again = isolation.anomaly(df.repartition(5), ["a", "b"], ["id"], FAST)
    assert found.predictions.select("id", "score").exceptAll(again.predictions.select("id", "score")).count() == 0
    per = isolation.column_anomalies(df, 0.1, FAST, ["a"]).first()
    assert 0 < per["ratio"] <= 0.11


def test_isolation_samples(spark):
    few = isolation.tree_samples(spark.range(100).selectExpr("id as a"), ["a"], 100, FAST).groupBy("tree").count()
    assert few.count() == 40 and few.agg(F.min("count")).first()[0] >= 60
    many = isolation.tree_samples(spark.range(40_000).selectExpr("id as a"), ["a"], 40_000, FAST)
    assert many.count() == 40 * 64 and many.select("tree").distinct().count() == 40


def test_association_matches_brute_force(spark, lineitem):
    from itertools import combinations

    df = lineitem.select("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).alias("l"))
    sets = association.frequent_itemsets(df, df.columns, 0.1)
    got = {tuple(sorted(r["items"])): r["n"] for r in sets.collect()}
    want: dict = {}
    data = [sorted(f"{c}={r[c]}" for c in df.columns) for r in df.collect()]
    for row in data:
        for k in (1, 2, 3):
            for items in combinations(row, k):
                want[items] = want.get(items, 0) + 1
    assert got == {k: v for k, v in want.items() if v >= 0.1 * len(data)}
    rules = association.association_rules(sets, 0.0)
    assert rules.where("size(antecedent) = 0 OR size(consequent) = 0 OR confidence > 1").count() == 0
    n = len(data)
    r = rules.first()
    union = tuple(sorted([*r["antecedent"], *r["consequent"]]))
    assert r["support"] == pytest.approx(want[union] / n)
    assert r["confidence"] == pytest.approx(want[union] / want[tuple(sorted(r["antecedent"]))])


def test_terciles_skip_colliding_edges(spark):
    df = spark.createDataFrame([(1, 1.0)] * 8 + [(i, 2.0) for i in range(9)], "a int, b double")
    assert association.terciles(df, ["a", "b"]).columns == ["a", "b"] or "b_bin" not in association.terciles(df, ["a", "b"]).columns


@pytest.fixture(scope="module")
def series(spark):
    day = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int))")
    return spark.range(120).select(day.alias("ts"), (10 + F.col("id") * 0.5 + (F.col("id") % 7)).alias("v"))


def test_forecast_continues_a_regular_series(series):
    found = forecast.forecast(series, "ts", "v", opts=FAST)
    assert found.success and found.model_name == "Linear Regression"
    future = found.tables["future"].orderBy("step").collect()
    want = [10 + i * 0.5 + i % 7 for i in range(120, 127)]
    assert [r["prediction"] for r in future] == pytest.approx(want, rel=1e-3)
    assert future[0]["at"].strftime("%Y-%m-%d") == "2024-04-30"
    assert found.predictions.count() == 22  # 106 complete rows, floor(0.8 * 106) = 84 for training


def test_forecast_compat_repeats_the_last_row(series):
    found = forecast.forecast(series, "ts", "v", compat=True, opts=FAST)
    steps = [r["prediction"] for r in found.tables["future"].orderBy("step").collect()]
    assert len(steps) == 7 and steps[0] == pytest.approx(10 + 119 * 0.5 + 119 % 7, rel=1e-3)


def test_too_small_or_unusable_inputs_fail_softly(spark, rows, series):
    roles = rl.Roles("wide_table", 1.0, numeric=("x",))
    small = rows.limit(10)
    for kind in ("regression", "classification", "clustering", "anomaly", "timeseries", "association", "nonsense"):
        found = run_analysis(small, roles, kind, opts=FAST)
        assert not found.success and found.error
    assert not forecast.forecast(series.limit(20), "ts", "v", opts=FAST).success


def test_analyze_wide_table(spark, rows, tmp_path):
    steps = []
    report = analyze(spark, rows, FAST, out_dir=str(tmp_path), name="rows", progress=steps.append)
    assert "_errors" not in report.tables
    assert {"correlation", "clusters", "importance", "loadings", "describe"} <= set(report.tables)
    assert report.roles.shape == "wide_table" and "_row_mean" in report.cleaned.columns
    assert report.saved_to and spark.read.option("header", True).csv(report.saved_to).count() == 600
    assert report.card.first()["n_rows"] == 600 and steps[0] == "load" and steps[-1] == "save"
    found = run_analysis(report.cleaned, report.roles, "classification", opts=FAST)
    assert found.success and found.target == "kind"


def test_analyze_signal_pool(spark):
    from conftest import SF

    from tablescope.catalog.base import fixture

    report = analyze(spark, fixture(spark, SF, "signal_pool"), FAST, order=["timestamp", "event_id"])
    assert "_errors" not in report.tables, report.tables["_errors"].collect()
    assert report.roles.shape == "signal_pool" and report.roles.value_num == "value_num"
    assert {"time_series", "timeline", "describe", "histogram"} <= set(report.tables)
    assert {"sig_mean", "value_num_lag1", "timestamp_is_weekend"} <= set(report.cleaned.columns)


# ------------------------------------------------------------- forecast per series
def many_series(spark):
    """Lines, a wave, a constant, a short series, tied stamps and gaps."""
    rows = [("line", i, 3.0 + 2.0 * i) for i in range(60)] + [("down", i, 1e6 - 0.5 * i) for i in range(90)] + [("flat", i, 7.0) for i in range(50)]
    rows += [("wave", i, float(np.sin(i / 3.0)) + i * 0.01) for i in range(200)] + [("short", i, float(i)) for i in range(25)]
    rows += [("line", 5, None), (None, 1, 1.0), ("tied", 3, 1.0), ("tied", 3, 2.0)]
    return spark.createDataFrame(rows, "signal string, day int, value double").withColumn("at", F.expr("timestamp '2024-01-01' + make_dt_interval(day)"))


def test_forecast_per_series(spark):
    from tablescope.operators.learning.series_forecast import forecast_each

    df = many_series(spark)
    small = replace(Options(), block_rows=40, broadcast_rows=1)
    for opts in (Options(), small):
        found = forecast_each(df, "at", "value", ["signal"], steps=5, opts=opts)
        future = {(r["signal"], r["step"]): r["prediction"] for r in found.tables["future"].collect()}
        assert {s for s, _ in future} == {"line", "down", "flat", "wave"}
        for k in range(1, 6):
            assert future["line", k] == pytest.approx(3.0 + 2.0 * (59 + k), rel=1e-6)
            assert future["down", k] == pytest.approx(1e6 - 0.5 * (89 + k), rel=1e-9)
            assert future["flat", k] == pytest.approx(7.0)
            assert abs(future["wave", k] - (np.sin((199 + k) / 3.0) + (199 + k) * 0.01)) < 0.1
        assert {r["signal"]: r["rows"] for r in found.tables["skipped"].collect()} == {"short": 25, "tied": 2}
        metrics = {r["signal"]: r for r in found.metrics.collect()}
        assert metrics["line"]["rows"] == 46 and metrics["line"]["train_rows"] == 36 and metrics["wave"]["r2"] > 0.99


def test_series_weights_are_least_squares(spark):
    """Against numpy on the same features."""
    from tablescope.operators.learning.series_forecast import forecast_each
    from tablescope.operators.windows import forecast_feature_names, forecast_features

    rng = np.random.default_rng(5)
    rows = [(s, i, float(x)) for s in ("a", "b") for i, x in enumerate(rng.normal(size=150).cumsum())]
    df = spark.createDataFrame(rows, "signal string, day int, value double").withColumn("at", F.expr("timestamp '2024-01-01' + make_dt_interval(day)"))
    scored = {(r["signal"], r["at"]): r["predicted"] for r in forecast_each(df, "at", "value", ["signal"]).predictions.collect()}
    names = forecast_feature_names()
    for s in ("a", "b"):
        made = forecast_features(df.where(F.col("signal") == s), "at", "value").toPandas().sort_values("at")
        x, y = np.c_[made[names].to_numpy(float), np.ones(len(made))], made["value"].to_numpy()
        cut = int(len(made) * 0.8)
        w = np.linalg.lstsq(x[:cut], y[:cut], rcond=None)[0]
        for at, p in zip(made["at"][cut:], x[cut:] @ w):
            assert scored[s, at.to_pydatetime()] == pytest.approx(p, abs=1e-4)


def test_forecast_each_says_why(spark):
    from tablescope.operators.learning.series_forecast import forecast_each

    df = many_series(spark)
    for args in (("day", "value", ["signal"]), ("at", "none", ["signal"]), ("at", "value", [])):
        assert not forecast_each(df, *args).success
    assert not forecast_each(df.where("signal = 'short'"), "at", "value", ["signal"]).success
    assert not forecast_each(df.limit(0), "at", "value", ["signal"]).success


def test_association_goes_on_until_pairs(spark):
    rows = [(i % 3, i % 7 % 3, i % 11 % 3) for i in range(300)]
    df = spark.createDataFrame([(f"a{a}", f"b{b}", f"c{c}") for a, b, c in rows], "a string, b string, c string")
    plain = association.association(df, ["a", "b", "c"], [])
    assert not plain.success and "no rules" in plain.error
    assert association.association(df, ["a", "b", "c"], [], until_pairs=True).success


def test_one_decomposition_serves_all_views(spark, lineitem, tmp_path):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
    fitted = clusters.decompose(lineitem, names)
    values, vectors = np.linalg.eigh(np.corrcoef(lineitem.select(*names).toPandas().to_numpy(float).T))
    shares, vectors = tuple(values[::-1] / values.sum()), vectors[:, ::-1]
    assert fitted.shares == pytest.approx(shares, abs=1e-9)
    assert np.abs(np.array(fitted.weights)) == pytest.approx(np.abs(vectors), abs=1e-6)
    fitted.as_params(spark).write.parquet(str(tmp_path / "c"))
    again = clusters.Components.from_params(spark.read.parquet(str(tmp_path / "c")))
    assert again == fitted
    assert [r["explained_pct"] for r in clusters.explained_variance(lineitem, names, 3, fitted=again).collect()] == pytest.approx([100 * x for x in shares[:3]])
    best = [r for r in clusters.loadings(lineitem, names, 5, fitted=again).collect() if r["rank"] == 1]
    assert len(best) == 5 and all(r["loading"] > 0 for r in best)
    assert clusters.principal_coordinates(lineitem, names, ["l_orderkey"], fitted=again).count() == lineitem.count()


# -------------------------------------------------------------- alerts on streams
def test_alert_history_survives_restarts_and_late_rows(spark, tmp_path):
    from tablescope.streaming import live

    rng = np.random.default_rng(8)
    rows = [(s, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:{m:02d}:00", float(rng.normal()) + (40.0 if i == 70 and m == 5 and s == "a" else 0.0))
            for i in range(96) for m in (5, 25, 45) for s in ("a", "b", None)]
    df = spark.createDataFrame(rows, "signal string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    folder, schema = str(tmp_path), df.schema
    key = lambda out: sorted((str(r["signal"]), str(r["window_start"]), r["past_n"], round(r["past_mean"] or 0, 9), round(r["past_std"] or 0, 9)) for r in out.collect())
    parts = [df.where("ts < '2024-01-02 12:00:00'"), df.where("ts >= '2024-01-02 12:00:00' and ts < '2024-01-04'"), df.where("ts >= '2024-01-04'")]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if i == 2:  # a row behind the watermark is dropped
            spark.createDataFrame([("a", None, 1e9)], "signal string, ts timestamp, value double").withColumn("ts", F.expr("timestamp '2024-01-01 00:30:00'")) \
                .write.mode("append").parquet(f"{folder}/in")
        stats = live.window_stats(spark.readStream.schema(schema).parquet(f"{folder}/in"), "signal", "ts", "value")
        live.run_to_folder(stats, f"{folder}/stats", f"{folder}/s1").awaitTermination()
        closed = spark.readStream.schema(stats.schema).parquet(f"{folder}/stats")
        live.run_to_folder(live.with_history(closed, "signal"), f"{folder}/out", f"{folder}/s2").awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    want = live.with_history(live.window_stats(df, "signal", "ts", "value"), "signal")
    last = got.agg(F.max("window_start")).first()[0]
    assert key(got) == key(want.where(F.col("window_start") <= F.lit(last))) and got.count() > 250
    alerts = live.history_alerts(live.window_stats(df, "signal", "ts", "value"), "signal", 6.0)
    assert [(r["signal"], str(r["window_start"])) for r in alerts.collect()] == [("a", "2024-01-03 22:00:00")]


# ------------------------------------------------------------------ repeatable fits
def test_fits_do_not_depend_on_the_layout(spark, lineitem):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    df = lineitem.select(*names)
    ready = lambda d: spread(clusters._scaled(d, names), 6_000)
    centres = lambda d: np.array(clusters.best_kmeans(ready(d), 3, 1, 10, 42).clusterCenters())
    a, b = centres(df.repartition(3)), centres(df.orderBy("l_discount").coalesce(1))
    assert a.shape == b.shape and np.allclose(a, b)


def test_planted_groups_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(5 * (i % 3)) + float(x), float(-7 * (i % 3)) + float(y)) for i, (x, y) in enumerate(rng.normal(scale=0.1, size=(300, 2)))]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    found = clusters.clustering(df, ["x", "y"], ["i"])
    assert found.model.summary.k == 3
    groups = {}
    for r in found.predictions.collect():
        groups.setdefault(r["cluster"], set()).add(r["i"] % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]


def test_binned_density_is_near_the_exact_one(spark):
    from tablescope.operators import explore

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x), float(x) ** 3) for x in rng.normal(size=3000)] + [(None, 1e4)], "v double, w double")
    exact, binned = (sorted(map(tuple, explore.density(df, ["v", "w"], exact_values=k).collect())) for k in (10**6, 10))
    assert [x[:2] for x in exact] == [x[:2] for x in binned] and len(exact) == 400
    for column in ("v", "w"):
        a, b = (np.array([x[3] for x in rows if x[0] == column]) for rows in (exact, binned))
        assert np.abs(a - b).max() < 1e-5 * a.max()


def test_too_many_classes_fail_before_a_list_is_made(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.concat(F.lit("class"), "id").alias("target"))
    found = supervised.classification(df, ["x", "y"], "target")
    assert not found.success and "more than 1000 classes" in found.error
    with pytest.raises(ValueError, match="classes"):
        supervised.forest_importance(df, ["x", "y"], "target")


def test_class_numbers_go_by_the_alphabet(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "k string")
    assert list(supervised.class_indexer(df, "k", 3).labels) == ["a", "b", "c"]


def test_forests_keep_no_node_ids_and_large_fits_take_few_tasks(spark):
    from tablescope.operators.learning.common import spread

    for learner in [*supervised.regressors(100, 1.0).values(), *supervised.classifiers(100, 2).values()]:
        assert not (learner.hasParam("cacheNodeIds") and learner.getOrDefault("cacheNodeIds"))
    assert spread(spark.range(100).toDF("x"), 36_000_000).rdd.getNumPartitions() == 24


def test_fits_on_few_classes_deal_rows_evenly_and_keep_like_rows_together(spark, monkeypatch):
    x = F.xxhash64("id") % 997 / 10.0
    df = spark.range(40_000).select("id", x.alias("x"), (F.col("id") % 3).cast("double").alias("few"),
                                    F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("kind"))
    parts = []

    def fit(self, data):
        parts[:] = [[tuple(r["features"]) for r in p] for p in data.rdd.glom().collect()]
        raise InterruptedError

    for name, learner in [("RandomForestClassifier", lambda: supervised.forest_importance(df, ["x", "few"], "kind")),
                          ("LogisticRegression", lambda: supervised.classification(df, ["x", "few"], "kind", ["id"], FAST)),
                          ("LinearRegression", lambda: supervised.regression(df, ["few", "x"], "few", ["id"], FAST))]:
        monkeypatch.setattr(getattr(supervised, name), "fit", fit)
        with pytest.raises(InterruptedError):
            learner()
        assert len(parts) == 8 and max(map(len, parts)) < 1.5 * sum(map(len, parts)) / 8
        assert all(p == sorted(p, key=lambda v: v[::-1]) for p in parts)


def test_large_forests_are_fitted_in_groups_of_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(supervised, "GROUPED_ROWS", 100)
    monkeypatch.setattr(supervised, "TREES_PER_FIT", 3)
    sizes = []
    for learner in (supervised.RandomForestClassifier, supervised.RandomForestRegressor):
        fit = learner.fit
        monkeypatch.setattr(learner, "fit", lambda self, data, fit=fit: (sizes.append(self.getNumTrees()), fit(self, data))[1])
    found = supervised.classification(rows, ["x", "z"], "kind", opts=FAST)
    assert sizes == [3, 3, 2]
    table = {(r["model"], r["metric"]): r["value"] for r in found.metrics.collect()}
    assert len(table) == 6 and table[("Random Forest", "f1")] > 0.8
    data = assemble(rows, ["x", "z"]).withColumn("label", (F.col("x") > 5).cast("double") + (F.col("z") > 5).cast("double"))
    for learner in (supervised.classifiers(600, 3, FAST), supervised.regressors(600, 1.0, FAST)):
        model = supervised.fit_model(learner["Random Forest"], data, 600)
        assert len(model.trees) == 8 and len({t.toDebugString for t in model.trees}) > 4
        assert sum(model.featureImportances.toArray()) == pytest.approx(1.0)
        seen = model.transform(data)
        assert seen.columns == [*data.columns, "prediction"]
        for r in seen.limit(20).collect():
            if hasattr(model.stages[0], "numClasses"):
                votes = sum(part.predictRaw(r["features"]).toArray() for part in model.stages)
                assert r["prediction"] == votes.argmax()
            else:
                assert r["prediction"] == pytest.approx(np.mean([t.predict(r["features"]) for t in model.trees]))


def test_rows_of_tree_fits_are_sorted_by_computed_values(spark):
    df = assemble(spark.range(20_000).select(F.col("id").cast("double").alias("x")), ["x"]).select("features")
    plan = spread(df, 20_000, [0])._jdf.queryExecution().optimizedPlan().toString()
    sort = next(line for line in plan.splitlines() if "Sort [" in line)
    assert "UDF" not in sort and "_values" in sort
    assert spread(df, 2_000_000, [0]).rdd.getNumPartitions() == 12 and spread(df, 2_000_000).rdd.getNumPartitions() == 8


def test_trees_on_few_inputs_are_fitted_on_cells(spark, monkeypatch):
    df = spark.range(30_000).select("id", (F.xxhash64("id") % 1000 / 10.0).alias("x"))
    df = df.withColumn("y", F.sin(F.col("x") / 15) * 10 + F.xxhash64("id", F.lit(3)) % 100 / 100.0)
    opts = replace(FAST, trees=6, boosting_rounds=12, forest_depth=6)
    data = assemble(df, ["x"]).select("features", F.col("y").alias("label")).repartition(4, "features").cache()
    learners = supervised.regressors(30_000, 1.0, opts)
    assert supervised.on_cells(learners, data, 30_000, 1) == {}
    monkeypatch.setattr(supervised, "CELL_ROWS", 10_000)
    assert supervised.on_cells(learners, data, 30_000, 3) == {}
    found = supervised.on_cells(learners, data, 30_000, 1)
    assert set(found) == {"Random Forest", "Gradient Boosting"}
    for name, model in found.items():
        assert len(model.cuts[0]) == 31 and len(model.values) == 32
        ours, theirs = (supervised.regression_metrics(m.transform(data)).first() for m in (model, learners[name].fit(data)))
        assert ours["rmse"] == pytest.approx(theirs["rmse"], rel=0.03) and ours["r2"] > 0.9
    # boosting on cells is boosting on rows whose features are their cells'
    cells = assemble(supervised.with_cell(data, found["Random Forest"].cuts).drop("features").withColumnRenamed("cell", "x"), ["x"])
    want = learners["Gradient Boosting"].fit(cells).transform(cells).groupBy("x").agg(F.first("prediction")).orderBy("x").collect()
    assert [r[1] for r in want] == pytest.approx(found["Gradient Boosting"].values, rel=1e-6)
    # the draws of all trees: the weight of all rows, nearly, and other sums for each tree
    drawn = supervised.cell_draws(data, found["Random Forest"].cuts, 6, 42).groupBy("tree").agg(F.sum("weight").alias("w")).collect()
    weights = {r["tree"]: r["w"] for r in drawn}
    assert weights.pop(-1) == 30_000 and len(set(weights.values())) > 3
    assert all(abs(w - 30_000) < 900 for w in weights.values())
    whole = supervised.regression(df, ["x"], "y", ["id"], opts)
    assert whole.predictions.count() == 6_000 and len(whole.metrics.collect()) == 12


def _grid(spark, n=4_000):
    """Two inputs of 16 values, a noisy label and a class of three; every value is as frequent as the others."""
    df = spark.range(0, n, 1, 3).select((F.col("id") % 16).cast("double").alias("a"), F.floor(F.col("id") / 16 % 16).cast("double").alias("b"), "id")
    df = df.withColumn("y", F.col("a") * F.col("b") + F.pmod(F.xxhash64("id"), F.lit(40))).withColumn(
        "kind", F.pmod(F.floor(F.col("a") / 5) + F.floor(F.col("b") / 9) + F.when(F.col("id") % 7 == 0, 1).otherwise(0), F.lit(3)).cast("double"))
    return assemble(df, ["a", "b"]).persist()


def test_trees_on_binned_rows_equal_spark_trees(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor

    monkeypatch.setattr(supervised, "CELL_ROWS", 1_000)
    monkeypatch.setattr(binned, "BLOCK_ROWS", 300)
    monkeypatch.setattr(binned, "SUM_BYTES", 1)  # a job for each tree
    monkeypatch.setattr(binned, "DRAWS", np.ones(65_536, np.uint8))
    monkeypatch.setattr(binned, "MOST_COUNTS", 0)
    monkeypatch.setattr(binned, "per_node", lambda width, trees, classes: width)
    base = _grid(spark)
    seen = lambda model, data: [r[0] for r in model.transform(data).orderBy("id").select("prediction").collect()]
    data = base.withColumn("label", F.col("y"))
    learners = {"f": supervised.RandomForestRegressor(numTrees=2, maxDepth=5, seed=3), "g": GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.1)}
    found = supervised.on_bins(learners, data, 4_000, 2)
    for name, model in (("f", DecisionTreeRegressor(maxDepth=5).fit(data)), ("g", learners["g"].fit(data))):
        assert seen(found[name], data) == pytest.approx(seen(model, data), abs=1e-6)
        assert list(found[name].featureImportances) == pytest.approx(list(model.featureImportances), abs=1e-6)
    data = base.withColumn("label", F.col("kind"))
    forest = supervised.on_bins({"f": supervised.RandomForestClassifier(numTrees=2, maxDepth=5, seed=3)}, data, 4_000, 2, 3)["f"]
    model = DecisionTreeClassifier(maxDepth=5).fit(data)
    assert seen(forest, data) == seen(model, data)
    assert list(forest.featureImportances) == pytest.approx(list(model.featureImportances), abs=1e-6)
    data = base.withColumn("label", (F.col("kind") > 0).cast("double"))
    boosted = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.1)
    found = supervised.on_bins({"g": boosted, "l": supervised.LogisticRegression()}, data, 4_000, 2, 2)
    assert set(found) == {"g"} and seen(found["g"], data) == seen(boosted.fit(data), data)
    assert supervised.on_bins({"g": boosted}, data, 999, 2, 2) == {}


def test_forest_on_counted_rows(spark, lineitem, monkeypatch):
    monkeypatch.setattr(supervised, "CELL_ROWS", 1_000)
    data = _grid(spark).withColumn("label", F.col("kind"))
    cuts = supervised.bin_cuts(data, 2)
    held = binned.pack_counts(data, cuts, 3).collect()
    times = np.concatenate([np.frombuffer(r["times"]) for r in held])
    assert times.sum() == 4_000 and len(times) <= 16 * 16 * 3
    forest = supervised.on_bins({"f": supervised.RandomForestClassifier(numTrees=20, maxDepth=6, seed=3)}, data, 4_000, 2, 3)["f"]
    roots = [t.stats[0].sum() for t in forest.trees]
    assert len(set(roots)) > 5 and np.mean(roots) == pytest.approx(4_000, rel=0.02)  # Poisson draws of all rows
    spark_forest = supervised.RandomForestClassifier(numTrees=20, maxDepth=6, seed=3).fit(data)
    hits = [m.transform(data).where("prediction = label").count() for m in (forest, spark_forest)]
    assert hits[0] == pytest.approx(hits[1], rel=0.03)

    def layout(*_):
        raise AssertionError("counted rows were laid out")

    monkeypatch.setattr(supervised, "spread", layout)
    inputs = ["l_discount", "l_tax", "l_linenumber"]
    table = supervised.forest_importance(lineitem, inputs, "l_returnflag").collect()
    assert [r["feature"] for r in table] == inputs and sum(r["importance"] for r in table) == pytest.approx(1.0)
