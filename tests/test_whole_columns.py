"""Defaults use all columns and all rows."""

from tablescope.operators import explore, features
from tablescope.operators.learning import clusters, isolation, rules
from tablescope.options import Options
from tablescope.plans.roles import Roles


def test_event_kinds_are_ranked_over_the_whole_table(spark):
    rows = [(i, "s", "early" if i < 600 else f"late{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "t long, sig string, ev string")
    got = {r["event"]: r["count"] for r in explore.event_timeline(df, "t", "sig", "ev", ["t"], top=2).groupBy("event").count().collect()}
    assert got == {"late0": 1200, "late1": 1200}


def test_columns_past_the_old_limits_count(spark):
    names = [f"c{i}" for i in range(25)]
    rows = [tuple(float((i * (j + 3)) % 17) if j < 24 else float(1000 if i % 5 == 0 else i % 7) for j in range(25)) for i in range(100)]
    df = spark.createDataFrame(rows, names)
    assert Options().max_features is None and Options().row_stat_columns is None
    top = features.row_statistics(df, names).selectExpr("max(_row_max)").first()[0]
    assert top == 1000
    assert {r.feature for r in clusters.loadings(df, names, 2).collect()} == set(names)
    # only the last column has outliers: a fifth of its rows
    assert abs(isolation.contamination(df, names[19:]).first()[0] - 0.2 / 6) < 1e-9
    pairs = features.ratio_pairs([f"revenue{i}" for i in range(3)] + [f"cost{i}" for i in range(3)])
    assert len(pairs) == 9
    inputs = {r.kind: r.inputs for r in rules.proposals(df, Roles("wide_table", 1.0, numeric=tuple(names))).collect()}
    assert inputs["regression"] == inputs["causal"] == names[1:] and inputs["clustering"] == inputs["anomaly"] == names
