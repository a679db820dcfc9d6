"""The strategies for large tables give the same rows as the ones for small tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablescope.operators import encode, windows
from tablescope.operators.features import signal_features
from tablescope.operators.quality import duplicate_counts
from tablescope.options import Options
from tablescope.plans.quantiles import quantiles
from tablescope.plans.runtime import lookup_join

SMALL = replace(Options(), exact_rows=40, buffer_rows=40, block_rows=70, broadcast_rows=2)


def same(a, b, digits=9):
    key = lambda df: sorted(repr(tuple(round(v, digits) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert a.columns == b.columns and key(a) == key(b)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group and one value, plus infinities, gaps and a null group."""
    third = spark.range(900).select((F.col("id") % 3 == 0).alias("hot"), "id")
    group = F.when(F.col("hot"), "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    value = F.when(F.col("hot") & (F.col("id") % 2 == 0), 5.0).when(F.col("id") % 31 == 0, F.lit(None)) \
             .when(F.col("id") == 100, 1e300).otherwise((F.col("id") * 7919 % 1009) / 3.0)
    return third.select("id", group.alias("g"), value.alias("v"), (F.col("id") * 31 % 101).alias("w"))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_narrowed_quantiles(skewed, by):
    probs = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)
    exact = quantiles(skewed, ["v", "w"], probs, by)
    narrow = quantiles(skewed, ["v", "w"], probs, by, SMALL)
    key = lambda df: {(*[r[b] for b in by], r["column"], r["p"]): r["value"] for r in df.collect()}
    a, b = key(exact.where("value IS NOT NULL")), key(narrow)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == (b[k] if b[k] is None else pytest.approx(b[k], rel=1e-12)), k


@pytest.mark.parametrize("opts", [replace(Options(), buffer_rows=10), replace(SMALL, buffer_rows=10)])
def test_bracketed_quantiles(skewed, opts):
    probs = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0)
    wide = skewed.withColumns({"e": F.lit(None).cast("double"), "k": F.lit(3)})
    key = lambda df: {(r["column"], r["p"]): r["value"] for r in df.collect()}
    a, b = (key(quantiles(wide, ["v", "w", "e", "k"], probs, opts=o)) for o in (Options(), opts))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == (b[k] if b[k] is None else pytest.approx(b[k], rel=1e-12)), k


@pytest.mark.parametrize("by", [[], ["g"]])
def test_blocks(skewed, by):
    for fn in (lambda o: windows.lag_features(skewed, "v", ["id"], by, o),
               lambda o: windows.moving_average(skewed, "v", ["id"], 20, by, o),
               lambda o: windows.fill_along(skewed, ["v"], ["id"], by, "forward", o),
               lambda o: windows.fill_along(skewed, ["v"], ["id"], by, "backward", o)):
        same(fn(Options()), fn(SMALL), 6)


def test_backward_fill_reads_no_frame_to_the_end(skewed):
    for by in ([], ["g"]):
        assert "unboundedfollowing" not in plan_of(windows.fill_along(skewed, ["v"], ["id"], by, "backward", SMALL)).lower()


def test_blocks_never_smaller_than_halo(skewed):
    tiny = replace(Options(), block_rows=5)
    same(windows.moving_average(skewed, "v", ["id"], 50, (), Options()),
         windows.moving_average(skewed, "v", ["id"], 50, (), tiny), 6)


def test_salted_lookup(skewed):
    table = skewed.where("g IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"))
    for how in ("left", "inner", "left_semi"):
        same(lookup_join(skewed, table, ["g"], how), lookup_join(skewed, table, ["g"], how, SMALL))
    same(signal_features(skewed, "g", "v"), signal_features(skewed, "g", "v", SMALL), 6)


def test_label_codes_of_many_categories(skewed):
    df = skewed.select("id", F.col("w").cast("string").alias("c"))
    a = encode.encode(df, {"c": "label"})[0]
    b = encode.encode(df, {"c": "label"}, opts=SMALL)[0]
    same(a.select("id", "c"), b.select("id", "c"))


def test_onehot_limit(skewed):
    with pytest.raises(ValueError):
        encode.encode(skewed.select(F.col("w").cast("string").alias("c")), {"c": "onehot"}, opts=replace(Options(), onehot_limit=10))


def test_duplicates_with_long_text_and_nested(spark):
    long = "x" * 500
    rows = [(1, long, [1.0, 2.0]), (1, long, [1.0, 2.0]), (1, long + "y", [1.0, 2.0]), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "i int, t string, a array<double>")
    assert tuple(duplicate_counts(df).first()) == (5, 2)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_windows_are_not_one_task(skewed):
    plan = plan_of(windows.lag_features(skewed, "v", ["id"], (), SMALL))
    window = plan[plan.index("Window [lag("):]
    assert "hashpartitioning(_blk" in window
    assert plan.count("SinglePartition") <= plan.count("_size")  # only the table of partition sizes




def test_filters_and_columns_reach_the_scan(spark):
    from conftest import SF

    from tablescope.sources.tables import read_table

    df = read_table(spark, f"{SF}/lineitem.parquet").where("l_orderkey > 100").select("l_orderkey", "l_returnflag")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(l_orderkey), GreaterThan(l_orderkey,100)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_quota_is_cut_before_the_shuffle(spark, events):
    from tablescope.operators.quota import admitted

    assert "WindowGroupLimit" in plan_of(admitted(events, "event_type", "ts", ["ts", "event_id"]))


# ------------------------------------------------------------------ tied keys
def tied(spark):
    """A time stamp with a third of the rows, one row repeated very often, gaps and a null stamp."""
    rows = [(None if i % 97 == 0 else 50 if i % 3 == 0 else i * 7919 % 400, float(i % 53), f"n{i % 5}") for i in range(1200)]
    rows += [(200, 1.0, "copy")] * 500
    return spark.createDataFrame(rows, "ts int, v double, name string")


def test_no_range_is_crowded(spark):
    df = tied(spark)
    cells = windows.range_cells(df, ["ts"], SMALL)
    sizes = [r["n"] for r in cells.groupBy("_part", "_sub").agg(F.count("*").alias("n")).collect()]
    mean = sum(sizes) / -(-sum(sizes) // SMALL.block_rows)
    assert sum(sizes) == df.count() and max(sizes) <= 2 * mean


def test_small_blocks_do_not_ask_for_as_many_ranges(spark):
    df, tiny = tied(spark), replace(SMALL, block_rows=5)
    assert windows.range_cells(df, ["ts"], tiny).rdd.getNumPartitions() <= 2 * tiny.few_ranges < df.count() / tiny.block_rows
    same(windows.number_rows(df, ["ts"], tiny), windows.number_rows(df, ["ts"], Options()))


def test_tied_rows_are_numbered_alike(spark):
    df = tied(spark)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [r for r in sorted((tuple(r) for r in df.collect()), key=key)]
    for opts in (Options(), SMALL):
        for shuffled in (df, df.repartition(7, "name"), df.orderBy(F.desc("v")).coalesce(2)):
            got = windows.number_rows(shuffled, ["ts"], opts).orderBy("_rn").collect()
            assert [r["_rn"] for r in got] == list(range(1, len(want) + 1))
            # the first columns decide, the hash only among equal (ts, v)
            assert [tuple(r)[:2] for r in got] == [w[:2] for w in want]


def test_equal_lags_on_two_shuffles(spark):
    df = tied(spark)
    lags = lambda d, o: sorted(map(str, windows.lag_features(d, "v", ["ts"], ["name"], o).collect()))
    a = lags(df, Options())
    for opts in (Options(), SMALL, replace(SMALL, range_partitions=3)):
        assert lags(df.repartition(5, "v"), opts) == a


# ------------------------------------------------------------ radix selection
def test_images_keep_the_order_of_doubles(spark):
    import random
    import struct

    from tablescope.plans.quantiles import with_image

    rng = random.Random(4)
    xs = [0.0, -0.0, 1.0, 2.0 ** -1074, 2.0 ** -1022, 1.7976931348623157e308, float("inf"), 0.1, 0.9999999999999999, 1.9999999999999998, 2.0 ** 52 + 1]
    xs += [x for x in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(500)) if x == x]
    xs += [-x for x in xs]
    got = {r["x"]: r["u"] for r in with_image(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "u").collect()}
    bits = lambda x: struct.unpack("q", struct.pack("d", abs(x)))[0] * (-1 if x < 0 else 1)
    assert all(got[x] == bits(x) for x in xs)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_far_apart_are_followed_apart(spark, by, monkeypatch):
    """Two clusters with the median between them, powers over the whole range, and one value with most of the rows."""
    from tablescope.plans import quantiles as q

    rows = [("two", float(i % 250) + (1e9 if i % 2 else 0.0)) for i in range(1000)] + [("powers", 2.0 ** (i - 500)) for i in range(1000)]
    rows += [("one", 5.0)] * 900 + [("one", float(i)) for i in range(100)] + [("minus", -float(i)) for i in range(400)] + [(None, float(i)) for i in range(99)]
    df = spark.createDataFrame(rows, "g string, v double")
    sorted_cells = []
    pick = q._pick

    def watched(flat, rest, keys, opts):
        sorted_cells.extend(r["_inside"] for r in rest.collect())
        return pick(flat, rest, keys, opts)

    monkeypatch.setattr(q, "_pick", watched)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    key = lambda rows: {(*[r[b] for b in by], r["p"]): r["value"] for r in rows}
    a = key(quantiles(df, ["v"], probs, by).collect())
    b = key(q._selected(df, ["v"], probs, by, SMALL).collect())
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)
    assert max(sorted_cells, default=0) <= SMALL.exact_rows


# ------------------------------------------------------- wide tables, few scans
def wide_table(spark, columns):
    """Columns with gaps at different rows, one constant, one empty, large offsets, and a column that goes with another."""
    import math

    rows = []
    for i in range(400):
        row = [i % 4 if i % 9 else None]
        for j in range(columns):
            x = 1e7 * (j % 3) + math.sin(i * (j + 1) * 0.37) * (j + 1) + (i * j % 17)
            row.append(None if (i + j) % 11 == 0 or j == 5 else 3.0 if j == 4 else x)
        row[8] = None if row[7] is None else -2.0 * row[7] + 1
        rows.append(tuple(row))
    return spark.createDataFrame(rows, "g int, " + ", ".join(f"c{j} double" for j in range(columns)))


def test_correlations_of_a_wide_table(spark, tmp_path):
    from tablescope.operators import explore
    from tablescope.plans import gram

    names = [f"c{j}" for j in range(70)]  # more than one block
    path = str(tmp_path / "wide")
    wide_table(spark, 70).repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    want = df.select(*names).toPandas().astype(float).corr(min_periods=2)
    for full in (True, False):
        got = {(r["a"], r["b"]): r["r"] for r in explore.correlations(df, names, full).collect()}
        assert len(got) == (70 * 70 if full else 70 * 69 // 2)
        for (a, b), r in got.items():
            w = want.loc[a, b]
            none = w != w or "c4" in (a, b) or "c5" in (a, b)
            assert (r is None) if none else r == pytest.approx(w, abs=1e-6), (a, b)
    # one scan for the pilot (already done), one for all sums
    assert plan_of(gram.pair_correlations(df, names)).count("FileScan parquet") == 1


def test_column_groups_of_a_very_wide_table(spark, monkeypatch):
    from tablescope.plans import gram

    df, names = wide_table(spark, 12), [f"c{j}" for j in range(12)]
    key = lambda: {(r["i"], r["j"]): (r["n"], r["r"] and round(r["r"], 9)) for r in gram.pair_correlations(df, names).collect()}
    whole = key()
    monkeypatch.setattr(gram, "WIDTH", 5)
    assert key() == whole and len(whole) == 78


@pytest.mark.parametrize("by", [[], ["g"]])
def test_moments_of_a_wide_table(spark, by):
    from tablescope.plans.stats import NUMERIC_METRICS, SHAPE_METRICS, long_aggregate, power_sums

    df, names = wide_table(spark, 30), [f"c{j}" for j in range(30)]
    key = lambda rows: {(*[r[b] for b in by], r["column"]): r for r in rows.collect()}
    a, b = key(long_aggregate(df, names, {**NUMERIC_METRICS, **SHAPE_METRICS}, by, 5)), key(power_sums(df, names, by))
    assert a.keys() == b.keys() and list(power_sums(df, names, by).columns) == [*by, "column", "n", "mean", "std", "min", "max", "skew", "kurt"]
    for k, x in a.items():
        for f in ("n", "mean", "std", "min", "max", "skew", "kurt"):
            assert b[k][f] == (None if x[f] is None else pytest.approx(x[f], rel=1e-6, abs=1e-6)), (k, f)
    assert all(r["n"] == 0 for r in power_sums(df.limit(0), names).collect()) and power_sums(df.limit(0), names).count() == 30
    # the pilot is done by then: what is left reads the table once
    assert plan_of(power_sums(df, names, by)).count("Expand") == 1


# ------------------------------------------------------------------- lookups
def test_only_hot_keys_are_copied(spark):
    from tablescope.plans.runtime import hot_keys

    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"k{i % 40}", i) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = spark.createDataFrame([(f"k{i}", i) for i in range(0, 60, 2)] + [("hot", -1)], "k string, x int")
    opts = replace(SMALL, hot_rows=100)
    assert [(r["k"], r["_copies"]) for r in hot_keys(df, ["k"], opts).collect()] == [("hot", 4)]
    for how in ("left", "inner", "left_semi", "left_anti"):
        out = lookup_join(df, table, ["k"], how, opts)
        same(out, df.join(table, ["k"], how))
    out = lookup_join(df, table, ["k"], "left", opts)
    assert "hashpartitioning(k" in plan_of(out) and "_salt" in plan_of(out)
    # without a hot key nothing is copied
    calm = lookup_join(df.where("k <> 'hot'"), table, ["k"], "left", opts)
    assert "Generate" not in plan_of(calm)
    same(calm, df.where("k <> 'hot'").join(table, ["k"], "left"))


def test_long_keys_are_not_broadcast(spark):
    from tablescope.plans.runtime import table_bytes

    table = spark.createDataFrame([("x" * 3000 + str(i), i) for i in range(50)], "k string, x int")
    df = spark.createDataFrame([("x" * 3000 + str(i % 70), i) for i in range(300)], "k string, i int")
    assert table_bytes(table)[1] > 150_000
    opts = replace(Options(), broadcast_bytes=100_000)
    out = lookup_join(df, table, ["k"], "left", opts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(lookup_join(df, table, ["k"], "left", opts))
        same(out, df.join(table, ["k"], "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan_of(lookup_join(df, table, ["k"], "left", Options()))
