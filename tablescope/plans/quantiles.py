"""Exact linear-interpolated quantiles that stay exact on very large groups.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is
used while the largest group is small enough. For a large ungrouped table a sketch gives
bounds around every wanted rank; an exact count checks them and only the few values in
between are sorted. Where that does not settle a column, and for large groups, ranks are found by
radix selection: each pass counts rows by the next bits of an order-preserving image of the
values (a combined, tiny aggregate) and keeps the cells that hold the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.options import Options
from tablescope.plans.runtime import lookup_join, materialize
from tablescope.plans.stats import long_aggregate

ACCURACY = 10_000        # rank error of the sketch is one part in this many
TARGETS_PER_PASS = 40
CELL_ROWS = 10_000       # rows of a cell that are sorted instead of counted again
SHIFTS = (52, 40, 28, 16, 4, 0)  # bits of a value's image left out by each pass of the selection


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), opts: Options = Options()) -> DataFrame:
    """Rows ``(by..., column, p, value)``; null groups are kept out only by the caller."""
    columns, by = list(columns), list(by)
    groups = df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("_n"))
    largest = groups.agg(F.max("_n")).first()[0] or 0
    if by and largest > opts.exact_rows:
        return _selected(df, columns, probs, by, opts)
    if not by and largest > opts.buffer_rows:
        return _bracketed(df, columns, probs, opts)
    # Several columns share a pass only while their buffers stay small together.
    per_pass = max(1, 2 * opts.exact_rows // max(largest, 1))
    parts = [_one_buffer(df, columns[i:i + per_pass], probs, by) for i in range(0, len(columns), per_pass)]
    return reduce(DataFrame.unionByName, parts)


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                 opts: Options = Options()) -> dict[str, tuple]:
    """Ungrouped quantiles on the driver: column -> one value per probability."""
    if not columns:
        return {}
    found = {(r["column"], r["p"]): r["value"] for r in quantiles(df, columns, probs, (), opts).collect()}
    return {c: tuple(found.get((c, float(p))) for p in probs) for c in columns}


def _one_buffer(df, columns, probs, by):
    grid = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*[col(b) for b in by]).agg(
        *[F.percentile(col(c).cast("double"), grid).alias(f"q{i}") for i, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.col(f"q{i}")[j].alias("value"))
        for i, c in enumerate(columns) for j, p in enumerate(probs)])
    return (wide.select(*[col(b) for b in by], F.explode(rows).alias("r"))
                .select(*[col(b) for b in by], "r.*"))


def _bracketed(df, columns, probs, opts):
    """Ungrouped form: sketch, exact check, sort of the values near each rank."""
    reach = 3.0 / ACCURACY
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-reach, reach)})
    sketched = long_aggregate(df, columns, {
        "n": F.count, "lo": lambda c: F.min(c.cast("double")), "hi": lambda c: F.max(c.cast("double")),
        "q": lambda c: F.percentile_approx(c.cast("double"), grid, ACCURACY)}).collect()
    targets = []
    for r in sketched:
        for p in map(float, probs):
            if not r["n"]:
                continue
            a = r["lo"] if p - reach <= 0 else r["q"][grid.index(p - reach)]
            b = r["hi"] if p + reach >= 1 else r["q"][grid.index(p + reach)]
            spot = (r["n"] - 1) * p
            targets.append({"c": r["column"], "p": p, "a": a, "b": b, "lo": floor(spot), "hi": ceil(spot),
                            "share": spot - floor(spot)})
    value: dict[tuple[str, float], float | None] = {(r["column"], float(p)): None
                                                    for r in sketched for p in probs if not r["n"]}
    for start in range(0, len(targets), TARGETS_PER_PASS):
        part = targets[start:start + TARGETS_PER_PASS]
        x = [col(t["c"]).cast("double") for t in part]
        counts = df.agg(*[F.count_if(v < t["a"]).alias(f"below{i}") for i, (v, t) in enumerate(zip(x, part))],
                        *[F.count_if(v <= t["b"]).alias(f"upto{i}") for i, (v, t) in enumerate(zip(x, part))]).first()
        near = {}
        for i, t in enumerate(part):
            t["below"], t["upto"] = counts[f"below{i}"], counts[f"upto{i}"]
            if not t["below"] <= t["lo"] <= t["hi"] < t["upto"]:
                continue
            if t["a"] == t["b"]:
                value[t["c"], t["p"]] = t["a"]
            else:
                near[i] = t
        for i, (low, high) in _order_statistics(df, near, opts).items():
            t = near[i]
            value[t["c"], t["p"]] = low * (1 - t["share"]) + high * t["share"]
    left = sorted({t["c"] for t in targets if (t["c"], t["p"]) not in value}, key=columns.index)
    done = [(c, p, v) for (c, p), v in value.items() if c not in left]
    out = df.sparkSession.createDataFrame(done, "column string, p double, value double")
    return out.unionByName(_selected(df, left, probs, [], opts)) if left else out


def _order_statistics(df, near, opts):
    """The two neighbouring values per target; targets with too many values between are left out."""
    if not near:
        return {}
    names = list(dict.fromkeys(t["c"] for t in near.values()))
    flat = df.select(*[col(c).cast("double").alias(f"_c{j}") for j, c in enumerate(names)])
    flat = flat.unpivot([], [F.col(f"_c{j}") for j in range(len(names))], "c", "x")
    inside = {i: (F.col("c") == f"_c{names.index(t['c'])}") & (F.col("x") >= t["a"]) & (F.col("x") <= t["b"])
              for i, t in near.items()}
    cells = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in inside.items()]))
    counts = (flat.where(reduce(or_, inside.values())).select(F.explode(cells).alias("i"), "x")
                  .groupBy("i", "x").agg(F.count(F.lit(1)).alias("m")))
    counts = materialize(counts)
    sizes = {r["i"]: r["k"] for r in counts.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
    fine = [i for i in near if sizes.get(i, 0) <= opts.exact_rows]
    if not fine:
        return {}
    of = lambda key: F.element_at(F.create_map(*[F.lit(v) for i in fine for v in (i, near[i][key])]), F.col("i"))
    upto = of("below") + F.sum("m").over(Window.partitionBy("i").orderBy("x"))
    ranked = counts.where(F.col("i").isin(fine)).withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("m"))
    holds = lambda rank: (F.col("start") <= of(rank)) & (of(rank) < F.col("upto"))
    picked = ranked.groupBy("i").agg(F.max(F.when(holds("lo"), F.col("x"))).alias("low"),
                                     F.max(F.when(holds("hi"), F.col("x"))).alias("high"))
    return {r["i"]: (r["low"], r["high"]) for r in picked.collect()}


def with_image(df, x: str, name: str):
    """Add the double ``x`` as a long in the same order: its IEEE bits, negated for negative values; NaN comes last.

    The binary exponent is estimated by a logarithm and then corrected by exact scaling with powers of
    two. Each step is a column of its own, so that it is computed once.
    """
    size, two = F.abs(F.col(x)), lambda e: F.pow(F.lit(2.0), F.col(e))
    out = df.withColumn("_e0", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("double"))
    out = out.withColumn("_e1", size / two("_e0"))
    out = out.withColumn("_e2", F.when(F.col("_e1") >= 2.0, F.col("_e0") + 1).when((F.col("_e1") < 1.0) & (F.col("_e0") > -1022), F.col("_e0") - 1).otherwise(F.col("_e0")))
    out = out.withColumn("_e3", size / two("_e2"))
    bits = (F.when(size == F.lit(float("inf")), F.lit(2047 << 52))
            .when(size < F.lit(2.0 ** -1022), (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long"))
            .otherwise((F.col("_e2").cast("long") + 1023) * F.lit(1 << 52) + ((F.col("_e3") - 1.0) * F.lit(2.0 ** 52)).cast("long")))
    out = out.withColumn("_e4", bits)
    signed = F.when(F.isnan(F.col(x)), F.lit(2 ** 63 - 1)).when(F.col(x) < 0, -F.col("_e4")).otherwise(F.col("_e4"))
    # never null, so that Spark derives no null test that would repeat all of these steps
    return out.withColumn(name, F.coalesce(signed, F.lit(0).cast("long"))).drop("_e0", "_e1", "_e2", "_e3", "_e4")


def _selected(df, columns, probs, by, opts):
    """Radix selection: each wanted rank follows the cell of leading bits that holds it.

    A pass counts rows by the next bits of the values' images, for all groups, columns and ranks together, and
    only for cells that still hold a rank. The two ranks of one quantile are followed apart, so every pass
    shrinks what is open however far apart they lie, and after the last bits nothing is. A cell with at most
    ``CELL_ROWS`` rows or one value needs no further pass.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    # Null keys travel as a struct, which compares equal to itself in a join.
    flat = df.select(*[F.struct(col(b)).alias(k) for b, k in zip(by, keys)],
                     *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    flat = (flat.unpivot([F.col(k) for k in keys], [F.col(f"_c{i}") for i in range(len(columns))],
                         "_col", "_x")
                .where("_x IS NOT NULL"))
    flat = with_image(flat, "_x", "_u")
    keys = [*keys, "_col"]
    state = None
    for before, shift in zip((None, *SHIFTS), SHIFTS):
        cell = F.shiftright("_u", shift)
        if state is None:
            hist = flat.groupBy(*keys, F.lit(0).cast("bigint").alias("_cell"), cell.alias("_next"))
        else:
            open_ = state.where(_is_open(opts))
            if not open_.take(1):
                break
            cells = open_.groupBy(*keys).agg(F.collect_set("_cell").alias("_cells"))
            inside = lookup_join(flat, cells, keys, "inner", opts).where(F.array_contains("_cells", F.shiftright("_u", before)))
            hist = inside.groupBy(*keys, F.shiftright("_u", before).alias("_cell"), cell.alias("_next"))
        # at most 2 ** (bits of a pass) rows per cell
        hist = hist.agg(F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        if state is None:
            hist = materialize(hist)
            spot = (F.col("_n") - 1) * F.col("_p")
            ranks = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
            wanted = (hist.groupBy(*keys).agg(F.sum("_m").alias("_n")).select(*keys, "_n", ranks.alias("_p"))
                      .select(*keys, "_p", (spot - F.floor(spot)).alias("_f"), F.explode(F.array(
                          F.struct(F.lit(0).alias("_side"), F.floor(spot).alias("_rank")), F.struct(F.lit(1).alias("_side"), F.ceil(spot).alias("_rank")))).alias("_w"))
                      .select(*keys, "_p", "_f", "_w.*", F.lit(0).cast("bigint").alias("_cell"), F.lit(0).cast("bigint").alias("_below")))
            shut = None
        else:
            wanted, shut = open_, state.where(~_is_open(opts))
        run = Window.partitionBy(*keys, "_cell").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_start", F.coalesce(F.sum("_m").over(run), F.lit(0)))
        lists = wanted.groupBy(*keys, "_cell").agg(F.first("_below").alias("_below"), F.collect_list(F.struct("_p", "_f", "_side", "_rank")).alias("_w"))
        start = F.col("_below") + F.col("_start")
        held = F.filter("_w", lambda w: (w["_rank"] >= start) & (w["_rank"] < start + F.col("_m")))
        found = (hist.join(lists, [*keys, "_cell"]).select(*keys, F.explode(held).alias("_w"), F.col("_next").alias("_cell"), start.alias("_below"),
                                                           F.col("_m").alias("_inside"), "_a", "_b")
                 .select(*keys, "_w.*", "_cell", "_below", "_inside", "_a", "_b"))
        state = materialize(found if shut is None else shut.unionByName(found))
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    settled = state.where("_a = _b OR isnan(_a)").withColumn("value", F.coalesce(value, F.col("_a"))).select(*keys, "_p", "_f", "_side", "value")
    rest = state.where("NOT (_a = _b OR isnan(_a))")
    sides = settled.unionByName(_pick(flat, rest, keys, opts)) if rest.take(1) else settled
    low, high = F.max(F.when(F.col("_side") == 0, F.col("value"))), F.max(F.when(F.col("_side") == 1, F.col("value")))
    out = sides.groupBy(*keys, "_p", "_f").agg(low.alias("_l"), high.alias("_h"))
    value = F.when((F.col("_f") == 0) | (F.col("_l") == F.col("_h")), F.col("_l")).otherwise(F.col("_l") * (1 - F.col("_f")) + F.col("_h") * F.col("_f"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]),
                         F.substring("_col", 3, 10).cast("int") + 1)
    return out.select(*[F.col(k).getField(b).alias(b) for k, b in zip(keys, by)],
                      names.alias("column"), F.col("_p").alias("p"), value.alias("value"))


def _is_open(opts):
    return (F.col("_inside") > min(opts.exact_rows, CELL_ROWS)) & (F.col("_a") < F.col("_b"))


def _pick(flat, rest, keys, opts):
    """Values at the ranks of cells with few rows: (keys..., _p, _f, _side, value)."""
    cells = rest.groupBy(*keys, "_a", "_b", "_below").agg(F.collect_list(F.struct("_p", "_f", "_side", "_rank")).alias("_w"))
    lists = cells.groupBy(*keys).agg(F.collect_list(F.struct("_a", "_b", "_below")).alias("_cells"), F.min("_a").alias("_from"), F.max("_b").alias("_to"))
    rows = lookup_join(flat, lists, keys, "inner", opts).where((F.col("_x") >= F.col("_from")) & (F.col("_x") <= F.col("_to")))
    # cells of one column do not overlap
    at = F.filter("_cells", lambda c: (F.col("_x") >= c["_a"]) & (F.col("_x") <= c["_b"]))
    rows = rows.select(*keys, "_x", F.get(at, F.lit(0)).alias("_cell")).where("_cell IS NOT NULL").select(*keys, "_x", "_cell.*")
    counts = rows.groupBy(*keys, "_a", "_b", "_below", "_x").agg(F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*keys, "_a", "_b", "_below").orderBy("_x")
    counts = (counts.withColumn("_upto", F.col("_below") + F.sum("_m").over(run))
                    .withColumn("_start", F.col("_upto") - F.col("_m")))
    held = F.filter("_w", lambda w: (w["_rank"] >= F.col("_start")) & (w["_rank"] < F.col("_upto")))
    return (counts.join(cells, [*keys, "_a", "_b", "_below"]).select(*keys, F.col("_x").alias("value"), F.explode(held).alias("_w"))
                  .select(*keys, "_w._p", "_w._f", "_w._side", "value"))
