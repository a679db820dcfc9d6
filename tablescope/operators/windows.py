"""Ordered operators (lags, rolling windows, fills) without a single-task sort.

Rows are numbered exactly in a range-partitioned order, cut into blocks of equal
size, and each block gets copies of the last rows of the block before it (a halo).
Windows then run per block, so neither a long series, one hot series nor one hot time stamp is ever
sorted by a single task. Small tables use one block. Order keys need not be unique: ties are
broken by the row itself, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.exprs import col, row_hash
from tablescope.options import Options
from tablescope.plans.runtime import lookup_join, materialize, number_copies

RN, BLOCK, OWN = "_rn", "_blk", "_own"
#: Columns besides the order keys that decide ties before row hashes do.
TIE_COLUMNS = 3
TIE_TYPES = (T.IntegralType, T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def total_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Keys that put the rows in one definite order, whatever order they were read in.

    Rows with equal ``order`` keys go by the first TIE_COLUMNS other columns of number, date or
    truth type, then by two hashes of the row. Rows that agree in all of these are equal, so it does not
    matter which comes first.
    """
    chosen = set(order)
    ties = [f.name for f in df.schema if f.name not in chosen and isinstance(f.dataType, TIE_TYPES)][:TIE_COLUMNS]
    return [*[col(c) for c in [*order, *ties]], row_hash(df, 11), row_hash(df, 12)]


def _in_order(df: DataFrame, parts: int, keys: Sequence[Column]) -> DataFrame:
    """Rows dealt to ``parts`` ranges of ``keys``, with range number ``_part`` and place in it ``_at`` (from 0).

    One exchange: the place in the sorted range is counted while the rows stream by. Range bounds come
    from a sample, so the result is written down once.
    """
    sorted_ = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ids = sorted_.withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(ids.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", place).drop("_id"))


def range_cells(df: DataFrame, order: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Rows in cells that follow each other in the total order: ``_part``, ``_sub`` and place ``_at`` in the cell.

    Two levels. The first deals the rows to ranges of the order keys and the tie breakers, so that a
    key that a third of the rows share is spread over many ranges. The ranges are counted; those of more than twice
    the wanted rows (the sample was unlucky or one row is repeated very often)
    are dealt out again among themselves, with equal rows told apart by a copy number. No cell depends on a single key.

    Ranges are tasks, and their bounds come from a sample on the driver, so small blocks do not ask for as many
    ranges: beyond ``few_ranges`` a range holds ``range_rows``, cut into blocks later by the row numbers.
    """
    names = df.columns
    rows = df.count()

    def wanted_parts(n: int) -> int:
        return min(-(-n // opts.block_rows), max(-(-n // opts.range_rows), opts.few_ranges), opts.range_partitions)

    parts = wanted_parts(rows)
    most = 2 * max(opts.block_rows, -(-rows // parts))
    first = _in_order(df, parts, total_order(df, order))
    heavy = first.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    # at most range_partitions rows
    crowded = {r["_part"]: r["_n"] for r in heavy.collect()}
    if not crowded:
        return first.withColumn("_sub", F.lit(0).cast("bigint"))
    again = number_copies(first.where(F.col("_part").isin(list(crowded))).drop("_at"), "_copy")
    inner = again.select(*[col(c) for c in names])
    keys = [F.col("_part"), *total_order(inner, order), F.col("_copy")]
    pieces = max(wanted_parts(sum(crowded.values())), -(-2 * sum(crowded.values()) // most))
    second = _in_order(again.withColumnRenamed("_part", "_cell"), pieces, [F.col("_cell"), *keys[1:]])
    second = second.withColumnRenamed("_part", "_sub").withColumnRenamed("_cell", "_part")
    # a piece may reach over two crowded cells: number it within each
    low = second.groupBy("_part", "_sub").agg(F.min("_at").alias("_low"))
    second = second.join(F.broadcast(low), ["_part", "_sub"]).withColumn("_at", F.col("_at") - F.col("_low"))
    light = first.where(~F.col("_part").isin(list(crowded))).withColumn("_sub", F.lit(0).cast("bigint"))
    wanted = [*[col(c) for c in names], "_part", "_sub", "_at"]
    return light.select(*wanted).unionByName(second.select(*wanted))


def number_rows(df: DataFrame, order: Sequence[str], opts: Options = Options(),
                name: str = RN) -> DataFrame:
    """Exact 1-based global row number in the order of ``order``; ties as in ``total_order``."""
    n = df.count()
    if n <= opts.block_rows:
        keys = total_order(df, order)
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))
                             .cast("bigint"))
    cells = range_cells(df, order, opts)
    sizes = cells.groupBy("_part", "_sub").agg(F.count(F.lit(1)).alias("_size"))
    # One row per cell, at most twice range_partitions and the crowded ones.
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_sub", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    return (cells.join(F.broadcast(starts), ["_part", "_sub"])
                 .withColumn(name, (F.col("_start") + F.col("_at") + 1).cast("bigint"))
                 .drop("_part", "_sub", "_start", "_at"))


def blocked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), halo: int = 0,
            opts: Options = Options()) -> DataFrame:
    """Rows with block id and halo copies (``_own`` false), numbered by (by, order)."""
    numbered = number_rows(df, [*by, *order], opts)
    size = max(opts.block_rows, halo, 1)
    own = F.floor((F.col(RN) - 1) / size).cast("bigint")
    offset = (F.col(RN) - 1) % size
    if halo == 0:
        return numbered.withColumn(BLOCK, own).withColumn(OWN, F.lit(True))
    here = F.struct(own.alias("b"), F.lit(True).alias("o"))
    next_ = F.struct((own + 1).alias("b"), F.lit(False).alias("o"))
    targets = F.when(offset >= size - halo, F.array(here, next_)).otherwise(F.array(here))
    return (numbered.withColumn("_t", F.explode(targets))
                    .withColumn(BLOCK, F.col("_t.b")).withColumn(OWN, F.col("_t.o")).drop("_t"))


def block_window(by: Sequence[str] = (), along=F.asc):
    return Window.partitionBy(BLOCK, *[col(b) for b in by]).orderBy(along(RN))


def own_rows(df: DataFrame, keep_number: str | None = None) -> DataFrame:
    """Drop halo copies and helper columns."""
    out = df.where(F.col(OWN)).drop(OWN, BLOCK)
    return out.withColumnRenamed(RN, keep_number) if keep_number else out.drop(RN)


def over_blocks(df: DataFrame, order: Sequence[str], by: Sequence[str], halo: int,
                make, opts: Options = Options(), keep_number: str | None = None) -> DataFrame:
    """Add the window columns ``make(window)`` returns (name -> Column)."""
    ready = blocked(df, order, by, halo, opts)
    return own_rows(ready.withColumns(make(block_window(by))), keep_number)


def _null_for_null_key(c: Column, by: Sequence[str]) -> Column:
    for b in by:
        c = F.when(col(b).isNotNull(), c)
    return c


def lag_features(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (),
                 opts: Options = Options()) -> DataFrame:
    """``<v>_lag<k>``, ``<v>_roll_mean_<w>``, ``<v>_roll_std_<w>`` (window includes the row)."""
    v, w = col(value), opts.rolling_rows

    def make(win):
        rows = win.rowsBetween(-(w - 1), 0)
        out = {f"{value}_lag{k}": F.lag(v, k).over(win) for k in opts.lags}
        out[f"{value}_roll_mean_{w}"] = F.avg(v).over(rows)
        out[f"{value}_roll_std_{w}"] = F.stddev_samp(v).over(rows)
        return out

    halo = max(max(opts.lags), w - 1)
    return over_blocks(df, order, by, halo, make, opts)


def forecast_feature_names(opts: Options = Options()) -> list[str]:
    names = [f"lag_{k}" for k in opts.forecast_lags]
    for w in opts.forecast_windows:
        names += [f"roll_mean_{w}", f"roll_std_{w}"]
    return [*names, "dayofweek", "month"]


def forecast_features(df: DataFrame, ts: str, target: str, order: Sequence[str] | None = None,
                      by: Sequence[str] = (), opts: Options = Options()) -> DataFrame:
    """Lags, full rolling windows of the lagged series, calendar parts; complete rows only."""
    order = list(order or [ts])
    v = col(target)

    def make(win):
        out = {f"lag_{k}": F.lag(v, k).over(win) for k in opts.forecast_lags}
        for w in opts.forecast_windows:
            rows = win.rowsBetween(-w, -1)
            full = F.count(v).over(rows) == w
            out[f"roll_mean_{w}"] = F.when(full, F.avg(v).over(rows))
            out[f"roll_std_{w}"] = F.when(full, F.stddev_samp(v).over(rows))
        out["dayofweek"] = F.weekday(col(ts))
        out["month"] = F.month(col(ts))
        return out

    source = df.dropna(subset=[ts, target])
    halo = max(*opts.forecast_lags, *opts.forecast_windows)
    out = over_blocks(source, order, by, halo, make, opts)
    return out.dropna(subset=forecast_feature_names(opts))


def moving_average(df: DataFrame, value: str, order: Sequence[str], rows: int,
                   by: Sequence[str] = (), opts: Options = Options(), name: str = "moving_avg") -> DataFrame:
    """Mean of the last ``rows`` non-null values, null until the window is full."""
    v = col(value)

    def make(win):
        frame = win.rowsBetween(-(rows - 1), 0)
        return {name: F.when(F.count(v).over(frame) == rows, F.avg(v).over(frame))}

    return over_blocks(df.dropna(subset=[value]), order, by, rows - 1, make, opts)


def fill_along(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
               direction: str = "forward", opts: Options = Options()) -> DataFrame:
    """Forward or backward fill along an order.

    Inside a block the nearest value is a window; across blocks a carry table (one row
    per block and series) supplies the nearest value of the blocks before or after.
    A backward fill runs forward over the reversed order: a frame that begins at the row and
    reaches to the end would be read anew for every row.
    """
    forward = direction == "forward"
    along = F.asc if forward else F.desc
    ready = blocked(df, order, by, 0, opts)
    near = block_window(by, along).rowsBetween(Window.unboundedPreceding, 0)
    ready = ready.withColumns({f"_f{i}": F.last(col(c), ignorenulls=True).over(near)
                               for i, c in enumerate(columns)})
    edge = F.max_by if forward else F.min_by
    carry = ready.groupBy(BLOCK, *[F.struct(col(b)).alias(f"_k{i}") for i, b in enumerate(by)]).agg(
        *[edge(col(c), F.when(col(c).isNotNull(), F.col(RN))).alias(f"_e{i}") for i, c in enumerate(columns)])
    series = Window.partitionBy(*[f"_k{i}" for i in range(len(by))] or [F.lit(0)]).orderBy(along(BLOCK))
    beyond = series.rowsBetween(Window.unboundedPreceding, -1)
    keys = [BLOCK, *[f"_k{i}" for i in range(len(by))]]
    carry = carry.select(*keys, *[F.last(F.col(f"_e{i}"), ignorenulls=True).over(beyond).alias(f"_e{i}")
                                  for i in range(len(columns))])
    ready = ready.withColumns({f"_k{i}": F.struct(col(b)) for i, b in enumerate(by)}) if by else ready
    out = lookup_join(ready, carry, keys, "left", opts)
    out = out.withColumns({c: F.coalesce(col(c), F.col(f"_f{i}"), F.col(f"_e{i}"))
                           for i, c in enumerate(columns)})
    return own_rows(out).select(*[col(c) for c in df.columns])


def chronological_split(df: DataFrame, order: Sequence[str], fraction: float = 0.8,
                        opts: Options = Options(), name: str = "is_train") -> DataFrame:
    """Mark the first ``floor(fraction * n)`` rows in time order."""
    numbered = number_rows(df, order, opts, "_pos")
    cut = int(df.count() * fraction)
    return numbered.withColumn(name, F.col("_pos") <= cut).drop("_pos")


def group_index(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str,
                opts: Options = Options()) -> DataFrame:
    """0-based position inside each group, for groups of any size."""
    numbered = number_rows(df, [*by, *order], opts, "_pos")
    first = numbered.groupBy(*[col(b) for b in by]).agg(F.min("_pos").alias("_first"))
    return (lookup_join(numbered, first, list(by), "inner", opts)
            .withColumn(name, (F.col("_pos") - F.col("_first")).cast("int")).drop("_pos", "_first"))
