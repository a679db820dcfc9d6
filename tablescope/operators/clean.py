"""Cleaning: names, dates, mixed values, missing values, outliers, calendar parts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import DATE_FORMATS, col, parse_date, parse_number
from tablescope.functions.kinds import kinds
from tablescope.operators.features import calendar_parts
from tablescope.operators.missing import apply_fills, drop_sparse_columns, fit_fills
from tablescope.operators.outliers import treat_outliers
from tablescope.options import Options
from tablescope.plans.roles import Roles, _date_shares, with_split
from tablescope.plans.stats import missing_counts


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parse_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to timestamps; cells that are no date become null.

    One layout is chosen per column, the one most cells have, so a column of four-digit
    numbers and one of full dates are not mixed up cell by cell.
    """
    kind = kinds(df)
    texts = [c for c in columns if kind.get(c) == "text"]
    if not texts:
        return df
    best = {}
    for r in _date_shares(df, texts).collect():
        hits = [r[f"d{i}"] for i in range(len(DATE_FORMATS))]
        best[r["column"]] = DATE_FORMATS[hits.index(max(hits))]
    return df.withColumns({c: parse_date(col(c), [best[c]]) for c in texts})


def split_mixed(df: DataFrame, value: str) -> DataFrame:
    """``<v>_num``: the number or null. ``<v>_text``: what is present but no number."""
    text = col(value).cast("string")
    number = parse_number(text)
    return df.withColumns({
        f"{value}_num": number,
        f"{value}_text": F.when(text.isNotNull() & number.isNull() & (F.lower(F.trim(text)) != "nan"), text)
        if kinds(df)[value] == "text" else F.lit(None).cast("string"),
    })


def split_counts(df: DataFrame, value: str) -> DataFrame:
    """``(n_numeric, n_text)`` of a split value column."""
    return split_mixed(df, value).agg(F.count(col(f"{value}_num")).alias("n_numeric"),
                                      F.count(col(f"{value}_text")).alias("n_text"))


def default_fill_plan(df: DataFrame, roles: Roles, opts: Options) -> dict[str, str]:
    """Numeric columns by ``fill_numeric``, categorical ones by their mode, where values are missing."""
    numeric = {"median": "fill_median", "mean": "fill_mean", "zero": "fill_zero"}.get(opts.fill_numeric)
    wanted = {c: numeric for c in roles.numbers(opts) if c in df.columns and numeric}
    if opts.fill_categorical == "mode":
        wanted |= {c: "fill_mode" for c in roles.categorical if c in df.columns}
    if not wanted:
        return {}
    gaps = {r["column"] for r in missing_counts(df, list(wanted)).where("n_missing > 0").collect()}
    return {c: m for c, m in wanted.items() if c in gaps}


def clean(df: DataFrame, roles: Roles, opts: Options = Options()) -> tuple[DataFrame, Roles, list[str]]:
    """The cleaning sequence; every fit is one small aggregate, every apply a projection."""
    log: list[str] = []
    df = strip_names(df)
    if opts.auto_parse_dates:
        dates = [c for c in (roles.timestamp, *roles.datetime) if c]
        df = parse_dates(df, dates)
    if roles.shape == "signal_pool" and roles.value:
        df = split_mixed(df, roles.value)
        roles = with_split(roles, f"{roles.value}_num", f"{roles.value}_text")
        log.append(f"split {roles.value}")
    protect = (roles.signal, roles.value, roles.value_num, roles.value_text, roles.timestamp)
    df, dropped = drop_sparse_columns(df, opts.drop_threshold, protect)
    if dropped:
        log.append(f"dropped sparse columns: {dropped}")
    plan = default_fill_plan(df, roles, opts)
    if plan:
        df = apply_fills(df, fit_fills(df, plan, opts), opts=opts)
        log.append(f"filled: {sorted(plan)}")
    if roles.shape == "signal_pool" and roles.value_num:
        targets = [roles.value_num]
    else:
        targets = [c for c in roles.numbers(opts) if c in df.columns]
    boolean = {c for c, k in kinds(df).items() if k == "boolean"}
    df, acted = treat_outliers(df, [c for c in targets if c not in boolean], opts)
    log += acted
    if opts.extract_calendar and roles.timestamp in df.columns \
            and kinds(df)[roles.timestamp] == "datetime":
        df = calendar_parts(df, roles.timestamp)
        log.append(f"calendar parts of {roles.timestamp}")
    return df, _without(roles, dropped), log


def _without(roles: Roles, dropped: list[str]) -> Roles:
    gone = set(dropped)
    lists = ("id", "numeric", "categorical", "datetime", "text", "mixed", "nested", "value_columns")
    return replace(roles, **{k: tuple(c for c in getattr(roles, k) if c not in gone) for k in lists})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; equal rows are combined before the shuffle."""
    return df.dropDuplicates()


def keep_first(df: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows over all other columns, keeping the first in ``order``.

    An aggregate (``min_by``) instead of a per-group sort, so a row copied a billion
    times is one partial row per task.
    """
    rest = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*[col(c) for c in order])).alias("_first")
    out = df.groupBy(*[col(c) for c in rest]).agg(first)
    return out.select(*[F.col("_first").getField(c).alias(c) if c in order else col(c) for c in df.columns])
