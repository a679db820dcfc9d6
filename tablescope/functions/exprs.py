"""Null-safe column expressions with the numeric rules the package relies on."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: text that counts as a number ------------------------------
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_STARTS = tuple("0123456789+-.iI")
INFINITY_PATTERN = r"^[+-]?(inf|infinity)$"

# --- fixed values: accepted date layouts (shape of the text, Spark format) ---
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^(1[7-9]|2[01])\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "yyyyMMdd"),
    (r"^(1[7-9]|2[01])\d{2}$", "yyyy"),
)


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_number(c: Column) -> Column:
    """Text to double; null for anything that is not plainly a number.

    ``try_cast`` alone accepts ``10d`` and ``1f``, so the text is matched first.
    ``nan`` is a missing value, ``inf`` is a number.
    """
    text = F.trim(c)
    infinity = F.when(text.startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
    # Prose is ruled out by its first character, before any pattern sees the whole text.
    first = F.substring(text, 1, 1)
    return (
        F.when(~first.isin(*NUMBER_STARTS), F.lit(None).cast("double"))
        .when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
        .when(F.lower(text).rlike(INFINITY_PATTERN), infinity)
    )


def is_number(c: Column) -> Column:
    return parse_number(c).isNotNull()


def parse_date(c: Column, layouts: Iterable[tuple[str, str]] = DATE_FORMATS) -> Column:
    """First layout whose shape matches; null when none does."""
    text = F.trim(c)
    out = None
    for shape, fmt in layouts:
        step = F.try_to_timestamp(text, F.lit(fmt))
        out = F.when(text.rlike(shape), step) if out is None else out.when(text.rlike(shape), step)
    return out


def clip(c: Column, lower, upper) -> Column:
    """Clip that keeps nulls (``least``/``greatest`` skip them)."""
    lower = lower if isinstance(lower, Column) else F.lit(lower)
    upper = upper if isinstance(upper, Column) else F.lit(upper)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lower), upper))


def outside(c: Column, lower, upper) -> Column:
    """True/false outlier test, false for nulls."""
    lower = lower if isinstance(lower, Column) else F.lit(lower)
    upper = upper if isinstance(upper, Column) else F.lit(upper)
    return F.coalesce((c < lower) | (c > upper), F.lit(False))


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness (G1); zero for constants, null under three values."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); zero for constants, null under four values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    scale = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    corrected = scale * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: float NaN becomes null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({name: F.when(~F.isnan(col(name)), col(name)) for name in floats})


def row_hash(df: DataFrame, seed: int) -> Column:
    """Reproducible 64-bit hash of a whole row; drives samples and splits."""
    parts = [F.to_json(F.struct(col(f.name))) if isinstance(f.dataType, (T.MapType, T.VariantType))
             else col(f.name) for f in df.schema]
    return F.xxhash64(F.lit(seed), *parts)


def digest(c: Column) -> Column:
    """Short stand-in for text in counting shuffles.

    Up to 64 characters the text itself; beyond that a SHA-256 with a prefix, 71
    characters, so it cannot meet a short text.
    """
    return F.when(F.length(c) <= 64, c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))
