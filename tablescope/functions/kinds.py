"""Physical column kinds, read off the Spark schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema}


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns without booleans."""
    return [n for n, k in kinds(df).items() if k == "numeric"]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, k in kinds(df).items() if k == "text"]
