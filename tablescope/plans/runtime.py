"""Session helpers: lineage cuts and size-checked lookups."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.exprs import col, row_hash
from tablescope.options import Options


#: Most keys that are treated as hot; a part of the rows that is smaller than one in so many is not.
HOT_KEYS = 50_000
#: Parts that rows with a null key are dealt to.
NULL_SALTS = 10_000
FIXED_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a fresh folder under /tmp.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and fixes partition ids."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table_bytes(table: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a computed table; texts by their exact lengths, other values by the size of their type."""
    long = [f.name for f in table.schema if not isinstance(f.dataType, FIXED_TYPES)]
    nested = {f.name for f in table.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    text = lambda c: F.to_json(F.struct(col(c))) if c in nested else col(c).cast("string")
    sizes = [F.coalesce(F.sum(F.octet_length(text(c))), F.lit(0)) for c in long] or [F.lit(0)]
    found = table.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(sizes)]).first()
    return found["n"], sum(found[1:]) + found["n"] * 16 * len(table.columns)


def hot_keys(df: DataFrame, keys: list[str], opts: Options = Options()) -> DataFrame:
    """(keys..., _copies) of the keys with more than ``hot_rows`` rows; at most HOT_KEYS keys, whatever the table.

    Keys are counted, combined before the shuffle. Keys with a null match nothing and are not listed.
    """
    counts = materialize(df.select(*[col(k) for k in keys]).dropna().groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # no more than HOT_KEYS keys can each hold one part in HOT_KEYS of all rows
    least = max(opts.hot_rows, total // HOT_KEYS)
    return counts.where(F.col("_n") > least).withColumn("_copies", F.ceil(F.col("_n") / least).cast("int")).drop("_n")


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
                opts: Options = Options(), bounded: bool = False) -> DataFrame:
    """Join rows to a one-row-per-key table.

    The table is computed once and measured; when few and short rows it is broadcast, so a
    hot key costs nothing. Otherwise keys are counted: a key with very many rows is copied as often as its count
    asks for, and its rows are spread over the copies by their own hash; all other keys are joined as they are.
    Rows whose key is null are spread as well. ``bounded`` says the size has a fixed limit and needs no check.
    """
    if bounded:
        return df.join(F.broadcast(table), keys, how)
    table = materialize(table)
    rows, size = table_bytes(table)
    if rows <= opts.broadcast_rows and size <= opts.broadcast_bytes:
        return df.join(F.broadcast(table), keys, how)
    hot = materialize(hot_keys(df, keys, opts))
    nothing = reduce(or_, [col(k).isNull() for k in keys])
    if hot.take(1):
        salted = df.join(F.broadcast(hot), keys, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
        copies = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    else:
        salted, copies = df.withColumn("_copies", F.lit(1)), table.withColumn("_salt", F.lit(0))
    draw = row_hash(df, 7)
    salted = salted.withColumn("_salt", F.when(nothing, F.pmod(draw, F.lit(NULL_SALTS))).otherwise(F.pmod(draw, F.col("_copies"))).cast("int")).drop("_copies")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def semi_join(df: DataFrame, table: DataFrame, keys: list[str],
              opts: Options = Options(), bounded: bool = False) -> DataFrame:
    """Keep rows whose key appears in ``table`` (one row per key)."""
    return lookup_join(df, table.select(*[col(k) for k in keys]), keys, "left_semi", opts, bounded)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that tasks can import it there."""
    if getattr(spark.sparkContext, "_tablescope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "tablescope_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._tablescope_shipped = True


#: Copies of one row that a task writes out in one go.
COPY_BLOCK = 100_000


def number_copies(df: DataFrame, name: str = "_copy") -> DataFrame:
    """The same rows, with equal rows numbered from 1, so that a hash can tell them apart.

    Equal rows are counted (combined before the shuffle) and written out again; a row with
    very many copies is cut in blocks that are spread over the tasks.
    """
    odd = [f.name for f in df.schema if isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [F.to_json(F.struct(col(c))).alias(f"_k{i}") if c in odd else col(c) for i, c in enumerate(df.columns)]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(col(c)).alias(c) for c in odd])
    counted = counted.select(*[col(c) for c in df.columns], "_n")
    one = F.lit(1).cast("long")
    few = counted.where(F.col("_n") <= COPY_BLOCK).withColumn(name, F.explode(F.sequence(one, F.col("_n"))))
    blocks = (counted.where(F.col("_n") > COPY_BLOCK)
              .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPY_BLOCK)))).repartition("_b", "_n"))
    many = blocks.withColumn(name, F.explode(F.sequence(F.col("_b") * COPY_BLOCK + 1, F.least((F.col("_b") + 1) * COPY_BLOCK, F.col("_n"))))).drop("_b")
    return few.unionByName(many).drop("_n")


def copy_hash(df: DataFrame, columns: list[str], seed: int, name: str = "_copy") -> Column:
    """Reproducible 64-bit hash of a numbered row, different for each copy."""
    return F.xxhash64(row_hash(df.select(*[col(c) for c in columns]), seed), F.col(name))
