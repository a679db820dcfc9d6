"""Reading and writing tables: CSV, TSV, JSON, Parquet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.exprs import nan_to_null
from tablescope.plans.runtime import ship_package

# Suffixes that can be read, and encodings in the order they are tried.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson",
           ".parquet": "parquet"}
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin1")
# Java names of the encodings for the CSV reader.
JAVA_CHARSETS = {"utf-8": "UTF-8", "cp949": "MS949", "euc-kr": "EUC-KR", "latin1": "ISO-8859-1"}


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _path(spark, path)
    return bool(fs.globStatus(jpath))


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name[name.rfind("."):] if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"cannot read {path!r}: allowed suffixes are {sorted(FORMATS)}")
    return FORMATS[suffix]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of all bytes of all files: UTF-8, or the first one of the list that decodes them.

    Lines are read as raw bytes and checked on the executors. Files of plain ASCII fit any
    encoding; files that need different ones are an error.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), "value")
    valid = F.is_valid_utf8("value")
    wide = F.octet_length("value") > F.char_length("value")
    ship_package(spark)
    others = [e for e in ENCODINGS if e != "utf-8"]

    def decodable(batches):
        for batch in batches:
            for e in others:
                batch[e] = [_decodes(bytes(b), e) for b in batch["raw"]]
            yield batch[["file", *others]]

    plain = lines.groupBy("file").agg(F.bool_or(valid & wide).alias("wide"), F.bool_or(~valid).alias("broken")).collect()
    broken = [r["file"] for r in plain if r["broken"]]
    found = {"utf-8" for r in plain if r["wide"] and not r["broken"]}
    if broken:
        schema = "file string, " + ", ".join(f"`{e}` boolean" for e in others)
        bad = lines.where(~valid).select("file", F.col("value").cast("binary").alias("raw")).mapInPandas(decodable, schema)
        for r in bad.groupBy("file").agg(*[F.bool_and(f"`{e}`").alias(e) for e in others]).collect():
            found.add(next(e for e in others if r[e]))
    if len(found) > 1:
        raise ValueError(f"files under {path!r} need different encodings: {sorted(found)}")
    return found.pop() if found else ENCODINGS[0]


def _decodes(raw: bytes, encoding: str) -> bool:
    try:
        raw.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether every line that isn't blank holds a whole JSON value (one object per line, as written here)."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "")
    whole = F.col("value").rlike(r"^\s*[\[{].*[\]}]\s*$") & F.get_json_object("value", "$").isNotNull()
    return lines.agg(F.coalesce(F.bool_and(whole), F.lit(True))).first()[0]


def read_table(spark: SparkSession, path: str | list[str], fmt: str | None = None,
               encoding: str | None = None, schema=None, multiline: bool | None = None) -> DataFrame:
    """One lazy scan for every size; several paths are united by column name.

    The format comes from the suffix, the text encoding from all bytes, and whether ``.json``
    holds one object per line from all lines. Float NaN
    becomes null. Pass ``schema`` to skip type inference, which reads text data twice.
    """
    if isinstance(path, (list, tuple)):
        parts = [read_table(spark, p, fmt, encoding, schema, multiline) for p in path]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fmt = fmt or format_of(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt in ("csv", "tsv"):
        encoding = encoding or detect_encoding(spark, path)
        if encoding in ("cp949", "euc-kr"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("header", True).option("encoding", JAVA_CHARSETS.get(encoding, encoding))
        reader = reader.option("sep", "\t" if fmt == "tsv" else ",").option("quote", '"').option("escape", '"')
        if multiline:
            reader = reader.option("multiLine", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "json":
        whole = not is_json_lines(spark, path) if multiline is None else multiline
        df = reader.option("multiLine", whole).json(path)
    elif fmt == "ndjson":
        df = reader.json(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return nan_to_null(df)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """``(name, extension, size_mb, modified)`` per file; file contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "modificationTime", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.regexp_extract(name, r"(\.[^.]+)$", 1).alias("extension"),
                        (F.col("length") / (1024 * 1024)).alias("size_mb"),
                        F.col("modificationTime").alias("modified"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False,
                mode: str = "errorifexists") -> str:
    """Write a directory of part files; one file only on request and only for small tables."""
    writer = (df.coalesce(1) if single_file else df).write.mode(mode)
    if fmt in ("csv", "tsv"):
        # Embedded quotes are doubled; empty text reads back as null.
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",") \
              .option("quote", '"').option("escape", '"').csv(path)
    elif fmt in ("json", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return path


def write_features(df: DataFrame, folder: str, name: str, now: datetime | None = None) -> str:
    """Final feature table as CSV under ``<folder>/datasets`` with a time stamp in its name."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return write_table(df, f"{folder}/datasets/feature_{name}_{stamp}.csv", "csv")
