"""Session helpers of this subpackage: shipping its code, saved steps, size-checked id filters, run-wise maps."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators.windows import number_rows
from tablescope.plans.runtime import shared_dir
from tablescope.plans.runtime import ship_package as ship  # noqa: F401

#: An id list of at most this many rows (16 bytes each) may be broadcast.
BROADCAST_IDS = 2_000_000
#: Folders of saved steps, by open scope.
_SCOPES: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Write a step as Parquet into the shared checkpoint folder and read it back.

    Spark deletes the shuffle files of a finished step once the driver has collected its plan;
    asking for that here keeps the disk at one step's shuffles.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(step: DataFrame) -> None:
    """Delete a saved step that nothing reads any more."""
    spark = step.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(step._saved_at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Give an operator a scope for its saved steps: its result is written, then all inner steps are deleted.

    For operators whose result is small beside their steps. The result belongs to the scope around it, if there is one.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        spark, inner = docs.sparkSession, []
        _SCOPES.append(inner)
        try:
            out = operator(docs, *args, **options)
            _SCOPES.pop()
            result = saved(out)
        except BaseException:
            if _SCOPES and _SCOPES[-1] is inner:
                _SCOPES.pop()
            raise
        finally:
            for path in inner:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return result

    return run


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def told_apart(docs: DataFrame) -> tuple[DataFrame, str] | None:
    """None if every doc_id has one text. Else (docs, name): doc_id is a number of its own for each (doc_id, text), in
    the order of doc_id, then of the text's digest; the column called ``name`` keeps the doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = docs.select("doc_id", F.xxhash64(text).alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    if not marks.where("low <> high").take(1):
        return None
    kept, digest = free_name(docs, "_doc_id"), free_name(docs, "_digest")
    marked = docs.withColumnRenamed("doc_id", kept).withColumn(digest, F.md5(text))
    pairs = saved(marked.select(F.col(kept).alias("a"), F.col(digest).alias("b")).distinct())
    numbers = saved(number_rows(pairs, ["a", "b"], name="doc_id"))
    on = marked[kept].eqNullSafe(numbers["a"]) & (marked[digest] == numbers["b"])
    return marked.join(numbers, on).select("doc_id", kept, *[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]), kept


def by_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join with a saved id table: broadcast only if its counted size allows it."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, key, how)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty; other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def by_batch(fn: Callable[[pa.RecordBatch], dict], schema: str) -> Callable:
    """mapInArrow function from one that maps a small batch to columns."""
    from tablescope.llm.arrays import pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = fn(part)
                if out is not None and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out)

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows of equal key from key-sorted batches, as (table of whole runs, open).

    Tables hold many complete runs. A run longer than ``most`` rows is handed out in parts
    with ``open`` true, so memory stays bounded however frequent a key is.
    """
    held: list[pa.RecordBatch] = []
    held_key, held_rows, is_open = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = int(edges[0]) if len(edges) else len(keys)
        if held and held_key == keys[0]:
            held.append(batch.slice(0, first))
            held_rows += first
            lo = first
        else:
            lo = 0
        if held and (lo < len(keys) or held_key != keys[0]):
            yield pa.Table.from_batches(held), is_open
            held, held_rows, is_open = [], 0, False
        if lo < len(keys):
            last = int(edges[-1]) if len(edges) else 0
            last = max(last, lo)
            if last > lo:
                yield pa.Table.from_batches([batch.slice(lo, last - lo)]), False
            held, held_key, held_rows = [batch.slice(last)], keys[-1], len(keys) - last
        if most and held_rows > most:
            is_open = True
            yield pa.Table.from_batches(held), True
            held, held_rows = [held[0].slice(0, 0)], 0
    if held and held_rows:
        yield pa.Table.from_batches(held), is_open


#: Edges (16 bytes each) of a graph that one task may solve; larger graphs take distributed rounds.
TASK_EDGES = 2_000_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest reachable node of every node, by repeated minimum over edges and pointer jumps."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    sizes = [len(p[0]) for p in parts]
    ends, at = np.cumsum([n for s in sizes for n in (s, s)]), at.ravel()
    pieces_ = np.split(at, ends[:-1])
    a, b = np.concatenate(pieces_[0::2]), np.concatenate(pieces_[1::2])
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        new = np.minimum(new, new[new])
        new = new[label]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[label]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest reachable node, for nodes that have an edge (columns a, b).

    A graph of at most TASK_EDGES edges, counted first, is solved in one task. A larger one takes
    alternating large-star and small-star steps: each node hands its larger or smaller
    neighbours to the smallest one. No neighbour list is ever collected; the graph shrinks
    to stars in a logarithmic number of rounds.
    """
    ship(edges.sparkSession)
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    now = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if now.count() <= TASK_EDGES:
        return now.coalesce(1).mapInArrow(_solve, "node long, component long")
    before = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        pairs = both(now).toDF("n", "m")
        low = pairs.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = pairs.where("m > n").join(low, "n").select(F.col("low").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a < b").distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("a"), F.col("a").alias("b")).where("a < b")
        now = saved(small.union(low.select(F.col("low").alias("a"), "b")).distinct())
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = state
