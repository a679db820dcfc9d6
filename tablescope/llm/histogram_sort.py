"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by (hash of the text, hash of the id, copy number). The driver holds a probe
interval for each of the ``parts - 1`` splitters. A round counts, over all partitions, the exact bytes between
evenly spaced candidate boundaries in every open interval; a splitter is fixed once a
boundary lies within the tolerance of its share, else its interval shrinks to the keys between the two
boundaries around it. Only at most ``PROBES`` sums per round reach the driver, whatever the data. When all
splitters stand, rows are dealt to their shards in one exchange.

Equal texts are neighbours in that order and stay in one shard, unless keeping them whole
would move a boundary by more than ``GROUP_TOLERANCE`` of a shard; a text that fills several shards is divided
by id, and a repeated row by copy number. So a hot text needs no task of its own.

Inside a shard rows are numbered from 0, slice by slice of a hash of id and copy: a shard is
never sorted as a whole, and its order is a shuffle. Built-in functions only.

Defined results: null texts have no bytes and count as empty; a null id is an id like any other; equal rows are
separate rows with slots of their own; an empty table gives no rows; with fewer rows than shards some shards stay
empty, and a row larger than a shard fills it alone; other columns are ignored by the digest and kept by
``shard_documents``; reruns agree, however the input is dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import saved
from tablescope.plans.runtime import COPY_BLOCK, number_copies

#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: Byte sums that one round brings to the driver, at most.
PROBES = 4096
#: Distance of a splitter from its exact share, as a part of a shard.
TOLERANCE = 0.001
#: The same where it keeps equal texts together.
GROUP_TOLERANCE = 0.01
#: Rows of one slice of a shard, on average.
SLICE_ROWS = 20_000
#: Slice counts (24 bytes each) up to which they are broadcast.
BROADCAST_SLICES = 200_000
TOP = 2 ** 63 - 1


@dataclass(frozen=True)
class Splitter:
    """The first key of a shard: rows at or above it belong to that shard or a later one."""

    text_hash: int
    id_hash: int = 0
    copy: int = 0

    def reached(self, copy: Column) -> Column:
        t, i = F.col("text_hash"), F.col("id_hash")
        inside = (i > self.id_hash) | ((i == self.id_hash) & (copy >= self.copy))
        return (t > self.text_hash) | ((t == self.text_hash) & inside) if self.id_hash or self.copy else t >= self.text_hash


@dataclass(frozen=True)
class Interval:
    """Keys among which a splitter is looked for; ``text_hash`` is set once they all share it."""

    low: int
    high: int
    before: int  # bytes below the interval
    text_hash: int | None = None

    @property
    def key(self) -> str:
        return "text_hash" if self.text_hash is None else "id_hash"

    def holds(self) -> Column:
        inside = F.col(self.key).between(self.low, self.high)
        return inside if self.text_hash is None else (F.col("text_hash") == self.text_hash) & inside

    def splitter(self, key: int) -> Splitter:
        return Splitter(key) if self.text_hash is None else Splitter(self.text_hash, key)


def _hash(c: Column) -> Column:
    """63 bits, so that differences of two keys fit a long."""
    return F.xxhash64(c).bitwiseAND(F.lit(TOP))


def with_keys(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``text_hash``, ``id_hash`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), _hash(text).alias("text_hash"), _hash(F.col("doc_id").cast("long")).alias("id_hash"))


def counted_keys(docs: DataFrame) -> DataFrame:
    """The keys of all rows, equal ones counted in ``copies``: what the probing rounds read. No text travels."""
    keys = with_keys(docs)
    return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("copies"))


def find_splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> list[Splitter]:
    """The ``parts - 1`` first keys of shards 1, 2, ... (none for an empty table)."""
    bytes_of = F.col("size") * F.col("copies")
    total = keys.agg(F.sum(bytes_of)).first()[0] or 0
    if not total:
        return []
    share = [total * i / parts for i in range(1, parts)]
    near, near_group = tolerance * total / parts, group_tolerance * total / parts
    found: dict[int, Splitter] = {}
    at = {i: Interval(0, TOP, 0) for i in range(parts - 1)}
    while at:
        open_now = list(dict.fromkeys(at.values()))
        probes = PROBES // len(open_now)
        steps = [(x.high - x.low) // probes + 1 for x in open_now]
        cell = F.lit(None).cast("long")
        for n, (x, step) in enumerate(zip(open_now, steps)):
            cell = F.when(x.holds(), F.expr(f"{n * probes} + ({x.key} - {x.low}L) div {step}L")).otherwise(cell)
        picked = keys.select(cell.cast("long").alias("cell"), "text_hash", "id_hash", bytes_of.alias("bytes"), "size").where("cell IS NOT NULL")
        sums = picked.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.min("text_hash").alias("t0"), F.max("text_hash").alias("t1"),
                                          F.min("id_hash").alias("i0"), F.max("id_hash").alias("i1"), F.min("size").alias("s0"), F.max("size").alias("s1"))
        rows: dict[int, list] = {}
        for r in sorted(sums.collect(), key=lambda r: r.cell):
            rows.setdefault(r.cell // probes, []).append(r)
        for i, x in list(at.items()):
            n = open_now.index(x)
            below = x.before
            for r in rows.get(n, []):
                if below + r.bytes > share[i]:
                    break
                below += r.bytes
            else:
                # nothing lies above the share: the splitter is the end of the interval
                found[i] = x.splitter(min(x.high + 1, TOP))
                del at[i]
                continue
            first = x.low + (r.cell % probes) * steps[n]
            edges = (share[i] - below, below + r.bytes - share[i])
            after = x.splitter(min(first + steps[n], TOP))
            whole_text = x.text_hash is None and r.t0 == r.t1
            if min(edges) <= (near_group if whole_text else near):
                found[i] = x.splitter(first) if edges[0] <= edges[1] else after
            elif whole_text:
                at[i] = Interval(0, TOP, below, r.t0)
                continue
            elif x.text_hash is not None and r.i0 == r.i1:
                # one id: whole copies up to the share; rows that merely share both hashes are not divided
                copy = round(edges[0] / r.s0) if r.s0 == r.s1 else 0
                found[i] = Splitter(x.text_hash, r.i0, copy) if r.s0 == r.s1 or edges[0] <= edges[1] else after
            else:
                low, high = (r.t0, r.t1) if x.text_hash is None else (r.i0, r.i1)
                at[i] = Interval(low, high, below, x.text_hash)
                continue
            del at[i]
    return [found[i] for i in sorted(found)]


def shard_of(splitters: list[Splitter], copy: Column) -> Column:
    """Number of splitters at or below a row's key."""
    out = F.lit(0)
    for s in splitters:
        out = out + s.reached(copy).cast("int")
    return out.cast("int")


def _each_copy(counted: DataFrame) -> DataFrame:
    """One row per copy, numbered from 0 in ``copy``; a row with very many copies is cut in blocks first."""
    zero, last = F.lit(0).cast("long"), F.col("copies") - 1
    few = counted.where(F.col("copies") <= COPY_BLOCK).withColumn("copy", F.explode(F.sequence(zero, last)))
    blocks = (counted.where(F.col("copies") > COPY_BLOCK)
              .withColumn("block", F.explode(F.sequence(zero, F.expr(f"(copies - 1) div {COPY_BLOCK}")))).repartition("block", "id_hash"))
    start = F.col("block") * COPY_BLOCK
    many = blocks.withColumn("copy", F.explode(F.sequence(start, F.least(start + COPY_BLOCK - 1, last)))).drop("block")
    return few.unionByName(many).drop("copies")


def shards(docs: DataFrame, parts: int = 24, tolerance: float = TOLERANCE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (position in the shard, from 0)."""
    keys = saved(counted_keys(docs))
    splitters = find_splitters(keys, parts, tolerance)
    n_rows = keys.agg(F.sum("copies")).first()[0] or 0
    slices = max(1, -(-n_rows // (parts * slice_rows)))
    rows = _each_copy(keys).withColumn("shard", shard_of(splitters, F.col("copy")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id_hash", "copy", "text_hash"), F.lit(slices)))
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    before = saved(before)
    before = F.broadcast(before) if parts * slices <= BROADCAST_SLICES else before
    within = Window.partitionBy("shard", "slice").orderBy("id_hash", "text_hash", "doc_id", "size", "text_crc32", "copy")
    placed = rows.withColumn("nth", F.row_number().over(within)).join(before, ["shard", "slice"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, parts: int = 24, tolerance: float = TOLERANCE, splitters: list[Splitter] | None = None) -> DataFrame:
    """The documents with all their columns and ``shard``, dealt out by shard in one exchange.

    Splitters may be handed in, so that later documents go by the same boundaries. A column
    of the input that is called ``shard`` comes out as ``shard_in``.
    """
    if splitters is None:
        splitters = find_splitters(saved(counted_keys(docs)), parts, tolerance)
    docs = docs.withColumnRenamed("shard", "shard_in")
    names = docs.columns
    # equal rows need numbers only where a splitter divides copies
    rows = number_copies(docs, "_copy") if any(s.copy for s in splitters) else docs.withColumn("_copy", F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _hash(text).alias("text_hash"),
                         _hash(F.col("doc_id").cast("long")).alias("id_hash"), (F.col("_copy") - 1).alias("copy"))
    dealt = packed.withColumn("shard", shard_of(splitters, F.col("copy")))
    return dealt.repartition(F.col("shard"), F.pmod(F.col("id_hash"), F.lit(16))).select("row.*", "shard")


def write_shards(docs: DataFrame, path: str, parts: int = 24, **options) -> None:
    """The documents as Parquet files under ``path/shard=N``."""
    shard_documents(docs, parts, **options).write.partitionBy("shard").parquet(path)
