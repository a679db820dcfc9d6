"""Mixing sources to target weights by weighted fair queueing.

Every source has a flow of documents, shuffled by a seeded hash and repeated up to
``epochs`` times. A document's virtual finish time is the words its source has sent up to its
end, divided by the source's target. All flows are put in one order of finish times, and the
mix is what comes before the total budget: since every target is reached at time 1, each
source's share comes out within half a document of its target.

Running sums never sort a source (or the whole mix) in one task: documents are put in equal
slices of the hash (or of time), slice totals are summed up, and only the rows of one slice
are ordered.

Targets. Sources get weights in order of code point, null last, from a repeating list; the
budget is a percentage of all words. Targets are ``least(epochs * size, level * weight)`` with
the level that spends the budget, so capped sources hand on their excess by weight. The table
of sources (one row each) is small; nothing else is ordered in one place.

Defined results: null and empty texts have size 0 and are never taken; the null source is a
source; rows with one doc_id (repeated rows) are separate documents and give separate rows;
an empty table gives no rows; ties in the hash go by doc_id and copy number; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import by_ids, free_name, saved, tidy
from tablescope.operators.windows import group_index

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
EPOCHS = 2
SEED = 20240229
#: Rows of one slice of a running sum, on average.
SLICE_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def running_sum(rows: DataFrame, groups: list[str], slice_of: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add the running sum of ``value`` (own row included) per group; ``slice_of`` must rise with ``order``."""
    rows = rows.withColumn("_slice", slice_of)
    totals = rows.groupBy(*groups, "_slice").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(
        Window.partitionBy(*groups, F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    # null-safe on the groups: the null source is a source
    left, right = rows.alias("l"), before.alias("r")
    match = F.col("l._slice") == F.col("r._slice")
    for g in groups:
        match = match & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = left.join(right, match, "left").select("l.*", "r._before")
    within = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum(value).over(within)).drop("_slice", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source, from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("fill", F.col("cap") / F.col("w"))
    # sources fill up in order of cap / weight; the level is set by the first that need not fill
    order = Window.orderBy("fill", F.col("source").isNull(), "source")
    per = per.withColumn("spent", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(percent / 100)
    per = per.withColumn("level", (total - F.col("spent")) / F.col("open_w"))
    per = per.withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("nth", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    per = per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))))
    return per.select("source", "source_size", "target")


@tidy
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, copy (number among rows equal in these), source_size, target, taken,
    first_finish (virtual time, null if not taken)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"))
    # equal rows get a number, so that each is one document
    base = saved(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"))
                 .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy")))
    targets = saved(source_targets(base, weights, percent, epochs))
    rows = max(base.count(), 1)
    slices = max(1, -(-rows * epochs // SLICE_ROWS))
    queue = (base.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
             .withColumn("draw", F.xxhash64("doc_id", "copy", "epoch", F.lit(seed))))
    # an epoch begins when the one before is over; inside it the hash gives the order
    share = (F.col("draw").cast("double") / F.lit(2.0 ** 64) + 0.5) * F.lit(slices)
    queue = running_sum(queue, ["source"], F.col("epoch") * F.lit(slices + 1) + F.floor(share), ["epoch", "draw", "doc_id", "copy"], "size", "sent")
    t = targets.select(F.col("source").alias("s"), "target", "source_size")
    queue = queue.join(F.broadcast(t) if t.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    queue = saved(queue.where("target > 0").withColumn("finish", (F.col("sent") - F.col("size") / 2) / F.col("target")))
    # one global order of finish times, cut off at the budget
    budget = targets.agg(F.sum("target").alias("budget"))
    ordered = running_sum(queue.where("finish <= 1.5"), [], F.floor(F.col("finish") * F.lit(slices)), ["finish", "source", "doc_id", "copy", "epoch"], "size", "total")
    taken = (ordered.crossJoin(F.broadcast(budget)).where("total - size / 2 <= budget")
             .groupBy("doc_id", "source", "size", "copy").agg(F.sum("size").alias("taken"), F.min("finish").alias("first_finish")))
    b, k, g = base.alias("b"), taken.alias("k"), t.alias("g")
    same = ((F.col("b.doc_id").eqNullSafe(F.col("k.doc_id"))) & (F.col("b.copy") == F.col("k.copy")) & (F.col("b.size") == F.col("k.size"))
            & F.col("b.source").eqNullSafe(F.col("k.source")))
    return (b.join(k, same, "left").join(g, F.col("b.source").eqNullSafe(F.col("g.s")))
            .select("b.doc_id", "b.source", "b.size", "b.copy", "g.source_size", "g.target",
                    F.coalesce("k.taken", F.lit(0)).cast("long").alias("taken"), "k.first_finish"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents taken, in order of finish time, with ``size``, ``taken`` and ``epochs`` (copies in the mix).

    Rows with one doc_id are separate documents; those that also share source and size are numbered by their content.
    Columns of the input that are called like the new ones come out as ``<name>_in``.
    """
    for name in ("size", "taken", "epochs"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"{name}_in")
    names = docs.columns
    plan = mix(docs, **options)
    # nulls are equal here, so the key is two hashes of 64 bits
    key = lambda seed, size: F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("source").cast("string"), size)
    k, k2, c = (free_name(docs, n) for n in ("_mix_key", "_mix_key2", "_mix_copy"))
    wanted = plan.select(key(1, F.col("size")).alias(k), key(2, F.col("size")).alias(k2), F.col("copy").alias(c), "size", "taken", F.col("first_finish").alias("_finish"))
    size = word_count(F.col("text"))
    rows = docs.withColumn(k, key(1, size)).withColumn(k2, key(2, size))
    several = saved(wanted.where(F.col(c) > 1).select(k).distinct())
    wanted = wanted.where("taken > 0")
    if several.take(1):
        few = by_ids(rows, several, "left_anti", k).withColumn(c, F.lit(1).cast("long"))
        many = group_index(by_ids(rows, several, "left_semi", k), [k], ["doc_id"], c)
        rows = few.unionByName(many.withColumn(c, F.col(c).cast("long") + 1))
    else:
        rows = rows.withColumn(c, F.lit(1).cast("long"))
    out = rows.join(wanted, [k, k2, c]).withColumn("epochs", F.expr("cast(taken div size as int)"))
    return (out.repartitionByRange("_finish", "doc_id").sortWithinPartitions("_finish", "doc_id")
            .select(*[F.col(f"`{n}`") for n in names], "size", "taken", "epochs"))
