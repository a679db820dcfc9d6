"""N-gram Jaccard join: prefix trees over globally ordered n-gram sets.

Order. Grams are 64-bit hashes and their numeric order is the global order. A set is a path
in a prefix tree.

Where paths can meet. Two linked sets of sizes a and b differ in at most
(1 - t) / (1 + t) * (a + b) grams. The global order is cut into more ranges than that, so
linked paths run through at least one identical, non-empty range. Each set emits one key per
range (the digest of its grams there), for its size class and the next one, since linked
sizes are in the same or in neighbouring classes. A frequent gram alone makes no key, so
common lines and passages don't collect unrelated texts. From its own size a set knows how many
of its ranges every linked set must have, too: all but the most grams in which they can
differ. Its keys go on only if at least so many of them are shared with others.

Trees. A block holds at most ``block`` sets. It is stored as a compressed trie over the
ordered sets; each set walks down the trie, shares the overlap counted for a common path among
all sets below it, and leaves a subtree when the grams that remain cannot reach the
required overlap, or when all of it is already in the walker's component.

Groups of any size. Sets that shared keys connect form a family; a family of at most ``block``
sets is one tree. In larger ones every set first joins the tree of the smallest set it shares
most keys with (split in blocks that repeat that one set). Keys, or families of up to
``FAMILY_BLOCKS`` blocks, whose sets are then still in several components get complete
treatment: their sets are cut in blocks, and every pair of blocks is joined, except pairs
inside one component. No pair list of a group is ever made, and no candidate is dropped.

Defined results: null and empty texts have no set and are alone; equal sets are one class, so
repeated texts cost one member; ties go to the smallest id; rows with one doc_id and different texts are
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import Words, grams, pieces, text_bytes
from tablescope.llm.common import by_ids, clean_documents, components, discard, runs, saved, ship, tidy, told_apart


#: Shared keys that may be broadcast (about 40 bytes each).
BROADCAST_KEYS = 500_000
#: Families of up to this many blocks are completed as one, larger ones key by key.
FAMILY_BLOCKS = 16
#: Parts that keys are dealt to by their bits 1 to 3. More than PART_KEYS of them are grouped part by part, so that the
#: disk holds the shuffled keys of one part at a time (of two, until Spark has deleted the first).
KEY_PARTS, PART_KEYS = 8, 5_000_000
#: Copies of sets that one pass over blocks may shuffle: so many times all sets, or so many grams if that is more.
PASS_SETS, PASS_GRAMS = 2, 8_000_000


def gram_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ordered set of n-gram hashes) for each text that has a word; shorter texts are one gram."""
    buf, at = text_bytes(batch.column("text"))
    words = Words(buf, at)
    windows = grams(words.hash, n)
    for row in range(len(at) - 1):
        lo, hi = words.first[row], words.first[row + 1]
        if hi - lo >= n:
            yield row, np.unique(windows[lo: hi - n + 1])
        elif hi > lo:
            yield row, grams(words.hash[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo)


class Ranges:
    """Size classes and the number of ranges of each, for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        # class i: sizes in [bounds[i], bounds[i + 1]); a link spans one border at most
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // percent)))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def differ(self, i: int) -> int:
        """The most grams in which two linked sets can differ if both are in class i or i + 1."""
        top = self.bounds[min(i + 2, len(self.bounds) - 1)] - 1
        return (100 - self.percent) * 2 * top // (100 + self.percent)

    def needed(self, i: int, size: int, filled: int) -> int:
        """Non-empty ranges that any linked set of class i or i + 1 shares with one of this size, by keys of class i.

        If the set is in class i + 1, the partner is in class i: two of class i + 1 meet by the keys of that class.
        """
        top = self.bounds[min(i + 1 + (self.of(size) == i), len(self.bounds) - 1)] - 1
        partner = min(top, size * 100 // self.percent)
        return max(filled - (100 - self.percent) * (size + partner) // (100 + self.percent), 1)

    def count(self, i: int) -> tuple[int, int]:
        """(ranges, empty ranges a set may have): ranges = differences + 1 + empty ones."""
        d = self.differ(i)
        expected = (d + 1) * np.exp(-self.bounds[i] / (d + 1))
        spare = 0 if d == 0 else int(np.ceil(expected + 4 * np.sqrt(expected) + 2))
        return d + 1 + spare, spare


def range_keys(grams_: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, list[int]]:
    """The keys of one ordered set for its own size class and the one below, and how many of each must be shared.

    The lowest bit of a key tells the two classes apart; the numbers are in the order of that bit.
    """
    out, needs = [], [1, 1]
    own = ranges.of(len(grams_))
    for i in (own - 1, own):
        if i < 0:
            continue
        count, spare = ranges.count(i)
        part = (grams_ // np.uint64(((1 << 64) - 1) // count + 1)).astype(np.int64) if count > 1 else np.zeros(len(grams_), np.int64)
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        with np.errstate(over="ignore"):
            digest = np.add.reduceat(grams_ * (grams_ | np.uint64(1)), begins)
            digest = digest ^ (digest >> np.uint64(29))
            digest = digest * np.uint64(0xBF58476D1CE4E5B9) + part[begins].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            digest = (digest ^ (digest >> np.uint64(32))) * np.uint64(2 * i + 0x9E3779B97F4A7C15)
        out.append(digest & ~np.uint64(1) | np.uint64(i & 1))
        needs[i & 1] = ranges.needed(i, len(grams_), len(begins))
        if count - len(begins) > spare:
            # so many empty ranges that two sets might agree in empty ones only
            out.append(np.array([i], np.uint64))
    return np.concatenate(out).astype(np.int64), needs


class Tree:
    """Compressed trie of ordered sets, as sorted paths; joins them with each other."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int, known: list[int]):
        order = sorted(range(len(ids)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.ids, self.sets = [ids[k] for k in order], [sets[k] for k in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent
        self.parent = list(range(len(ids)))
        first: dict[int, int] = {}
        for k, c in enumerate(known[k] for k in order):
            if (f := first.setdefault(c, k)) != k:
                self.union(f, k)
        self.given = [self.find(k) for k in range(len(ids))]

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _children(self, lo: int, hi: int, depth: int) -> tuple[int, list[tuple[int, int]]]:
        """Depth to which sets lo..hi share one path, and the ranges of sets by their next gram."""
        a, b = self.sets[lo], self.sets[hi - 1]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        parts, k = [], lo
        while k < hi and len(self.sets[k]) == end:
            k += 1
        if k > lo:
            parts.append((lo, k))
        while k < hi:
            gram, left, right = self.sets[k][end], k, hi
            while left + 1 < right:  # last set with the same next gram
                mid = (left + right) // 2
                left, right = (mid, right) if self.sets[mid][end] == gram else (left, mid)
            parts.append((k, left + 1))
            k = left + 1
        return end, parts

    def join(self) -> list[tuple[int, int]]:
        """Union all linked sets; edges (id, smallest id of its part) for parts of several sets."""
        nodes: dict[tuple[int, int, int], tuple[int, list[tuple[int, int]]]] = {}
        t = self.percent
        low, high = {}, {}
        for probe in range(len(self.ids)):
            path, size = self.sets[probe], len(self.sets[probe])
            stack = [(0, len(self.ids), 0, 0, 0)]
            while stack:
                lo, hi, depth, overlap, place = stack.pop()
                hi = min(hi, probe)  # each pair once: the earlier set is below, the later one walks
                if lo >= hi:
                    continue
                root = self.find(probe)
                if all(self.find(k) == root for k in range(lo, hi)):
                    continue
                key = (lo, hi)
                if key not in low:
                    low[key], high[key] = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
                if (node := nodes.get((lo, hi, depth))) is None:
                    node = nodes[lo, hi, depth] = self._children(lo, hi, depth)
                end, parts = node
                if end > depth:
                    label = self.sets[lo][depth:end]
                    where = np.searchsorted(path, label)
                    overlap += int(np.count_nonzero(path[np.minimum(where, size - 1)] == label))
                    place = int(np.searchsorted(path, label[-1], "right"))
                # the best any set below can do: all its remaining grams, or all of the walker's
                best = overlap + min(size - place, high[key] - end)
                least = -(-t * (size + max(low[key], -(-t * size // 100))) // (100 + t))
                if best < least or high[key] * 100 < t * size or low[key] * t > 100 * size:
                    continue
                if len(parts) == 1 and len(self.sets[lo]) == end:
                    if 100 * overlap >= t * (size + end - overlap):
                        for k in range(lo, hi):
                            self.union(probe, k)
                    continue
                stack.extend((a, b, end, overlap, place) for a, b in reversed(parts))
        best: dict[int, int] = {}
        for k in range(len(self.ids)):
            r = self.find(k)
            best[r] = min(best.get(r, self.ids[k]), self.ids[k])
        return [(self.ids[k], best[self.find(k)]) for k in range(len(self.ids)) if self.ids[k] != best[self.find(k)]]


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Join the sets of every block (columns block, rep, known, set); edges a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, "block"):
            blocks = table.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
            reps, known = table.column("rep").to_numpy(), table.column("known").to_numpy()
            sets = table.column("set").combine_chunks()
            links = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    of = {int(reps[k]): k for k in range(lo, hi)}
                    rows_ = list(of.values())
                    links += Tree(list(of), [np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in rows_], percent,
                                  [int(known[k]) for k in rows_]).join()
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def _by_key(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Join with a saved list of shared keys: broadcast only if its counted size allows it."""
    return rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared, "key")


def _blocks_in_passes(placed: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The edges of all blocks in ``placed`` (block, rep, known). Blocks that copy many sets are joined in several passes.

    A set has a copy in each block it is in, and a set of many open keys is in many blocks. The copies of a pass are
    bounded by the sets there are, whatever their number, and each pass deletes its copies. ``sizes`` (rep, size) counts grams.
    """
    placed = saved(placed)
    reps = placed.select("rep").distinct()
    copied = placed.join(sizes, "rep").agg(F.sum("size")).first()[0] or 0
    there = sizes.join(sets.select("rep"), "rep").agg(F.sum("size")).first()[0] or 0
    passes = max(1, -(-copied // max(PASS_SETS * there, PASS_GRAMS)))
    if passes > 1:
        sets = saved(by_ids(sets, saved(reps), "left_semi", "rep"))
    edges = [saved(_blocks(placed.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == i).join(sets, "rep")
                           .select("block", "rep", "known", "set"), percent)) for i in range(passes)]
    return reduce(DataFrame.union, edges)


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (equal sets), component_id (links of percent / 100 or more).

    Rows with one doc_id and different texts are documents of their own.
    """
    if (apart := told_apart(docs)) is None:
        return _classes(docs, n, percent, block)
    docs, kept = apart
    found = _classes(docs, n, percent, block)
    ids = saved(docs.select("doc_id", F.col(kept).alias("was")).distinct())
    back = lambda name: ids.select(F.col("doc_id").alias(name), F.col("was").alias(f"{name}_was"))
    for name in ("doc_id", "class_id", "component_id"):
        found = found.join(back(name), name)
    return found.select(F.col("doc_id_was").alias("doc_id"), "n_shingles", F.col("class_id_was").alias("class_id"), F.col("component_id_was").alias("component_id"))


@tidy
def _classes(docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    docs = clean_documents(docs)
    ranges = Ranges(percent)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("doc_id").to_pylist()
                size, digest, needs, count = [0] * len(ids), [None] * len(ids), [None] * len(ids), [0] * len(ids)
                keys = [[None] * len(ids) for _ in range(KEY_PARTS)]
                for row, s in gram_sets(part, n):
                    size[row], digest[row] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    found_, needs[row] = range_keys(s, ranges)
                    count[row] = len(found_)
                    deal = found_ >> 1 & KEY_PARTS - 1
                    for k in range(KEY_PARTS):
                        keys[k][row] = found_[deal == k].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "size": pa.array(size, pa.int64()),
                                                  "node": pa.array(digest, pa.binary()), "needs": pa.array(needs, pa.list_(pa.int64())),
                                                  "count": pa.array(count, pa.int64()),
                                                  **{f"keys{k}": pa.array(keys[k], pa.binary()) for k in range(KEY_PARTS)}})

    columns = [f"keys{k}" for k in range(KEY_PARTS)]
    with_keys = saved(docs.mapInArrow(keys_of, "doc_id long, size long, node binary, needs array<long>, count long, "
                                      + ", ".join(f"{c} binary" for c in columns)))
    found = saved(with_keys.select("doc_id", "size", "node", "needs"))
    classes = saved(found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                reps = part.column("rep").to_numpy()
                for column in part.columns[1:]:
                    keys = [np.frombuffer(k, np.int64) for k in column.to_pylist()]
                    yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "rep": np.repeat(reps, [len(k) for k in keys])})

    copies = saved(found.where("node is not null").join(classes, "node").where("doc_id <> rep").select("doc_id"))
    one_each = by_ids(with_keys.where("node is not null").select("doc_id", "count", *columns), copies, "left_anti")

    def keyed(parts: list[str]) -> DataFrame:
        return one_each.select(F.col("doc_id").alias("rep"), *parts).mapInArrow(spread, "key long, rep long")

    def in_part(rows: DataFrame, c: str) -> DataFrame:
        return rows.where(F.col("key").bitwiseAND(2 * KEY_PARTS - 2) == 2 * columns.index(c))

    def several(rows: DataFrame) -> DataFrame:
        """Keys of two sets or more, with what tells their members."""
        return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot"), F.sum(F.hash("rep").cast("long")).alias("s"),
                                       F.bit_xor(F.xxhash64("rep")).alias("x"), F.max("rep").alias("top")).where("n > 1")

    many = (one_each.agg(F.sum("count")).first()[0] or 0) > PART_KEYS
    shared = reduce(DataFrame.union, [saved(several(keyed([c]))) for c in columns]) if many else several(keyed(columns))
    # keys with the same members say the same: one of them stays, with their number as its weight
    side = F.col("key").bitwiseAND(1).cast("int").alias("side")
    shared = saved(shared.groupBy("n", "pivot", "s", "x", "top", side).agg(F.min("key").alias("key"), F.count("*").alias("weight"))
                   .select("key", "weight"))
    sided = lambda rows: saved(rows.select("key", side, "weight", "rep"))
    if many and shared.count() > BROADCAST_KEYS:
        met = reduce(DataFrame.union, [sided(_by_key(keyed([c]), in_part(shared, c))) for c in columns])
    else:
        met = sided(_by_key(keyed(columns), shared))
    discard(with_keys)
    # sets that share too few of their ranges for a link by the keys of a class have none there
    needs = found.where("node is not null").select(F.col("doc_id").alias("rep"), "needs")
    enough = (met.groupBy("rep", "side").agg(F.sum("weight").alias("w")).join(needs, "rep").where("w >= needs[side]")
              .select("rep", "side").distinct())
    met = saved(met.join(enough, ["rep", "side"]).select("key", "weight", "rep"))
    shared = saved(met.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1"))
    members = saved(_by_key(met, shared).select("key", "n", "pivot", "weight", "rep"))
    active = saved(members.select(F.col("rep").alias("doc_id")).distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("doc_id").to_pylist()
                rows = list(gram_sets(part, n))
                yield pa.RecordBatch.from_pydict({"rep": pa.array([ids[r] for r, _ in rows], pa.int64()),
                                                  "set": pa.array([s.tobytes() for _, s in rows], pa.binary())})

    sets = saved(by_ids(docs, active, "left_semi").mapInArrow(sets_of, "rep long, set binary"))

    # sets that shared keys connect, directly or not: a family. Small ones are one block each.
    family = components(members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    family = saved(family.select(F.col("node").alias("rep"), F.col("component").alias("family")))
    sizes = saved(family.groupBy("family").agg(F.count("*").alias("m")))
    family = saved(family.join(sizes, "family"))
    whole = family.where(F.col("m") <= block).select(F.col("family").alias("block"), "rep", F.col("rep").alias("known"))
    links = saved(_blocks(whole.join(sets, "rep").select("block", "rep", "known", "set"), percent))
    # larger families: each set first meets the smallest set that it shares most keys with
    wide = saved(members.join(family.where(F.col("m") > block), "rep"))
    votes = wide.where("rep <> pivot").groupBy("rep", "pivot").agg(F.sum("weight").alias("w"))
    choice = saved(votes.groupBy("rep").agg(F.max(F.struct("w", (-F.col("pivot")).alias("p"))).alias("v"))
                   .select("rep", (-F.col("v.p")).alias("pivot")))
    parts = saved(choice.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("blocks")))
    placed = (choice.join(parts, "pivot").withColumn("block", F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
              .select("block", "rep"))
    pivots = parts.select(F.col("pivot").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    placed = placed.union(pivots.select(F.xxhash64("rep", "k").alias("block"), "rep"))
    links = saved(links.union(_blocks(placed.join(sets, "rep").select("block", "rep", F.col("rep").alias("known"), "set"), percent)))
    found_parts = saved(components(links))

    # then the keys (or whole families of medium size) whose sets are still in several components
    of = wide.join(found_parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("known", F.coalesce("component", "rep"))
    of = saved(of.select(F.when(F.col("m") <= FAMILY_BLOCKS * block, F.col("family")).otherwise(F.col("key")).alias("key"), "rep", "known").distinct())
    open_keys = of.groupBy("key").agg(F.min("known").alias("k0"), F.max("known").alias("k1"), F.count("*").alias("all")).where("k0 < k1")
    open_keys = saved(open_keys.select("key", "all"))
    rest = of.join(open_keys, "key")
    small = rest.where(F.col("all") <= block).select(F.col("key").alias("block"), "rep", "known")
    large = saved(rest.where(F.col("all") > block).select("key", "rep", "known"))
    # blocks of a large key: those of one component, when it fills a block, and mixed ones
    mixed = F.lit("mixed")
    counts = large.groupBy("key", "known").agg(F.count("*").alias("c"))
    counts = saved(counts.withColumn("owner", F.when(F.col("c") > block, F.col("known").cast("string")).otherwise(mixed)))
    # whole blocks, two to a tree: a set is copied once for each other block of its key
    per = counts.groupBy("key", "owner").agg(F.ceil(F.sum("c") / block).alias("blocks"))
    at = large.join(counts, ["key", "known"]).join(per, ["key", "owner"]).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    block_list = per.select("key", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    other = block_list.toDF("key", "owner2", "j")
    pairs = block_list.join(other, "key").where("(owner < owner2 or (owner = owner2 and k <= j)) and not (owner = owner2 and owner <> 'mixed')")
    name = F.xxhash64("key", "owner", "k", "owner2", "j")
    sides = pairs.select("key", "owner", "k", name.alias("block")).union(
        pairs.where("owner <> owner2 or k <> j").select("key", F.col("owner2"), F.col("j"), name.alias("block")))
    placed = small.union(at.join(sides, ["key", "owner", "k"]).select("block", "rep", "known"))
    more = _blocks_in_passes(placed, sets, found.select(F.col("doc_id").alias("rep"), "size"), percent)
    final = components(links.union(more)) if more.take(1) else found_parts

    out = (found.select("doc_id", F.col("size").alias("n_shingles"), "node").join(classes, "node", "left")
           .withColumn("class_id", F.coalesce("rep", "doc_id")).drop("node", "rep"))
    return (out.join(final.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
            .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest id of each group; every column is kept.

    Equal rows with the smallest id all stay. Of rows with one doc_id and different texts each is judged by its own text.
    """
    names = docs.columns
    rows, kept = told_apart(docs) or (docs, "doc_id")
    groups = _classes(rows, n, percent, 256)
    gone = saved(groups.where("doc_id <> component_id").select("doc_id").distinct())
    stay = by_ids(rows, gone, "left_anti")
    return (stay if kept == "doc_id" else stay.drop("doc_id").withColumnRenamed(kept, "doc_id")).select(*[F.col(f"`{c}`") for c in names])
