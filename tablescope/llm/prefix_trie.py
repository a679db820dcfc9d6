"""Conversation prefix trie by truncation peeling.

A conversation is the list of its turns; every distinct list of first turns is a node. The
trie is never built top-down: rounds go from the deepest level to the root. A round merges the conversations
that end at its depth with the nodes that survive from below, sums up what they carry, and strips the
last turn, so that the next round regroups by the shorter list. A node's own figures and those
of its subtree are complete the moment it appears.

Equal conversations are merged first (counted before the shuffle), so thousands of copies travel as one
record. Depths below ``cut`` are peeled by rounds of Spark groupings, which combine before they
shuffle: a first turn that a third of all conversations share costs one row per task.
Depths above it are peeled inside tasks, one group of equal first ``cut`` turns after the other; ``cut`` is the
smallest of 1, 2, 4, 8, ... at which no such group has more than ``group_turns`` turns, by exact counts
over all groups. So no group that one task peels is unbounded, and a few very long
conversations do not cost a round for each of their turns.

Ids of conversations that end at a node are digested in ascending order. They are joined to text within ranges of ids
in parallel; a node with several ranges has its texts hashed one by one as they stream by, in bounded memory (SHA-256 of
one long text cannot be divided).

Prefixes are told apart by chained 128-bit digests of (role, text).

Defined results: null roles and texts are empty; rows without a conv_id belong to no conversation and are
ignored; turns go by number (null first), then role and text; equal rows are separate turns; an empty
table gives no nodes; other columns are ignored. A conversation's turns (16 bytes and a count each)
are one record, the largest unit of work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import saved, ship

#: Turns of one group of equal first turns that a task peels, at most.
GROUP_TURNS = 5_000
#: Consecutive ids whose text is made in one place.
ID_RANGE = 50_000
#: Node rows (about 100 bytes each) up to which parents are broadcast.
BROADCAST_NODES = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "prefix binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place from 0, role, text) with nulls filled, in the order of the conversation."""
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "role", "text")


def share_heads(turns: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are those of another one: (conv_ids, turns).

    Conversation c takes the first ``h = crc32(c) % heads`` turns of conversation ``c - c % block``
    in place of its own first h; fewer if that one is shorter, none if it is absent.
    """
    ids = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    model = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < heads - 1)).withColumnRenamed("conv_id", "base")
    begin = (ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(model, "base").where("place < h")
             .select("conv_id", "place", "role", "text"))
    own_h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    return ids.select("conv_id"), begin.unionByName(turns.where(F.col("place") >= own_h))


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chained digests of each conversation's turns."""
    for batch in batches:
        out, words = [], []
        for turns in batch.column("turns").to_pylist():
            at, path = b"", []
            for turn in turns:
                at = hashlib.blake2b(at + turn["digest"], digest_size=16).digest()
                path.append(at)
            out.append(path)
            words.append([turn["words"] for turn in turns])
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "path": pa.array(out, pa.list_(pa.binary())),
                                          "words": pa.array(words, pa.list_(pa.int64()))})


def conversation_paths(turns: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, path: digest of every beginning, words: of every turn); ``conv_ids`` adds conversations without turns."""
    ship(turns.sparkSession)
    # the length keeps role and text apart
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    light = turns.select("conv_id", F.struct("place", digest.alias("digest"), words_of(F.col("text")).alias("words")).alias("t"))
    lists = light.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    if conv_ids is not None:
        lists = conv_ids.join(lists, "conv_id", "left")
    lists = lists.select("conv_id", F.coalesce("turns", F.array().cast("array<struct<place:bigint,digest:binary,words:bigint>>")).alias("turns"))
    return lists.mapInArrow(_paths, "conv_id long, path array<binary>, words array<long>")


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each key, from rows sorted by key and range: one text in memory at a time."""
    key, state = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for prefix, text in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist()):
            if prefix != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = prefix, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"prefix": pa.array([d[0] for d in done], pa.binary()), "ends_sha256": [d[1] for d in done]})
            done = []
    if state is not None:
        yield pa.RecordBatch.from_pydict({"prefix": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})


def merged_ends(paths: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """One record per distinct conversation: prefix, path, words, n (copies), conv_id (smallest), ends_sha256."""
    rows = paths.withColumn("prefix", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(b"")))
    ids = (rows.groupBy("prefix", F.expr(f"conv_id div {id_range}").alias("cell"))
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
                F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min_by("path", "conv_id").alias("path"), F.min_by("words", "conv_id").alias("words")))
    ids = saved(ids)
    ends = ids.groupBy("prefix").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("cells"),
                                     F.min_by("path", "conv_id").alias("path"), F.min_by("words", "conv_id").alias("words"),
                                     F.min_by(F.sha2("ids", 256), "conv_id").alias("ends_sha256"))
    many = ends.where("cells > 1").select("prefix")
    spread = ids.join(many, "prefix", "left_semi").select("prefix", "cell", "ids")
    hashed = spread.repartition("prefix").sortWithinPartitions("prefix", "cell").mapInArrow(_hash_parts, "prefix binary, ends_sha256 string")
    return ends.join(hashed.withColumnRenamed("ends_sha256", "all_sha256"), "prefix", "left").select(
        "prefix", "path", "words", "n", "conv_id", F.coalesce("all_sha256", "ends_sha256").alias("ends_sha256"))


def peel(group: list[tuple], cut: int) -> list[tuple]:
    """Nodes deeper than ``cut`` of one group of distinct conversations (path, words, n, conv_id, ends_sha256), deepest first.

    Rows as in ``NODE``; the parents of the nodes at ``cut + 1`` are left open.
    """
    ending: dict[int, list[int]] = {}
    for i, c in enumerate(group):
        ending.setdefault(len(c[0]), []).append(i)
    out: list[tuple] = []
    alive: list[list] = []  # [prefix, a conversation through it, n, smallest id, leaves, saved, row number]
    for depth in range(max(ending), cut, -1):
        nodes: dict[bytes, list] = {}
        children: dict[bytes, list[int]] = {}
        for prefix, i, n, low, leaves, saved_, row in alive:
            parent = group[i][0][depth - 1]
            have = nodes.setdefault(parent, [0, low, 0, 0, 0, EMPTY, i])
            have[0] += n
            have[1] = min(have[1], low)
            have[2] += 1
            have[3] += leaves
            have[4] += saved_
            children.setdefault(parent, []).append(row)
        for i in ending.get(depth, ()):
            path, _, n, low, digest = group[i]
            have = nodes.setdefault(path[depth - 1], [0, low, 0, 0, 0, EMPTY, i])
            have[0] += n
            have[1] = min(have[1], low)
            have[5] = digest
        alive = []
        for prefix, (n, low, kids, leaves, saved_, digest, i) in nodes.items():
            path, words = group[i][0], group[i][1]
            leaves, saved_ = leaves or 1, saved_ + (n - 1) * words[depth - 1]
            for row in children.get(prefix, ()):
                out[row] = (*out[row][:4], low, *out[row][5:])
            alive.append([prefix, i, n, low, leaves, saved_, len(out)])
            out.append((prefix, path[depth - 2] if depth > 1 else b"", depth, low, None, n, kids, leaves, saved_, digest))
    return out


def _peel_groups(cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in NODE.split(", ")]
        kinds = {"prefix": pa.binary(), "parent": pa.binary(), "ends_sha256": pa.string()}

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))})

        key, group, out = None, [], []
        for batch in batches:
            for top, *record in zip(*[batch.column(c).to_pylist() for c in ("top", "path", "words", "n", "conv_id", "ends_sha256")]):
                if top != key and group:
                    out += peel(group, cut)
                    group = []
                    if len(out) >= 10_000:
                        yield table(out)
                        out = []
                key = top
                group.append(tuple(record))
        if group:
            out += peel(group, cut)
        if out:
            yield table(out)

    return run


def choose_cut(ends: DataFrame, group_turns: int = GROUP_TURNS) -> int:
    """Smallest of 1, 2, 4, ... at which no group of equal beginnings has more than ``group_turns`` deeper turns.

    Only one row per doubling reaches the driver.
    """
    doublings = F.expr("filter(transform(sequence(0, 30), k -> shiftleft(1, k)), d -> d < size(path))")
    turns = ends.select("path", F.explode(doublings).alias("d")).select("d", F.element_at("path", F.col("d")).alias("top"), (F.size("path") - F.col("d")).alias("turns"))
    most = turns.groupBy("d", "top").agg(F.sum("turns").alias("turns")).groupBy("d").agg(F.max("turns").alias("turns"))
    rows = sorted((r.d, r.turns) for r in most.collect())
    return next((d for d, n in rows if n <= group_turns), rows[-1][0] * 2 if rows else 1)


def prefix_trie(paths: DataFrame, group_turns: int = GROUP_TURNS, id_range: int = ID_RANGE) -> DataFrame:
    """One row per node: prefix (digest), parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ends = saved(merged_ends(paths, id_range))
    cut = choose_cut(ends, group_turns)
    deep = ends.where(F.size("path") > cut).withColumn("top", F.element_at("path", F.lit(cut)))
    deep = saved(deep.repartition("top").sortWithinPartitions("top").mapInArrow(_peel_groups(cut), NODE))
    done = [deep.where(F.col("depth") > cut + 1)]
    # a few levels carry the list of their beginnings, to strip the last turn
    beginnings = lambda d: F.slice("path", 1, d)
    tops = ends.where(F.size("path") > cut).groupBy(F.element_at("path", F.lit(cut)).alias("parent")).agg(
        F.first(beginnings(cut)).alias("stem"), F.first(F.slice("words", 1, cut)).alias("spoken"))
    alive = deep.where(F.col("depth") == cut + 1).join(tops, "parent")
    for depth in range(cut, -1, -1):
        # stem and spoken reach down to this depth
        stem = F.col("stem")
        last = F.element_at(stem, F.lit(depth)) if depth else F.lit(b"")
        from_below = alive.select(last.alias("prefix"), "stem", "spoken", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                                  F.lit(None).cast("string").alias("ends_sha256"))
        ending = ends.where(F.size("path") == depth).select(
            "prefix", F.col("path").alias("stem"), F.col("words").alias("spoken"), "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_children"),
            F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256")
        nodes = from_below.unionByName(ending).groupBy("prefix").agg(
            F.first("stem").alias("stem"), F.first("spoken").alias("spoken"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"), F.max("ends_sha256").alias("ends_sha256"))
        own = (F.col("n_convs") - 1) * F.element_at("spoken", F.lit(depth)) if depth else F.lit(0)
        parent = (F.element_at("stem", F.lit(depth - 1)) if depth > 1 else F.lit(b"")) if depth else F.lit(None).cast("binary")
        nodes = saved(nodes.select("prefix", parent.alias("parent"), F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
                                   F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("below") + own).cast("long").alias("saved_tokens"),
                                   F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
                                   F.slice("stem", 1, max(depth - 1, 0)).alias("stem"), F.slice("spoken", 1, max(depth - 1, 0)).alias("spoken")))
        # the children's parents are known now
        above = nodes.select(F.col("prefix").alias("up"), F.col("conv_id").alias("parent_conv_id"))
        above = F.broadcast(above) if depth == 0 or above.count() <= BROADCAST_NODES else above
        done.append(alive.drop("stem", "spoken", "parent_conv_id").join(above, F.col("parent") == F.col("up")).drop("up"))
        alive = nodes
    done.append(alive.drop("stem", "spoken").withColumn("parent_conv_id", F.lit(None).cast("long")))
    names = [x.split()[0] for x in NODE.split(", ")]
    out = done[0].select(*names)
    for part in done[1:]:
        out = out.unionByName(part.select(*names))
    return out
