"""Suffix-array dedup: common-prefix interval trees over shared neighbourhoods, across all documents.

1. Texts that equal an earlier text need no suffix array: all of them is repeated.
2. Anchors. Every run of ``length`` bytes holds the smallest of its 20-byte grams (by hash);
   equal runs choose equal anchors at equal places. So two documents share a run only if they
   share an anchor, and also the 15 bytes before or after it. Documents are listed per anchor,
   within a task first, with short prints of both sides, and only those go on that meet another
   document there.
3. Neighbourhoods. For each shared anchor the bytes around it that runs through the anchor can
   reach are cut from the texts; equal ones are combined with the smallest document.
4. Suffix arrays. The distinct neighbourhoods of one anchor become an enhanced suffix array
   (sorted suffixes and common-prefix lengths). A stack scan opens and closes the intervals of
   common prefixes of ``length`` or more. Each interval is a repeat with *all* of its
   occurrences; it is maximal when its left neighbours differ. The smallest document of an
   interval keeps the run, every other occurrence is a repeat.
5. Distinct neighbourhoods are counted per anchor. One with more than ``SORTED`` (the border of a
   passage that a third of all documents hold) is not sorted in one task: its runs are keyed one by one and combined
   before the shuffle per byte before and after them; only the earliest of each such byte is
   joined back, and the first and last of them bound what is repeated of a neighbourhood.

Defined results: null texts count as empty; repeats inside one document are kept; of equal
texts the smallest doc_id stays; texts shorter than ``length`` never change; repeated rows
with equal doc_id give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.arrays import byte_grams, pieces, sliding, text_bytes
from tablescope.llm.common import by_ids, clean_documents, free_name, runs, saved, ship, tidy, told_apart

GRAM = 20
#: Where a document meets an anchor, with a short print of the bytes before and after it.
MET = np.dtype([("doc", "<i8"), ("before", "<u2"), ("after", "<u2")])
#: Entries of an anchor's list that a task holds at once, and neighbourhoods of small groups that are sorted together.
GROUP = 2000
#: Distinct neighbourhoods of an anchor that are sorted in one task (their suffixes take 50 MB); more take the route by
#: single runs. They are counted, so a text that repeats an anchor without end takes that route, too.
SORTED = 20_000


def anchors(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the chosen grams of all texts."""
    width = length - GRAM + 1
    if len(buf) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    hashes = byte_grams(buf, GRAM)
    sizes = np.diff(at)
    # a run that crosses two texts chooses nothing
    ok = np.zeros(len(buf) + 1, np.int32)
    whole = sizes >= length
    np.add.at(ok, at[:-1][whole], 1)
    np.add.at(ok, (at[1:] - length + 1)[whole], -1)
    ok = np.cumsum(ok)[: len(hashes) - width + 1] > 0
    least = np.where(ok, sliding(hashes, width), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum)[: len(hashes)] == hashes)
    return np.searchsorted(at, chosen, "right") - 1, chosen, hashes[chosen]


def sides(buf: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prints of the bytes before and after each anchor, 0 where the text has too few.

    A run of ``length`` bytes through the anchor takes half of what is left of it, or more, from one side.
    """
    half = (length - GRAM + 1) // 2
    prints = (byte_grams(buf, half) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    none = np.uint16(0)
    before, after = place - half, place + GRAM
    last = max(len(prints) - 1, 0)
    return (np.where(before >= at[text], prints[np.clip(before, 0, last)], none),
            np.where(after + half <= at[text + 1], prints[np.clip(after, 0, last)], none))


def lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Binary array: the values of each run."""
    at = np.concatenate([begins, [len(values)]]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def suffix_intervals(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int, bool]]:
    """Common-prefix intervals of ``length`` or more over the suffixes of byte rows, group by group.

    rows: one neighbourhood per line, padded; sizes: their bytes; group: lines with equal
    numbers belong together. Yields (occurrences as line * width + place, common length, left
    neighbours differ) for each interval of the tree, inner ones first.
    """
    n, width = rows.shape
    line, place = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    room = sizes[line] - place
    keep = room >= length
    line, place, room = line[keep], place[keep], room[keep]
    if not len(line):
        return
    padded = np.concatenate([rows, np.zeros((n, width), np.uint8)], axis=1)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[line, place])
    rank = np.unique(suffixes.view(f"V{width}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((room, rank, group[line]))
    suffixes, line, place, room = suffixes[order], line[order], place[order], room[order]
    same = suffixes[1:] == suffixes[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(room[1:], room[:-1]))
    common[(group[line][1:] != group[line][:-1]) | (common < length)] = 0
    left = np.where(place > 0, rows[line, np.maximum(place - 1, 0)].astype(np.int64), -1 - line)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    at = line * width + place
    # stack scan: an interval opens where the common length rises and closes where it falls
    common = np.concatenate([common, [0]])
    busy = np.flatnonzero((common > 0) | (np.concatenate([[0], common[:-1]]) > 0))
    stack: list[tuple[int, int]] = []
    for i, c in zip(busy.tolist(), common[busy].tolist(), strict=True):
        begin = i
        while stack and stack[-1][0] > c:
            value, begin = stack.pop()
            yield at[begin: i + 1], value, bool(change[i] > change[begin])
        if c and (not stack or stack[-1][0] < c):
            stack.append((c, begin))


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals; touching ones are one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[new].tolist(), e[np.concatenate([new[1:] - 1, [len(s) - 1]])].tolist(), strict=True))


@tidy
def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document with a repeat: doc_id, whole (equals an earlier text), starts and ends (bytes)."""
    spark = docs.sparkSession
    ship(spark)
    docs = clean_documents(docs)
    digest = docs.select("doc_id", F.md5("text").alias("d"), F.octet_length("text").alias("b")).where(F.col("b") >= length)
    digest = saved(digest)
    firsts = digest.groupBy("d", "b").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    whole = saved(digest.join(firsts, ["d", "b"]).where("doc_id > low").select("doc_id").distinct())
    texts = by_ids(docs, whole, "left_anti")

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                buf, at = text_bytes(part.column("text"))
                text, place, value = anchors(buf, at, length)
                if not len(value):
                    continue
                met = np.empty(len(value), MET)
                met["doc"] = part.column("doc_id").to_numpy()[text]
                met["before"], met["after"] = sides(buf, at, text, place, length)
                order = np.lexsort((met["after"], met["before"], met["doc"], value))
                value, met = value[order], met[order]
                once = np.concatenate([[True], (value[1:] != value[:-1]) | (met[1:] != met[:-1])])
                value, met = value[once], met[once]
                begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                yield pa.RecordBatch.from_pydict({"anchor": value[begins].view(np.int64), "ids": lists(met, begins)})

    def several_docs(value: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether another document meets the same anchor with the same print on this side."""
        order = np.lexsort((doc, side, value))
        v, s, d = value[order], side[order], doc[order]
        begins = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (s[1:] != s[:-1])]))
        ends = np.concatenate([begins[1:], [len(v)]])
        found = np.repeat(d[begins] != d[ends - 1], ends - begins) & (s > 0)
        out = np.zeros(len(v), bool)
        out[order] = found
        return out

    def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, is_open in runs(batches, "anchor", GROUP):
            table = table.combine_chunks()
            anchor = table.column("anchor").to_numpy()
            if not len(anchor):
                continue
            raw, at = text_bytes(pa.concat_arrays(table.column("ids").chunks))
            met, counts = np.frombuffer(raw.tobytes(), MET), np.diff(at) // MET.itemsize
            value, doc = np.repeat(anchor, counts), met["doc"].astype(np.int64)
            goes_on = np.ones(len(value), bool) if is_open else (
                several_docs(value, met["before"], doc) | several_docs(value, met["after"], doc))
            yield pa.RecordBatch.from_pydict({"doc_id": doc[goes_on], "anchor": value[goes_on]})

    listed = texts.mapInArrow(list_anchors, "anchor long, ids binary")
    hits = (listed.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(shared_anchors, "doc_id long, anchor long"))
    by_doc = saved(hits.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    holders = saved(by_doc.select("doc_id"))
    around = by_ids(texts, holders, "left_semi").join(by_doc, "doc_id")
    before, after = length - GRAM, length

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                buf, at = text_bytes(part.column("text"))
                text, place, value = anchors(buf, at, length)
                listed_ = part.column("anchors")
                rows = {"anchor": [], "around": [], "shift": [], "doc_id": [], "place": []}
                ids = part.column("doc_id").to_pylist()
                edges = np.searchsorted(text, np.arange(len(ids) + 1))
                for row, doc in enumerate(ids):
                    lo, hi = edges[row], edges[row + 1]
                    if lo == hi:
                        continue
                    wanted = np.array(listed_[row].as_py(), np.int64)
                    v = value[lo:hi].view(np.int64)
                    base, end = int(at[row]), int(at[row + 1])
                    data = buf[base:end].tobytes()
                    for k in np.flatnonzero(np.isin(v, wanted)).tolist():
                        p = int(place[lo + k]) - base
                        left = max(p - before, 0)
                        rows["anchor"].append(int(v[k]))
                        rows["around"].append(data[left: p + after])
                        rows["shift"].append(p - left)
                        rows["doc_id"].append(doc)
                        rows["place"].append(left)
                if rows["doc_id"]:
                    yield pa.RecordBatch.from_pydict({k: pa.array(x, {"around": pa.binary(), "shift": pa.int32()}.get(k, pa.int64()))
                                                      for k, x in rows.items()})

    near = saved(around.mapInArrow(neighbourhoods, "anchor long, around binary, shift int, doc_id long, place long"))

    # equal neighbourhoods: all but those of the smallest document are repeats as a whole
    kinds = saved(near.groupBy("anchor", "shift", "around").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                                                F.xxhash64("anchor", "shift", "around").alias("kind")))
    many = saved(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SORTED).select("anchor"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in runs(batches, "anchor"):
            anchor = table.column("anchor").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.concatenate([begins, [len(anchor)]]))
            # whole groups, about 2000 neighbourhoods at once; one alone repeats nothing else
            several = np.flatnonzero(np.repeat(size > 1, size))
            group = np.repeat(np.arange(len(size)), size)[several]
            table = table.take(several)
            lows, kinds_, anchors_ = (table.column(c).to_numpy() for c in ("low", "kind", "anchor"))
            lo = 0
            while lo < len(group):
                hi = int(np.searchsorted(group, group[min(lo + 2000, len(group)) - 1], "right"))
                data = table.column("around").slice(lo, hi - lo).to_pylist()
                sizes = np.array([len(x) for x in data])
                width = int(sizes.max())
                rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(hi - lo, width)
                low = lows[lo:hi]
                later = np.zeros((hi - lo, width), bool)  # an earlier document has the run starting here
                for occurrences, common, diverse in suffix_intervals(rows, sizes, group[lo:hi], length):
                    # neither the first nor the last run of a repeat: a byte more on either side is common, too
                    if not diverse and common > length:
                        continue
                    line, place = occurrences // width, occurrences % width
                    docs_ = low[line]
                    where = docs_ > docs_.min()
                    later[line[where], place[where]] = True
                better = np.flatnonzero(later.any(axis=1))
                yield pa.RecordBatch.from_pydict({
                    "anchor": anchors_[lo:hi][better], "kind": kinds_[lo:hi][better],
                    "first": later[better].argmax(axis=1).astype(np.int32),
                    "last": (width - 1 - later[better][:, ::-1].argmax(axis=1)).astype(np.int32)})
                lo = hi

    answers = (by_ids(kinds, many, "left_anti", "anchor").repartition("anchor").sortWithinPartitions("anchor")
               .select("anchor", "around", "low", "kind").mapInArrow(answer, "anchor long, kind long, first int, last int"))

    def single_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                buf, at = text_bytes(part.column("around"))
                if len(buf) < length:
                    continue
                counts = np.maximum(np.diff(at) - length + 1, 0)
                line = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
                here = at[line] + place
                end = here + length
                before = np.where(place > 0, buf[np.maximum(here - 1, 0)].astype(np.int16), np.int16(-1))
                after = np.where(end < at[line + 1], buf[np.minimum(end, len(buf) - 1)].astype(np.int16), np.int16(-1))
                columns = {c: part.column(c).to_numpy()[line] for c in ("anchor", "kind", "low")}
                yield pa.RecordBatch.from_pydict({
                    **columns, "place": place.astype(np.int32), "before": before, "after": after,
                    "run": byte_grams(buf, length)[here].view(np.int64), "run2": byte_grams(buf ^ np.uint8(0x5A), length)[here].view(np.int64)})

    # A run is a node of the prefix tree of its occurrences, the bytes beside it lead to the child nodes. It can be
    # the first repeat of a neighbourhood only if no earlier document has it with the same byte before it (else the
    # run one byte to the left is repeated, too), and the last only if none has it with the same byte after it. So
    # besides runs at the border of a neighbourhood, those go on that are the earliest of a child node.
    hot_runs = saved(by_ids(kinds, many, "left_semi", "anchor").select("anchor", "kind", "low", "around").mapInArrow(
        single_runs, "anchor long, kind long, low long, place int, before short, after short, run long, run2 long"))
    node = Window.partitionBy("run", "run2")
    children = (hot_runs.groupBy("run", "run2", "before", "after").agg(F.min("low").alias("child"), F.max("low").alias("most"))
                .select("run", "run2", "before", "after", "child", F.min("child").over(node).alias("least"), F.max("most").over(node).alias("most"),
                        *(F.min("child").over(node.partitionBy("run", "run2", c)).alias(f"{c}_least") for c in ("before", "after")))
                .where("least < most and (before < 0 or after < 0 or (child > least and (child = before_least or child = after_least)))")
                .select("run", "run2", "before", "after", "child", "least"))
    hot_answers = (hot_runs.join(children, ["run", "run2", "before", "after"])
                   .where("least < low and (before < 0 or after < 0 or low = child)")
                   .groupBy("anchor", "kind").agg(F.min("place").alias("first"), F.max("place").alias("last")))

    # the spans of each document: neighbourhoods that an earlier document has, or what runs that one has cover
    # (they all hold the anchor, so they make one span)
    known = saved(kinds.select("anchor", "kind", "low", "high")
                  .join(answers.union(hot_answers.select("anchor", "kind", "first", "last")), ["anchor", "kind"], "left")
                  .where("low < high or first is not null").drop("high"))
    placed = near.select("anchor", F.xxhash64("anchor", "shift", "around").alias("kind"), "doc_id", "place", F.octet_length("around").alias("size"))
    spans = (placed.where(F.col("size") >= length).join(known, ["anchor", "kind"]).where("low < doc_id or first is not null")
             .select("doc_id", F.expr("if(low < doc_id, place, place + first)").alias("start"),
                     F.expr(f"if(low < doc_id, place + size, place + last + {length})").alias("end")))
    merged = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    return (merged.select("doc_id", F.lit(False).alias("whole"), F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
            .union(whole.select("doc_id", F.lit(True), F.array().cast("array<long>"), F.array().cast("array<long>"))))


def cut(docs: DataFrame, length: int, columns: str, make) -> DataFrame:
    """Map (doc_id, bytes, removed spans) of every document to a row by ``make`` (a list of column values)."""
    spans = repeated_spans(docs, length)
    docs = clean_documents(docs)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                get = lambda c: part.column(c).to_pylist() if c in part.schema.names else [None] * part.num_rows  # noqa: E731,B023
                for doc, text, whole, starts, ends in zip(get("doc_id"), get("text"), get("whole"), get("starts"), get("ends"), strict=True):
                    data = text.encode()
                    removed = [(0, len(data))] if whole else _merge(np.array(starts or [], np.int64), np.array(ends or [], np.int64))
                    rows.append(make(doc, data, removed))
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    touched = saved(spans.select("doc_id"))
    return (by_ids(docs, touched, "left_anti").mapInArrow(run, columns)
            .union(by_ids(docs, touched, "left_semi").join(spans, "doc_id").mapInArrow(run, columns)))


def digest_row(doc: int, data: bytes, removed: list[tuple[int, int]]) -> tuple:
    kept, at = hashlib.sha256(), 0
    for s, e in removed:
        kept.update(data[at:s])
        at = e
    kept.update(data[at:])
    return doc, len(data), sum(e - s for s, e in removed), len(removed), kept.hexdigest()


def text_row(doc: int, data: bytes, removed: list[tuple[int, int]]) -> tuple:
    """The text that stays; a removed span never cuts a character (its broken ends stay whole)."""
    parts, at = [], 0
    for s, e in removed:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return doc, b"".join(parts).decode(), bool(removed)


def removed_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Rows with one doc_id and different texts are documents of their own, in the order of their texts' digests.
    """
    rows, kept = told_apart(docs) or (docs, None)
    out = cut(rows, length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest_row)
    if kept is None:
        return out
    ids = saved(rows.select("doc_id", F.col(kept).cast("long").alias("was")).distinct())
    return out.join(ids, "doc_id").drop("doc_id").withColumnRenamed("was", "doc_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents with later occurrences of repeats cut from their texts; all other columns are kept.

    Equal rows stay as many as they are; rows with one doc_id and different texts as in ``removed_report``. A column
    ``n_chars`` is counted anew.
    """
    names = docs.columns
    rows, kept = told_apart(docs) or (docs, None)
    text = free_name(rows, "new_text")
    new = cut(rows, length, "doc_id long, new_text string, changed boolean", text_row).where("changed").select("doc_id", F.col("new_text").alias(text))
    new = saved(new.dropDuplicates(["doc_id"]))
    same = by_ids(rows, new, "left_anti")
    changed = by_ids(rows.drop("text"), new, "left_semi").join(new, "doc_id").withColumnRenamed(text, "text")
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = same.select(*[F.col(f"`{c}`") for c in rows.columns]).unionByName(changed.select(*[F.col(f"`{c}`") for c in rows.columns]))
    return (out if kept is None else out.drop("doc_id").withColumnRenamed(kept, "doc_id")).select(*[F.col(f"`{c}`") for c in names])
