"""Benchmark decontamination: a distributed positional inverted index of the texts, searched from the rarest terms.

A test item is cut in windows of consecutive words (a shorter item is one window). How often
each test term occurs in the texts is counted first. For each window the postings (term,
document, place) of its two rarest terms are stored and shifted by the term's offset in the
window; a document holds the window only where the shifted lists agree. The whole window is
then compared at those places in the text, so the answer is exact. ``proximity_matches`` lets
the two shifted lists differ by up to ``slop`` words and then asks for all terms nearby.

Test terms are held by every task only while their number is within ``TERMS``; with more, all
terms are counted and joined by key.

Defined results: null texts have no words and hit nothing; items without words have no window;
equal windows of several items count for each; repeated rows give equal rows; an empty table
on either side gives no hit; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import Words, grams, pieces, text_bytes
from tablescope.llm.common import by_ids, clean_documents, saved, ship

WINDOW = 13
#: Most test terms that tasks may hold (8 bytes each); beyond it terms are joined by key.
TERMS = 2_000_000


def _words(part: pa.RecordBatch) -> Words:
    return Words(*text_bytes(part.column("text")), "alnum")


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id as text, window hash, its number of words, its terms in order) for every window of every item."""
    ship(items.sparkSession)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words, ids = _words(part), part.column("item_id").to_pylist()
                out = ([], [], [], [])
                for row, item in enumerate(ids):
                    h = words.hash[words.first[row]: words.first[row + 1]]
                    n = min(window, len(h))
                    for i, g in enumerate(grams(h, n).view(np.int64).tolist() if n else []):
                        for o, x in zip(out, (item, g, n, h[i: i + n].view(np.int64).tolist()), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                                  pa.array(out[3], pa.list_(pa.int64()))], names=["item_id", "window", "size", "terms"])

    return items.mapInArrow(run, "item_id string, window long, size int, terms array<long>")


def _held(terms: DataFrame, column: str) -> np.ndarray | None:
    """The distinct values for use in tasks, if their counted number allows it."""
    distinct = saved(terms.select(column).distinct())
    if distinct.count() > TERMS:
        return None
    return np.sort(np.array([r[0] for r in distinct.collect()], np.int64))


def _among(values: np.ndarray, sorted_terms: np.ndarray | None) -> np.ndarray:
    if sorted_terms is None:
        return np.ones(len(values), bool)
    if not len(sorted_terms):
        return np.zeros(len(values), bool)
    return sorted_terms[np.minimum(np.searchsorted(sorted_terms, values), len(sorted_terms) - 1)] == values


def rarest_terms(docs: DataFrame, windows: DataFrame, slots: int = 2) -> DataFrame:
    """(window, need, slot, term, offset): the rarest terms of each distinct window."""
    one = windows.select("window", "size", "terms").dropDuplicates(["window", "size"])
    each = one.select("window", "size", F.posexplode("terms").alias("offset", "term"))
    vocabulary = _held(each, "term")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                h = _words(part).hash.view(np.int64)
                term, n = np.unique(h[_among(h, vocabulary)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": term, "n": n.astype(np.int64)})

    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    picked = found.groupBy("window", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))), 1, slots).alias("p"))
    # a window with a term that no text holds occurs nowhere
    picked = picked.where(F.col("p")[0]["n"] > 0)
    return saved(picked.select("window", "size", F.size("p").alias("need"), F.posexplode("p").alias("slot", "x"))
                 .select("window", "size", "need", "slot", "x.term", "x.offset"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, place) of the listed terms in all texts."""
    held = _held(terms, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = _words(part)
                h = words.hash.view(np.int64)
                at = np.flatnonzero(_among(h, held))
                text = words.text[at]
                yield pa.RecordBatch.from_pydict({"term": h[at], "doc_id": part.column("doc_id").to_numpy()[text],
                                                  "place": (at - words.first[text]).astype(np.int64)})

    return docs.mapInArrow(run, "term long, doc_id long, place long")


def _shifted(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Postings of the rarest terms as window starts: doc_id, window, size, need, slot, start."""
    small = picked.count() <= TERMS
    listed = postings(docs, picked)
    return (listed.join(F.broadcast(picked) if small else picked, "term")
            .withColumn("start", F.col("place") - F.col("offset")).where("start >= 0"))


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, windows): exact occurrences, for every document."""
    docs = clean_documents(docs)
    ship(docs.sparkSession)
    picked = rarest_terms(docs, windows)
    agree = (_shifted(docs, picked).select("doc_id", "window", "size", "need", "start", "slot").distinct()
             .groupBy("doc_id", "window", "size", "need", "start").agg(F.count("*").alias("n")).where("n = need"))
    by_doc = saved(agree.groupBy("doc_id").agg(F.collect_list(F.struct("window", "size", "start")).alias("c"))
                   .select("doc_id", F.col("c.window").alias("windows"), F.col("c.size").alias("sizes"), F.col("c.start").alias("starts")))
    ids = saved(by_doc.select("doc_id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = _words(part)
                counts = np.diff(words.first)
                hits, found = np.zeros(len(counts), np.int64), [[] for _ in counts]
                if "windows" in part.schema.names:
                    for row, (w, s, p) in enumerate(zip(*(part.column(c).to_pylist() for c in ("windows", "sizes", "starts")), strict=True)):
                        h = words.hash[words.first[row]: words.first[row + 1]]
                        w, s, p = np.array(w, np.int64), np.array(s), np.array(p, np.int64)
                        cover = np.zeros(len(h) + 1, np.int64)
                        for size in np.unique(s).tolist():
                            g = grams(h, size).view(np.int64)
                            k = np.flatnonzero((s == size) & (p < len(g)))
                            k = k[g[p[k]] == w[k]]
                            np.add.at(cover, p[k], 1)
                            np.add.at(cover, p[k] + size, -1)
                            found[row] += np.unique(w[k]).tolist()
                        hits[row] = np.count_nonzero(np.cumsum(cover))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(hits),
                                                  pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "windows"])

    schema = "doc_id long, n_words long, n_hit long, windows array<long>"
    return (by_ids(docs, ids, "left_anti").mapInArrow(compare, schema)
            .union(by_ids(docs, ids, "left_semi").join(by_doc, "doc_id").mapInArrow(compare, schema)))


def proximity_matches(docs: DataFrame, windows: DataFrame, slop: int = 3) -> DataFrame:
    """(doc_id, window, start): places where all terms of a window lie within its length plus ``slop`` words."""
    docs = clean_documents(docs)
    ship(docs.sparkSession)
    both = _shifted(docs, rarest_terms(docs, windows)).withColumn("b", F.floor(F.col("start") / (slop + 1)))
    one = both.where("slot = 0").select("doc_id", "window", "size", "need", "b", F.col("start").alias("s0"))
    two = both.where("slot = 1").select("doc_id", "window", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"),
                                        F.col("start").alias("s1"))
    near = (one.where("need > 1").join(two, ["doc_id", "window", "b"]).where(F.abs(F.col("s0") - F.col("s1")) <= slop)
            .select("doc_id", "window", "size", F.least("s0", "s1").alias("start")).union(one.where("need = 1").select("doc_id", "window", "size", "s0")))
    near = near.distinct().join(windows.select("window", "terms").dropDuplicates(["window"]), "window")
    by_doc = saved(near.groupBy("doc_id").agg(F.collect_list(F.struct("window", "size", "start", "terms")).alias("c")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words, out = _words(part), ([], [], [])
                for row, (doc, listed) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("c").to_pylist(), strict=True)):
                    h = words.hash[words.first[row]: words.first[row + 1]].view(np.int64)
                    for c in listed:
                        for begin in range(max(c["start"] - slop, 0), c["start"] + slop + 1):
                            if set(c["terms"]) <= set(h[begin: begin + c["size"] + slop].tolist()):
                                for o, x in zip(out, (doc, c["window"], begin), strict=True):
                                    o.append(x)
                                break
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "window", "start"), out, strict=True)})

    return by_ids(docs, saved(by_doc.select("doc_id")), "left_semi").join(by_doc, "doc_id").mapInArrow(check, "doc_id long, window long, start long").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and at least 1 / share of the words hit)."""
    windows = saved(test_windows(items, window))
    found = saved(phrase_matches(docs, windows))
    of = windows.select("window", "item_id").distinct()
    items_of = (found.where("size(windows) > 0").select("doc_id", F.explode("windows").alias("window")).distinct()
                .join(F.broadcast(of) if of.count() <= TERMS else of, "window").groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    out = found.join(items_of, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated; every column is kept."""
    gone = saved(contamination(docs, items).where("contaminated").select("doc_id").distinct())
    return by_ids(docs, gone, "left_anti").select(*docs.columns)
