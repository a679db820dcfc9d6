"""Substring dedup by sliding sentence spans.

A text is cut into sentences (each keeps its end mark and the white space after it, so the
pieces make up the text). A run has at least ``span`` consecutive sentences and as many more as
it takes to hold ``min_words`` words: one grows forwards from each sentence, one backwards from
each sentence. So every passage of so many sentences and words is covered by runs inside it,
however short its sentences are; only texts and passages with fewer words have none, so short
common phrases stay. Every run is hashed (two 64-bit hashes of its lower-cased words), and the
first place of each hash is found over all documents: the smallest (doc_id, sentence number).
A sentence is removed if a run that covers it has an earlier place.

Frequent runs are combined before the shuffle; only runs seen twice or more are joined back, and
that join is split by Spark where one run is frequent. Built-in functions only.

Defined results: null texts count as empty and have no sentence; repeats inside a document
count as repeats; of rows with equal doc_id and text nothing is removed against each other;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import by_ids, clean_documents, saved

SPAN = 2
MIN_WORDS = 8
_SENTENCE = "[^.!?\n]+[.!?\n]*\\s*|[.!?\n]+\\s*"


def sentences(text: str = "text"):
    return F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))


def span_hashes(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, i, k, h1, h2) of every run of sentences i .. i + k - 1."""
    split = docs.select("doc_id", sentences().alias("s"))
    plain = split.select("doc_id", F.transform("s", lambda x: F.trim(F.regexp_replace(F.lower(x), "\\s+", " "))).alias("s"))
    # every sentence counts one word at least, so no run has more than `most` sentences
    most = max(span, min_words)
    words = plain.where(F.size("s") >= span).select("doc_id", "s", F.expr("transform(s, x -> size(split(x, ' ')))").alias("w"))
    grown = f"""aggregate({{0}}, named_struct('k', 0, 'n', 0), (a, x) -> if(a.k >= {span} and a.n >= {min_words}, a, named_struct('k', a.k + 1, 'n', a.n + x)))"""
    forwards = grown.format(f"slice(w, i, {most})")
    backwards = grown.format(f"reverse(slice(w, greatest(i - {most - 1}, 1), least(i, {most})))")
    whole = f"r.k >= {span} and r.n >= {min_words}"
    # a run that grew backwards is new if it would do without its last sentence
    new = f"{whole} and r.k > {span} and r.n - w[r.e - 1] >= {min_words}"
    runs = words.select("doc_id", "s", F.expr(f"""concat(
        transform(filter(transform(sequence(1, size(w)), i -> named_struct('i', i, 'g', {forwards})), f -> f.g.k >= {span} and f.g.n >= {min_words}),
                  f -> named_struct('i', f.i, 'k', f.g.k)),
        transform(filter(transform(transform(sequence(1, size(w)), i -> named_struct('e', i, 'g', {backwards})),
                                   f -> named_struct('e', f.e, 'k', f.g.k, 'n', f.g.n)), r -> {new}),
                  f -> named_struct('i', f.e - f.k + 1, 'k', f.k)))""").alias("r"))
    texts = runs.select("doc_id", F.explode(F.expr("transform(r, q -> named_struct('i', q.i, 'k', q.k, 't', array_join(slice(s, q.i, q.k), ' ')))")).alias("r"))
    return texts.select("doc_id", "r.i", "r.k", F.xxhash64("r.t").alias("h1"), F.xxhash64(F.lit(1), "r.t").alias("h2"))


def repeated_sentences(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, gone): numbers (from 1) of the sentences to remove, for documents that have any."""
    hashes = saved(span_hashes(clean_documents(docs), span, min_words))
    first = hashes.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "i")).alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = hashes.join(first, ["h1", "h2"]).where("struct(doc_id, i) > low").select("doc_id", "i", "k")
    covered = later.select("doc_id", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("k") - 1)).alias("i"))
    return saved(covered.groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("gone")))


def dedup_sentences(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed, gone, kept_text for every document."""
    gone = repeated_sentences(docs, span, min_words)
    texts = clean_documents(docs)
    none = F.array().cast("array<int>")
    some = by_ids(texts, gone, "left_semi").join(gone, "doc_id")
    rest = by_ids(texts, gone, "left_anti").withColumn("gone", none)
    cut = some.unionByName(rest).withColumn("s", sentences())
    kept = F.array_join(F.filter("s", lambda x, i: ~F.array_contains("gone", i + 1)), "")
    return cut.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.size("gone").cast("long").alias("n_removed"), "gone",
                      F.when(F.size("gone") > 0, kept).otherwise(F.col("text")).alias("kept_text"))
