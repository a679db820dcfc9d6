"""Registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import (chat_format, context_tree, decontam, histogram_sort, language_crf, mixing, ngram_join, periodic_runs,
                            prefix_trie, quality_rules, sentence_spans, suffix_dedup, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], rows.schema)
    return chat_format.digests(chat_format.format_chats(chat_format.text_turns(rows.union(extra))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_report(_table(spark, sf_dir, "documents"), 50)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                              "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op7_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_tree.score(_table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    return found.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_crf.languages(_table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.dedup_sentences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    conv_ids, rebuilt = prefix_trie.share_heads(turns, block=20, heads=4)
    found = prefix_trie.prefix_trie(prefix_trie.conversation_paths(rebuilt, conv_ids))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; documents whose crc32(doc_id) ends in 0 repeat their words from place a on with period p, joined by spaces."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))

    def repeat(w):
        n = F.size(w)
        a = F.expr("cast(g as int)") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    # the word list is bound once as a lambda's variable
    return docs.select("doc_id", F.when(F.col("planted") & F.col("text").isNotNull(), F.transform(F.array(words), repeat)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_with_planted_periods(_table(spark, sf_dir, "documents"))))


def op13_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histogram_sort.shards(_table(spark, sf_dir, "documents"), parts=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_chat_formatting, op3_quality_rules, op4_suffix_array_dedup, op5_mixing, op6_toxicity,
    op7_context_tree_scoring, op8_language_crf, op9_sentence_spans, op10_decontamination, op11_prefix_trie,
    op12_periodic_runs, op13_histogram_sort, pipeline)}

#: Queries that SQL can express.
ORACLES: dict[str, str] = {}
