"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``MEASURES`` names the counts of a text as column expressions, ``RULES`` a ratio of two of them
with its allowed range. ``measure`` and ``judge`` turn both tables into select lists, so a text
is read once and no user function runs; there is no shuffle.

Defined results: a null or empty text has no words, all counts are 0 and base_failed is true;
a ratio without a denominator passes; repeated rows give equal rows; extra columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that for was with as on be at by this are from or an",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur",
    "es": "de la que el en y los del se las por un para con no una su al lo como",
}
WHITE = " \t\n\u000b\f\r"

#: (rule, numerator, denominator, least, most); None leaves a side open.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.10),
    ("bangs_per_word", "n_bangs", "n_words", None, 0.30),
    ("upper_per_letter", "n_upper", "n_letters", None, 0.50),
    ("letters_per_char", "n_letters", "word_chars", 0.60, None),
    ("stop_words_per_word", "n_stop", "n_words", 0.02, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.50),
    ("bullet_lines", "n_bullets", "n_lines", None, 0.90),
    ("ellipsis_lines", "n_ellipses", "n_lines", None, 0.30),
)
MIN_WORDS = 50


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _line_measures() -> dict[str, Column]:
    lines = F.col("_lines")
    return {
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike("^\\s*[-*\u2022]"))).cast("long"),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|\u2026)\\s*$"))).cast("long"),
    }


def _repeated_words() -> Column:
    """Words covered by three-word windows that occur more than once, from sorted (hash, place) windows."""
    places = F.col("_repeats")
    step = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """All counts of every text beside the columns ``keep``."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(*keep, text.alias("_text"))
    split = texts.select("*", F.filter(F.split("_text", f"[{WHITE}]+"), lambda w: w != "").alias("_words"),
                         F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("_lines"))
    word = F.col("_words")
    windows = split.select("*", F.sort_array(F.transform(
        F.slice(word, 1, F.greatest(F.size(word) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)).alias("h"), i.alias("i")))).alias("_w"))
    sorted_ = F.col("_w")
    repeats = windows.select("*", F.sort_array(F.transform(F.filter(
        sorted_, lambda w, i: (w["h"] == F.get(sorted_, i + 1)["h"]) | (w["h"] == F.get(sorted_, i - 1)["h"])), lambda w: w["i"])).alias("_repeats"))
    measures = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", f"[{WHITE}]", "")).cast("long"),
        "n_symbols": _matches(F.col("_text"), "[#*$%&|<>]"),
        "n_bangs": _matches(F.col("_text"), "[!?]"),
        "n_upper": _matches(F.col("_text"), "\\p{Lu}"),
        "n_letters": _matches(F.col("_text"), "\\p{L}"),
        "n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long"),
        "n_repeat_words": _repeated_words(),
        **_line_measures(),
    }
    return repeats.select(*keep, *[c.alias(name) for name, c in measures.items()])


def verdict(rules=RULES) -> Column:
    """True if every ratio of the table is inside its range."""
    ok = F.lit(True)
    for _, top, bottom, least, most in rules:
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
        if least is not None:
            ok = ok & (ratio.isNull() | (ratio >= least))
        if most is not None:
            ok = ok & (ratio.isNull() | (ratio <= most))
    return ok


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (measure(docs, "doc_id").withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
