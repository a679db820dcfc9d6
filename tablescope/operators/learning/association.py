"""Association rules over categorical columns and tercile-binned numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import col
from tablescope.operators.learning import rules as advice
from tablescope.operators.learning.common import Analysis, failed, metrics_table
from tablescope.options import Options
from tablescope.plans.quantiles import quantile_row
from tablescope.plans.runtime import lookup_join, materialize

# Supports tried in turn until enough itemsets are found.
SUPPORTS = (0.3, 0.2, 0.1, 0.05)
ENOUGH = 5


def terciles(df: DataFrame, columns: Sequence[str], opts: Options = Options()) -> DataFrame:
    """Add ``<c>_bin`` (low, mid, high; right-closed); columns whose edges collide are skipped."""
    edges = quantile_row(df, columns, (0.0, 1 / 3, 2 / 3, 1.0), opts)
    new = {}
    for c, (lo, a, b, hi) in edges.items():
        if lo is None or not lo < a < b < hi:
            continue
        new[f"{c}_bin"] = (F.when(col(c) <= a, f"{c}_low").when(col(c) <= b, f"{c}_mid")
                           .when(col(c).isNotNull(), f"{c}_high"))
    return df.withColumns(new) if new else df


def item_sets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete rows as ``(items)``: one ``column=value`` per column, in column order."""
    rows = df.dropna(subset=list(columns))
    items = F.array(*[F.concat(F.lit(f"{c}="), col(c).cast("string")) for c in columns])
    return rows.select(items.alias("items"))


def frequent_itemsets(df: DataFrame, columns: Sequence[str], min_support: float) -> DataFrame:
    """``(items, size, n, support)`` of up to three items.

    Equal rows are counted once with a weight, so the work after the first combined
    aggregate depends on the number of different rows. Rows are then reduced to frequent
    items, and their pairs and triples are counted with map-side combining: a row has at
    most one item per column and a column at most 1 / min_support frequent items.
    """
    rows = materialize(item_sets(df, columns).groupBy("items").agg(F.count(F.lit(1)).alias("w")))
    total = rows.agg(F.sum("w")).first()[0] or 0
    floor_ = min_support * total
    single = (rows.select("w", F.explode("items").alias("item")).groupBy("item")
                  .agg(F.sum("w").alias("n")).where(F.col("n") >= floor_))
    kept = [r["item"] for r in single.collect()]
    if not kept:
        return df.sparkSession.createDataFrame([], "items array<string>, size int, n bigint, support double")
    known = F.array(*[F.lit(i) for i in sorted(kept)])
    slim = rows.select("w", F.array_sort(F.array_intersect("items", known)).alias("s"))
    # The same reduced row can come from many rows.
    slim = slim.where(F.size("s") > 0).groupBy("s").agg(F.sum("w").alias("w"))
    after = lambda s, i: F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0)))
    s = F.col("s")
    ones = F.transform(s, lambda x: F.array(x))
    twos = F.flatten(F.transform(s, lambda x, i: F.transform(after(s, i), lambda y: F.array(x, y))))
    threes = F.flatten(F.transform(s, lambda x, i: F.flatten(F.transform(after(s, i), lambda y, j: F.transform(
        after(s, i + j + 1), lambda z: F.array(x, y, z))))))
    counted = (slim.select("w", F.explode(F.concat(ones, twos, threes)).alias("items"))
                   .groupBy("items").agg(F.sum("w").alias("n")).where(F.col("n") >= floor_))
    return counted.select("items", F.size("items").alias("size"), "n", (F.col("n") / total).alias("support"))


def adaptive_itemsets(df: DataFrame, columns: Sequence[str], until_pairs: bool = False) -> tuple[DataFrame, float]:
    """Itemsets at the highest tried support that gives at least five (``until_pairs``: and a pair), and that support.

    One count at the lowest support serves all of them.
    """
    sets = materialize(frequent_itemsets(df, columns, SUPPORTS[-1]))
    found = sets.agg(*[F.count_if(F.col("support") >= s).alias(f"s{i}") for i, s in enumerate(SUPPORTS)],
                     *[F.count_if((F.col("support") >= s) & (F.col("size") > 1)).alias(f"p{i}") for i, s in enumerate(SUPPORTS)]).first()
    fits = lambda i: found[f"s{i}"] >= ENOUGH and (found[f"p{i}"] > 0 or not until_pairs)
    i = next((i for i in range(len(SUPPORTS)) if fits(i)), len(SUPPORTS) - 1)
    return sets.where(F.col("support") >= SUPPORTS[i]), SUPPORTS[i]


def association_rules(sets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """``(antecedent, consequent, support, confidence, lift)`` for every split of an itemset.

    All parts of a frequent itemset are frequent, so both sides are lookups into the
    itemset table, whose size is limited by columns and support.
    """
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.col("size")).cast("int") - 2)
    split = sets.where("size >= 2").select("items", "support", F.explode(masks).alias("m"))
    bit = lambda i: F.pmod(F.floor(F.col("m") / F.pow(F.lit(2), i)).cast("int"), F.lit(2))
    side = lambda want: F.filter("items", lambda x, i: bit(i) == want)
    split = split.select(side(1).alias("antecedent"), side(0).alias("consequent"), "support")
    part = sets.select("items", F.col("support").alias("s"))
    left = part.select(F.col("items").alias("antecedent"), F.col("s").alias("sa"))
    right = part.select(F.col("items").alias("consequent"), F.col("s").alias("sc"))
    joined = lookup_join(lookup_join(split, left, ["antecedent"], "inner"), right, ["consequent"], "inner")
    confidence = F.col("support") / F.col("sa")
    return (joined.select("antecedent", "consequent", "support", confidence.alias("confidence"),
                          (confidence / F.col("sc")).alias("lift")).where(F.col("lift") >= min_lift))


def top_rules(rules: DataFrame, k: int = 20) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(k)


def top_itemsets(sets: DataFrame, k: int = 20) -> DataFrame:
    return sets.orderBy(F.desc("support"), "items").limit(k)


def association(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                opts: Options = Options(), until_pairs: bool = False) -> Analysis:
    """Frequent itemsets and rules over all categorical and binned columns.

    ``until_pairs`` lowers the support further until some pair is frequent. Without it few, even
    columns can fill the least number of itemsets with single items, and no rule exists: a failed result.
    """
    spark = df.sparkSession
    numeric = [c for c in numeric if c not in categorical]
    binned = terciles(df, numeric, opts)
    used = [*list(categorical), *[f"{c}_bin" for c in numeric if f"{c}_bin" in binned.columns]]
    if len(used) < 2:
        return failed("association", "fewer than two usable columns")
    n = binned.dropna(subset=used).count()
    if n < 20:
        return failed("association", f"too few rows: {n}")
    sets, support = adaptive_itemsets(binned, used, until_pairs)
    found = sets.count()
    if not found:
        return failed("association", "no frequent itemsets")
    rules = materialize(association_rules(sets))
    facts = rules.agg(F.count(F.lit(1)).alias("rules"), F.max("lift").alias("max_lift"),
                      F.max("confidence").alias("max_confidence")).first().asDict()
    if not facts["rules"]:
        return failed("association", "no rules with lift of at least 1")
    name = f"Itemsets (min_support={support})"
    table = metrics_table(spark, {name: {"itemsets": found, **facts, "min_support": support,
                                         "columns": len(used)}})
    return Analysis("association", model_name=name, feature_columns=tuple(used), metrics=table,
                    predictions=rules, recommendations=advice.association(rules, support),
                    tables={"top_rules": top_rules(rules), "top_itemsets": top_itemsets(sets),
                            "itemsets": sets})
