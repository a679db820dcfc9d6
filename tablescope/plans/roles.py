"""Table shape and column roles: which kind of table this is, what each column does."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.exprs import DATE_FORMATS, col, is_number
from tablescope.functions.kinds import kinds, numeric_columns, text_columns
from tablescope.options import SHAPES, Options
from tablescope.plans.stats import distinct_counts, long_aggregate


@dataclass(frozen=True)
class Roles:
    """Names only; no data."""

    shape: str
    confidence: float
    signal: str | None = None
    value: str | None = None
    timestamp: str | None = None
    value_columns: tuple[str, ...] = ()
    value_num: str | None = None
    value_text: str | None = None
    id: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    mixed: tuple[str, ...] = ()
    nested: tuple[str, ...] = ()

    def numbers(self, opts: Options = Options()) -> tuple[str, ...]:
        """Numeric inputs of cleaning and analysis.

        In a time series every number is a value column; strict compatibility leaves
        those out, as a literal reading of the role lists would.
        """
        if opts.strict_compat:
            return self.numeric
        return (*self.numeric, *[c for c in self.value_columns if c not in self.numeric])

    def as_rows(self) -> list[tuple[str, str]]:
        listed = [(n, role) for role in ROLE_NAMES for n in getattr(self, role)]
        key = [(self.signal, "signal"), (self.value, "value"), (self.timestamp, "timestamp")]
        return [(n, r) for n, r in key if n] + [(n, "value_column") for n in self.value_columns] + listed


ROLE_NAMES = ("id", "numeric", "categorical", "datetime", "text", "mixed", "nested")


# --------------------------------------------------------------------------- names
def find_column(names: Sequence[str], hints: Sequence[str]) -> str | None:
    """Exact match in hint order, then the first name that contains a hint."""
    lowered = [(n.lower(), n) for n in names]
    exact = dict(lowered)
    hit = next((exact[h] for h in hints if h in exact), None)
    return hit or next((n for h in hints for low, n in lowered if h in low), None)


def key_columns(df: DataFrame, opts: Options = Options()) -> tuple[str | None, str | None, str | None]:
    """(signal, value, timestamp) by name."""
    return tuple(find_column(df.columns, h)
                 for h in (opts.signal_hints, opts.value_hints, opts.time_hints))


def clean_names(names: Sequence[str]) -> list[str]:
    """Strip, turn blanks/dots/dashes into ``_``, drop other punctuation, number repeats.

    Repeats are found ignoring case, because Spark resolves names that way.
    """
    tidy = [re.sub(r"[^\w]", "", re.sub(r"[\s.\-]+", "_", n.strip())) for n in names]
    total: dict[str, int] = {}
    for n in tidy:
        total[n.lower()] = total.get(n.lower(), 0) + 1
    taken = {n.lower() for n in tidy if total[n.lower()] == 1}
    seen: dict[str, int] = {}
    out = []
    for n in tidy:
        if total[n.lower()] == 1:
            out.append(n)
            continue
        k = seen.get(n.lower(), 0)
        while f"{n}_{k}".lower() in taken:
            k += 1
        seen[n.lower()] = k + 1
        taken.add(f"{n}_{k}".lower())
        out.append(f"{n}_{k}")
    return out


def sanitize(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


# --------------------------------------------------------------------------- shape
def shape_scores(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """``(shape, score)``: four rows from one aggregate over the value column."""
    signal, value, ts = key_columns(df, opts)
    width = len(df.columns)
    numbers, texts = numeric_columns(df), text_columns(df)
    n = F.col("_n")

    base = (0.4 if signal else 0.0) + (0.3 if value else 0.0) + (0.2 if ts else 0.0)
    mixed = is_number(col(value)) if value in texts else None
    share = F.avg(F.when(mixed, 1.0).otherwise(0.0)) if mixed is not None else F.lit(0.0)
    pool = (F.lit(base)
            + F.when((F.col("_share") > 0.1) & (F.col("_share") < 0.95), 0.1).otherwise(0.0)
            + F.when(n > width * 50, 0.05).otherwise(0.0))

    series = 0.0 if not ts else 0.1 if not numbers else 0.3 + 0.4 + 0.2 + (0.0 if signal else 0.1)
    wide = 0.3 + (0.3 if len(numbers) > 3 else 0) + (0.2 if width >= 5 else 0) + (0.1 if width > 10 else 0)
    mostly_text = len(texts) / max(width, 1) > 0.5
    cross = F.when(F.lit(mostly_text) & (n < 200), 0.5).otherwise(0.1)

    scores = dict(zip(SHAPES, (pool, F.lit(series), F.lit(wide), cross)))
    rows = F.array(*[F.struct(F.lit(s).alias("shape"),
                              F.least(e.cast("double"), F.lit(1.0)).alias("score"))
                     for s, e in scores.items()])
    return (df.agg(F.count(F.lit(1)).alias("_n"), share.cast("double").alias("_share"))
              .select(F.explode(rows).alias("r")).select("r.*"))


# --------------------------------------------------------------------------- roles
def _date_shares(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Cells per date layout; text too long to be a date is ruled out first."""
    short = df.select(*[F.when(F.length(F.trim(col(c))).between(4, 40), F.trim(col(c))).alias(c) for c in texts])
    metrics = {f"d{i}": (lambda c, f=f, p=p: F.count_if(
        F.when(c.rlike(p), F.try_to_timestamp(c, F.lit(f))).isNotNull()))
        for i, (p, f) in enumerate(DATE_FORMATS)}
    return long_aggregate(short, texts, metrics)


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """Per column: kind, rows, non-null, numeric share, best date layout, distinct count.

    One fused pass gives everything but the distinct counts, and a sketch for those.
    Exact distinct counting is a shuffle of all values, so it is only run for columns
    where a rule could depend on it.
    """
    columns = list(columns or df.columns)
    kind = kinds(df)
    flat = [c for c in columns if kind[c] != "nested"]
    texts = [c for c in flat if kind[c] == "text"]
    facts = {c: {"kind": kind[c], "rows": 0, "filled": 0, "numeric": 0, "distinct": 0, "date": 0}
             for c in columns}
    if columns:
        counted = long_aggregate(df, columns, {"rows": lambda c: F.count(F.lit(1)), "filled": F.count})
        for r in counted.collect():
            facts[r["column"]].update(rows=r["rows"], filled=r["filled"])
    if texts:
        for r in long_aggregate(df, texts, {"ok": lambda c: F.count_if(is_number(c))}).collect():
            facts[r["column"]]["numeric"] = r["ok"]
        for r in _date_shares(df, texts).collect():
            facts[r["column"]]["date"] = max(r[f"d{i}"] for i in range(len(DATE_FORMATS)))
    count_me = [c for c in flat if kind[c] != "datetime"]
    if count_me:
        keys = df.select(*[col(c).cast("string").alias(c) for c in count_me])
        sketch = long_aggregate(keys, count_me, {
            "k": lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, 12))})
        close = []
        for r in sketch.collect():
            fact = facts[r["column"]]
            fact["distinct"] = r["k"]
            if _distinct_matters(r["k"], fact["rows"]):
                close.append(r["column"])
        if close:
            for r in distinct_counts(df, close).collect():
                facts[r["column"]]["distinct"] = r["n_distinct"]
    return facts


def _distinct_matters(estimate: int, rows: int) -> bool:
    """Whether the estimate is small or within ten percent of a rule's threshold."""
    edges = (0.05 * rows, 0.8 * rows)
    return estimate <= 200 or any(0.9 * e <= estimate <= 1.1 * e for e in edges)


def role_of(name: str, fact: dict) -> str:
    rows = max(fact["rows"], 1)
    ratio = fact["distinct"] / rows
    kind = fact["kind"]
    if kind in ("nested", "datetime"):
        return kind
    if kind in ("numeric", "boolean"):
        if "id" in name.lower() and ratio > 0.8:
            return "id"
        return "categorical" if fact["distinct"] <= 20 and ratio < 0.05 else "numeric"
    if fact["filled"] and fact["date"] / fact["filled"] > 0.8:
        return "datetime"
    if fact["filled"] / rows > 0.05 and 0.05 < fact["numeric"] / rows < 0.95:
        return "mixed"
    return "categorical" if fact["distinct"] <= 50 or ratio < 0.05 else "text"


def column_roles(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    return {c: role_of(c, f) for c, f in column_facts(df, columns).items()}


def roles_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, role)`` for querying."""
    return df.sparkSession.createDataFrame(list(column_roles(df, columns).items()),
                                           "column string, role string")


def detect(df: DataFrame, opts: Options = Options()) -> Roles:
    """Shape with the best score (or the forced one) and a role for every column."""
    if opts.force_schema:
        shape, confidence = opts.force_schema, 1.0
        shape = shape if shape in SHAPES else "wide_table"
    else:
        scored = {r["shape"]: r["score"] for r in shape_scores(df, opts).collect()}
        shape = max(SHAPES, key=lambda s: round(scored[s], 9))
        confidence = scored[shape]
    signal, value, ts = key_columns(df, opts)
    known: dict = {}
    if shape == "signal_pool":
        known = {"signal": signal, "value": value, "timestamp": ts}
    elif shape == "time_series":
        known = {"timestamp": ts, "value_columns": tuple(c for c in numeric_columns(df) if c != ts)}
    taken = {v for k, v in known.items() if k != "value_columns"} | set(known.get("value_columns", ()))
    found = column_roles(df, [c for c in df.columns if c not in taken])
    listed = {r: tuple(c for c, role in found.items() if role == r) for r in ROLE_NAMES}
    return Roles(shape=shape, confidence=confidence, **known, **listed)


def with_split(roles: Roles, num: str, text: str) -> Roles:
    return replace(roles, value_num=num, value_text=text)


# --------------------------------------------------------------------------- rules
def summary_rows(spark, roles: Roles) -> DataFrame:
    """``(property, value)``: the shape, key columns and role lists."""
    rows = [("shape", roles.shape), ("confidence", f"{roles.confidence:.0%}")]
    rows += [(k, getattr(roles, k)) for k in ("signal", "value", "timestamp") if getattr(roles, k)]
    lists = ("value_columns", "numeric", "categorical", "datetime", "mixed")
    rows += [(k, ", ".join(getattr(roles, k))) for k in lists if k != "value_columns" or roles.value_columns]
    return spark.createDataFrame(rows, "property string, value string")


# Label and reason per situation.
TYPOLOGY = {
    "event": ("Event/Signal Data", "signal name, value and timestamp columns"),
    "panel": ("Panel Data", "entity id and time column"),
    "series": ("Time Series", "time column"),
    "transaction": ("Transaction Data", "entity id and time column in a wide table"),
    "entity": ("Entity Data", "entity id column"),
    "static": ("Static Wide Table", "rows are samples, columns are features"),
}


def typology(df: DataFrame, roles: Roles | None = None) -> tuple[str, str]:
    """Data typology label and the reason for it."""
    if roles is None:
        has_time = "datetime" in kinds(df).values()
        has_id = any("id" in c.lower() for c in df.columns)
        return TYPOLOGY["panel" if has_time and has_id else "series" if has_time else "static"]
    if roles.shape == "signal_pool":
        return TYPOLOGY["event"]
    if roles.shape == "time_series":
        return TYPOLOGY["panel" if roles.id else "series"]
    if roles.shape == "wide_table" and roles.id:
        return TYPOLOGY["transaction" if roles.timestamp else "entity"]
    return TYPOLOGY["static"]


def find_target(df: DataFrame, roles: Roles, names: Sequence[str], max_classes: int,
                squeeze_blanks: bool = True) -> str | None:
    """Target by normalised name, else the first categorical with 2..max_classes values."""
    for c in df.columns:
        plain = c.lower().replace("_", "")
        if (plain.replace(" ", "") if squeeze_blanks else plain) in names:
            return c
    candidates = [c for c in roles.categorical if c in df.columns]
    if not candidates:
        return None
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, candidates).collect()}
    return next((c for c in candidates if 2 <= counts[c] <= max_classes), None)


def detect_categorical(df: DataFrame, threshold: int = 10) -> list[str]:
    """Columns worth encoding: text, or numbers with 2..threshold distinct values."""
    kind = kinds(df)
    numbers = [c for c, k in kind.items() if k in ("numeric", "boolean")]
    few: set[str] = set()
    if numbers:
        counts = distinct_counts(df, numbers).where(F.col("n_distinct").between(2, threshold))
        few = {r["column"] for r in counts.collect()}
    return [c for c, k in kind.items() if k == "text" or c in few]
