"""Thresholds and limits used across the package, in one immutable record.

Every default is a fixed value the results depend on; change them through
``dataclasses.replace(Options(), ...)``.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: column-name hints, in order of preference -----------------
SIGNAL_HINTS = (
    "signalname", "signal_name", "tag_name", "tagname", "sensor_name", "parameter", "item",
)
VALUE_HINTS = ("value", "val", "measurement", "reading", "data")
TIME_HINTS = (
    "updatedate", "timestamp", "datetime", "date", "time", "created_at",
    "updated_at", "event_time", "log_time", "recordtime",
)

# --- fixed values: names that mark a prediction target -----------------------
TARGET_NAMES_EDA = (
    "passfail", "passorfail", "pass_or_fail", "label", "target", "result", "outcome",
    "결과", "양불", "합불", "판정", "judge", "churn",
)
TARGET_NAMES_PROPOSAL = (
    "passfail", "passorfail", "label", "target", "result", "outcome", "churn", "judge",
)
TARGET_NAMES_ANALYSIS = ("passfail", "label", "target", "result", "churn", "judge")

# --- fixed values: columns that must not be negative, ratio pairs, churn names
NON_NEGATIVE_HINTS = ("count", "qty", "quantity", "age", "price", "amount")
RATIO_HINTS = (
    ("amount", "price"), ("revenue", "cost"), ("success", "total"),
    ("pass", "total"), ("count", "total"),
)
CUSTOMER_HINTS = ("customer", "user", "client", "고객", "churn", "active")

SHAPES = ("signal_pool", "time_series", "wide_table", "cross_tab")


@dataclass(frozen=True)
class Options:
    # shape and role detection
    force_schema: str | None = None
    strict_compat: bool = False
    signal_hints: tuple[str, ...] = SIGNAL_HINTS
    value_hints: tuple[str, ...] = VALUE_HINTS
    time_hints: tuple[str, ...] = TIME_HINTS

    # cleaning
    auto_parse_dates: bool = True
    drop_threshold: float = 0.95
    fill_numeric: str = "median"
    fill_categorical: str = "mode"
    outlier_method: str = "iqr"
    outlier_action: str = "clip"
    iqr_factor: float = 2.5
    zscore_threshold: float = 3.5
    extract_calendar: bool = True
    categorical_threshold: int = 10

    # features
    enable_features: bool = True
    date_features: bool = True
    row_stat_columns: int | None = None  # first columns of the row statistics; None: all
    lags: tuple[int, ...] = (1, 2, 3, 7)
    rolling_rows: int = 7
    forecast_lags: tuple[int, ...] = (1, 2, 3, 7, 14)
    forecast_windows: tuple[int, ...] = (7, 14)

    # exploration
    correlation_threshold: float = 0.7
    top_categories: int = 15
    ma_short: int = 20
    ma_long: int = 100
    anomaly_sigma: float = 2.5
    histogram_bins: int = 30
    kde_points: int = 200

    # learning
    seed: int = 42
    test_fraction: float = 0.2
    trees: int = 100
    boosting_rounds: int = 100
    forest_depth: int = 10
    max_features: int | None = None  # first columns of a model; None: all
    reference_inputs: bool = False    # proposals name the first few columns, like the reference
    kmeans_restarts: int = 3
    isolation_trees: int = 100
    isolation_rows: int = 256
    contamination: float = 0.1

    # physical limits (sizes that are checked before a strategy is chosen)
    buffer_rows: int = 50_000        # largest table whose percentiles skip the sketch
    exact_rows: int = 2_000_000      # largest group handed to one exact-percentile buffer
    block_rows: int = 1_000_000      # rows per ordered-window block
    range_rows: int = 500_000        # rows per range of a range sort with more than few_ranges ranges
    few_ranges: int = 64             # ranges of a range sort that may be smaller than that
    range_partitions: int = 20_000   # most partitions of one range sort (bounds are sampled on the driver)
    broadcast_rows: int = 1_000_000  # largest lookup table that is broadcast
    max_classes: int = 1_000         # most classes of a target; counted before any list of them is made
    onehot_limit: int = 1_000        # widest one-hot expansion of one column
    broadcast_bytes: int = 64 << 20  # most bytes of a lookup table that is broadcast
    hot_rows: int = 1_000_000        # rows of one key from which it is spread over copies in a lookup
