"""Studies over the event and order-line tables, and their labs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tapegrid.config import Study
from tapegrid.operators.bootstrap import forget_weights
from tapegrid.operators.trees import TreeSettings
from tapegrid.plans.lab import Lab
from tapegrid.session import prepare
from tapegrid.sources import derived, files

# Event types as assets on hourly bars.
EVENTS = Study(
    targets=("click", "purchase", "view"),
    contexts=("error", "signup"),
    bar_seconds=3_600,
    grid_start="2024-01-01 00:00:00",
    train_start="2024-01-03 00:00:00",
    research_months=("2024-01",),
    forward_months=("2024-01",),
    research_end="2024-01-31 00:00:00",
    forward_end="2024-01-31 00:00:00",
    event_window=("2024-01-10 00:00:00", "2024-01-12 00:00:00"),
    lags=(2, 4, 8, 12),
    mean_windows=(4, 8, 12),
    long_window=24,
    flow_windows=(4, 8),
    excess_lags=(4, 8, 12),
    corr_window=12,
    beta_window=24,
    horizons=(2, 4, 8),
    har_windows=(3, 6, 12),
    extreme_window=48,
    extreme_sigmas=2.0,
    benchmark_days=5,
    benchmark_min_days=3,
    block_rows=256,
)

# Return flags and line statuses as assets on daily bars, over the whole ship-date range.
LINES = Study(
    targets=("flag_a", "flag_n", "flag_r"),
    contexts=("status_f", "status_o"),
    bar_seconds=86_400,
    grid_start="1995-01-02 00:00:00",
    train_start="1995-05-10 00:00:00",
    research_months=("2001-01", "2001-02", "2001-03", "2001-04", "2001-05", "2001-06"),
    forward_months=("2001-07", "2001-08", "2001-09", "2001-10"),
    research_end="2001-07-01 00:00:00",
    forward_end="2001-11-01 00:00:00",
    event_window=("1998-10-10 00:00:00", "1998-10-20 00:00:00"),
    lags=(2, 5, 10, 20),
    mean_windows=(5, 10, 20),
    long_window=60,
    flow_windows=(5, 10),
    excess_lags=(5, 10, 20),
    corr_window=20,
    beta_window=40,
    horizons=(2, 5),
    har_windows=(3, 10, 20),
    extreme_window=60,
    extreme_sigmas=2.5,
    block_rows=512,
)

_LABS: dict[tuple, Lab] = {}


def _lab(spark: SparkSession, folder: str, name: str, build) -> Lab:
    prepare(spark)
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _LABS:
        _LABS[key] = build()
    return _LABS[key]


def forget() -> None:
    """Drop the held labs and draws, so the next query starts from the tables again."""
    _LABS.clear()
    forget_weights()


def events_lab(spark: SparkSession, folder: str) -> Lab:
    def build() -> Lab:
        events = derived.read(spark, folder, "events")
        text = derived.event_funding_text(events)
        funding = files.clean_funding(text, text["asset"], EVENTS)
        return Lab(spark, EVENTS, derived.event_bars(events, EVENTS), funding)

    return _lab(spark, folder, "events", build)


def lines_lab(spark: SparkSession, folder: str) -> Lab:
    def build() -> Lab:
        lines = derived.read(spark, folder, "lineitem")
        return Lab(
            spark,
            LINES,
            derived.line_bars(lines, LINES),
            derived.line_funding(lines, LINES),
            TreeSettings(rows_per_leaf_per_bar=20),
        )

    return _lab(spark, folder, "lines", build)
