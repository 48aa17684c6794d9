from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapegrid.config import Study  # noqa: E402
from tapegrid.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def study() -> Study:
    """Small windows and blocks, so that every window crosses block borders."""
    return Study(
        targets=("aa", "bb"),
        contexts=("cc",),
        bar_seconds=3_600,
        grid_start="2024-01-01 00:00:00",
        train_start="2024-01-05 12:00:00",
        research_months=("2024-04", "2024-05"),
        forward_months=("2024-06",),
        research_end="2024-06-01 00:00:00",
        forward_end="2024-07-01 00:00:00",
        event_window=("2024-02-10 00:00:00", "2024-02-12 00:00:00"),
        lags=(2, 5),
        mean_windows=(3, 7),
        long_window=24,
        flow_windows=(3, 6),
        excess_lags=(2, 5),
        corr_window=12,
        beta_window=20,
        horizons=(2, 5),
        har_windows=(3, 6, 12),
        extreme_window=24,
        extreme_sigmas=4.0,
        draws=200,
        block_rows=50,
    )
