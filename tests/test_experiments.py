"""All experiments in a row on made-up bars, each with the choices of the earlier ones."""

from __future__ import annotations

import pytest
from helpers import make_bars
from pyspark.sql import functions as F

from tapegrid.operators import decisions
from tapegrid.plans import experiments
from tapegrid.plans.lab import Lab

BARS = 182 * 24


@pytest.fixture(scope="module")
def lab(spark, study):
    small = study.with_changes(horizons=(2,), draws=50, block_rows=1_000)
    raw = make_bars(small.assets, BARS)
    rows = spark.createDataFrame(raw)
    settled = rows.where("pos % 8 = 0").select("asset", "pos", "open_time", F.lit(1e-5).alias("rate"))
    return Lab(spark, small, rows, settled)


@pytest.fixture(scope="module")
def study_run(lab):
    return dict(experiments.study_tables(lab, families=("momentum",), challenger="ridge"))


def test_every_experiment_gives_its_tables(study_run):
    assert list(study_run) == [
        "audit", "horizon_sweep", "feature_sources", "retraining", "economics", "forward",
        "volatility", "volatility_strategy", "pooled",
    ]
    for experiment in ("audit", "horizon_sweep", "retraining", "economics", "forward", "volatility", "volatility_strategy"):
        for name, table in study_run[experiment].items():
            assert table.columns, (experiment, name)
    choices = {k: t["choice"].first().asDict() for k, t in study_run.items() if "choice" in t and k != "pooled"}
    assert choices["retraining"]["policy"] in ("expanding", "fixed", "rolling_3m")
    assert choices["economics"]["rule"] in ("median", "outer30", "outer10")
    assert choices["volatility"]["model"] in ("har", "ridge")
    assert choices["volatility_strategy"]["version"] in ("base", "gated", "sized")
    assert study_run["forward"]["economics"].count() > 0
    assert study_run["horizon_sweep"]["configurations"].count() == 2


def test_the_forward_run_stops_at_another_record(lab, study_run):
    parts = [study_run[k][n] for k, n in (("horizon_sweep", "selection"), ("feature_sources", "choice"), ("retraining", "choice"), ("economics", "choice"))]
    chosen = decisions.chosen_configuration(*parts)
    record = chosen.first().asDict()
    decisions.require_frozen(chosen, record)
    with pytest.raises(ValueError, match="differs"):
        decisions.require_frozen(chosen, record | {"rule": "none of them"})


def test_nothing_to_choose_is_an_error(spark):
    empty = spark.createDataFrame([(None,)], "rule string")
    with pytest.raises(ValueError, match="no rule"):
        experiments.only_value(empty, "rule", "rule")
