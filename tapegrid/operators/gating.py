"""Volatility-aware versions of a strategy: an edge gate and inverse-volatility sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.config import EDGE_PER_UNIT_IC, SIZE_CAP, VERSIONS, Study
from tapegrid.functions.columns import month_of, ratio
from tapegrid.operators.positions import (
    Cell,
    bar_flows,
    daily_flows,
    frame_on_bars,
    net_of,
    pnl_stats,
    rule_signal,
    with_positions,
)
from tapegrid.session import settle


def expected_edge(valid_ic: Column, sigma: Column, rule: str) -> Column:
    return F.lit(EDGE_PER_UNIT_IC[rule]) * valid_ic * sigma


def edge_covers_fee(valid_ic: Column, sigma: Column, rule: str, fee_bps: Column) -> Column:
    """Whether the edge pays both ways of a trade; unknown means no."""
    return F.coalesce(expected_edge(valid_ic, sigma, rule) >= 2 * fee_bps / 1e4, F.lit(False))


def inverse_volatility_size(median: Column, pred: Column) -> Column:
    """Validation-month median volatility over the forecast, capped; unknown stays unknown."""
    raw = F.exp(median - pred)
    return F.when(raw.isNotNull(), F.least(raw, F.lit(SIZE_CAP)))


def tranche_scale(version: Column, is_open: Column, size: Column) -> Column:
    gate = F.when(is_open, 1.0).otherwise(0.0)
    return (
        F.when(version == "base", F.lit(1.0))
        .when(version == "gated", gate)
        .otherwise(F.when(is_open, size).otherwise(F.lit(0.0)))
    )


def version_bars(
    direction: DataFrame,
    volatility: DataFrame,
    bars: DataFrame,
    keys: Sequence[str],
    study: Study,
    rule: str,
    versions: Sequence[str] = VERSIONS,
) -> DataFrame:
    """Positions and flows per version and fee; each tranche is scaled before averaging."""
    keys = list(keys)
    forecasts = volatility.select(
        *keys, "pos", F.col("pred").alias("_v_pred"), F.col("q50").alias("_v_median")
    )
    rows = frame_on_bars(direction, bars, keys).join(forecasts, [*keys, "pos"], "left")
    size = inverse_volatility_size(F.col("_v_median"), F.col("_v_pred"))
    signal = rule_signal(rule)
    scales, scaled, cells = {}, {}, []
    for version in versions:
        for number, (fee, bps) in enumerate(study.fees_bps):
            is_open = edge_covers_fee(F.col("valid_ic"), F.exp("_v_pred"), rule, F.lit(bps))
            # The base version is the same at every fee.
            name = version if version == "base" else f"{version}{number}"
            scales[f"_x_{name}"] = tranche_scale(F.lit(version), is_open, size)
            scaled[f"_w_{name}"] = F.col("signal") * F.col(f"_x_{name}")
            labels = {"version": F.lit(version), "fee": F.lit(fee), "fee_bps": F.lit(bps)}
            cells.append(Cell(labels | {"scale": F.col(f"_x_{name}")}, f"_w_{name}"))
    base = [*keys, "pos", "open_time", "bar_return", "rate"]
    rows = rows.select(*base, signal.alias("signal"), *[c.alias(n) for n, c in scales.items()])
    placed = with_positions(
        rows.withColumns(scaled), keys, cells, study.horizons, (0,), study.block_rows
    )
    return bar_flows(placed.drop(*scales, *scaled))


def gate_counts() -> dict[str, Column]:
    opened = (F.col("signal") != 0) & (F.col("scale") > 0)
    return {
        "signalled": F.count_if(F.col("signal") != 0),
        "opened": F.count_if(opened),
        "opened_size": F.sum(F.when(opened, F.col("scale"))),
    }


def version_daily(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily flows net of the cell's own fee, with the gate's counts."""
    daily = daily_flows(rows, [*keys, "version", "fee", "fee_bps"], gate_counts())
    return net_of(daily, F.col("fee_bps")).drop("fee_bps")


def gate_shares() -> list[Column]:
    return [
        ratio(F.sum("opened").cast("double"), F.sum("signalled")).alias("gate_share"),
        ratio(F.sum("opened_size"), F.sum("opened")).alias("mean_size"),
    ]


def version_stats(daily: DataFrame, hold: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    settled = settle(daily)
    gate = settled.groupBy(*keys).agg(*gate_shares())
    return pnl_stats(settled, hold, keys, study).join(gate, list(keys), "left")


def monthly_gate(daily: DataFrame, direction: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share and size of what the gate lets through per month, with the month's validation IC."""
    keys = list(keys)
    months = (
        daily.where(F.col("version") == "sized")
        .groupBy(*keys, "fee", month_of("day").alias("month"))
        .agg(*gate_shares())
    )
    skill = direction.groupBy(*keys, F.col("test_month").alias("month")).agg(
        F.min_by("valid_ic", "pos").alias("valid_ic")
    )
    return months.join(skill, [*keys, "month"], "left")


def gate_text() -> Column:
    """Label of a month: no validation IC, a useless one, or the share traded."""
    share = F.concat(F.format_string("%.0f", F.bround(F.col("gate_share") * 100, 0)), F.lit("%"))
    return (
        F.when(F.col("valid_ic").isNull(), "no IC")
        .when(F.col("valid_ic") <= 0, "IC ≤ 0")
        .otherwise(share)
    )
