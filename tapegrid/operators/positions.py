"""Signals, tranche positions, profit and loss, and strategy statistics.

A strategy cell (coin, horizon, rule, delay, ...) is a set of key columns. Fees enter only where
turnover is already summed per day, so fee levels never multiply bars. Bar windows run in time
blocks; day windows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapegrid.config import RULES, Study
from tapegrid.functions.columns import between, ratio
from tapegrid.operators.blocks import blocked, in_block, owned, with_carry
from tapegrid.operators.bootstrap import gross_and_net, sharpe
from tapegrid.operators.returns import daily_closes, day_of, wide
from tapegrid.operators.scoring import centred_signal, equal_weight
from tapegrid.session import settle

FLOWS = ("gross", "fees", "funding", "net", "turnover")


def signals(pred: Column, low: Column, high: Column) -> Column:
    """Plus one above the high level, minus one below the low level, flat otherwise or if unknown."""
    return F.when(pred > high, 1).when(pred < low, -1).otherwise(0)


def rule_signal(rule: str) -> Column:
    low, high = RULES[rule]
    return signals(centred_signal("pred"), centred_signal(low), centred_signal(high))


@dataclass(frozen=True)
class Cell:
    """One strategy over the same bars: its label columns and the column of its signal."""

    labels: Mapping[str, Column]
    signal: str


def tranche_sum(signal: str, size: int, window: WindowSpec) -> Column:
    frame = window.rowsBetween(-(size - 1), 0)
    return F.coalesce(F.sum(F.coalesce(F.col(signal).cast("double"), F.lit(0.0))).over(frame), F.lit(0.0))


def _of_horizon(horizons: Sequence[int], value: Callable[[int], Column]) -> Column:
    chosen = F.lit(None).cast("double")
    for h in horizons:
        chosen = F.when(F.col("horizon") == h, value(h)).otherwise(chosen)
    return chosen


def with_positions(
    rows: DataFrame,
    keys: Sequence[str],
    cells: Sequence[Cell],
    horizons: Sequence[int],
    delays: Sequence[int],
    block_rows: int,
    whole: bool = False,
) -> DataFrame:
    """Every cell and delay as a row: its labels, ``position``, ``held`` (before) and ``turnover``.

    The position averages the last ``horizon`` signals, ``delay`` bars late. The last bar of a key
    pays for closing what it still holds. Cells are columns until the one sort of the bars is done.
    ``whole`` says that signals are whole numbers: then a position is an exact difference of running
    sums, one per cell however many horizons there are.
    """
    reach = max(horizons) + max(delays) + 1
    rows = blocked(rows, "pos", before=reach, after=1, block_rows=block_rows)
    line = in_block(keys, "pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    signals_used = list(dict.fromkeys(c.signal for c in cells))
    if whole:
        zero = F.lit(0.0)
        rows = rows.withColumns(
            {f"_sum_{n}": F.sum(F.coalesce(F.col(n).cast("double"), zero)).over(so_far) for n in signals_used}
        )

    def tranches(name: str, size: int) -> Column:
        if not whole:
            return tranche_sum(name, size, line)
        return F.col(f"_sum_{name}") - F.lag(f"_sum_{name}", size, 0.0).over(line)

    rows = rows.withColumns(
        {f"_at_{n}": _of_horizon(horizons, lambda h, n=n: tranches(n, h) / h) for n in signals_used}
    ).withColumn("_is_last", F.lead("pos").over(line).isNull())
    built = F.array(
        *[
            F.struct(
                *[value.alias(name) for name, value in cell.labels.items()],
                F.lit(d).alias("delay"),
                (F.lag(f"_at_{cell.signal}", d, 0.0).over(line) if d else F.col(f"_at_{cell.signal}")).alias("position"),
                F.lag(f"_at_{cell.signal}", d + 1, 0.0).over(line).alias("held"),
            )
            for cell in cells
            for d in delays
        ]
    )
    added = [f"_{kind}_{n}" for n in signals_used for kind in ("at", "sum")]
    rows = owned(rows.withColumn("_cells", built)).withColumn("_cell", F.explode("_cells"))
    position, held = F.col("_cell.position"), F.col("_cell.held")
    closing = F.when(F.col("_is_last"), F.abs(position)).otherwise(F.lit(0.0))
    names = [*cells[0].labels, "delay"]
    return rows.withColumns(
        {n: F.col(f"_cell.{n}") for n in names}
        | {"position": position, "held": held, "turnover": F.abs(position - held) + closing}
    ).drop("_cells", "_cell", "_is_last", *added)


def with_position(
    rows: DataFrame,
    keys: Sequence[str],
    signal: str,
    horizons: Sequence[int],
    delays: Sequence[int],
    block_rows: int,
) -> DataFrame:
    """``with_positions`` of a single signal."""
    return with_positions(rows, keys, [Cell({}, signal)], horizons, delays, block_rows)


def period_bars(grid: DataFrame, funding: DataFrame, study: Study, period: str) -> DataFrame:
    """Target bars of a period with the simple return since the last known close and the rate.

    The return of an untraded stretch is that of the bar which ends it.
    """
    months, end = study.periods[period]
    rows = grid.where(
        F.col("asset").isin(list(study.targets))
        & between("open_time", f"{months[0]}-01 00:00:00", end)
    ).select(F.col("asset").alias("coin"), "pos", "open_time", "close")
    rows = with_carry(rows, ["coin"], "pos", F.col("close"), "_carry", study.block_rows)
    before = in_block(["coin"], "pos").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.last("close", ignorenulls=True).over(before), F.col("_carry"))
    moved = rows.withColumn("_known", known).withColumn(
        "bar_return", F.coalesce(ratio("close", "_known") - 1, F.lit(0.0))
    )
    rates = funding.select(F.col("asset").alias("coin"), "pos", "rate")
    return (
        moved.join(rates, ["coin", "pos"], "left")
        .withColumn("rate", F.coalesce("rate", F.lit(0.0)))
        .select("coin", "pos", "open_time", "close", "bar_return", "rate")
    )


def bar_flows(rows: DataFrame) -> DataFrame:
    """Gross return and funding paid on the position held into the bar."""
    return rows.withColumn("gross", F.col("held") * F.col("bar_return")).withColumn(
        "funding", F.col("held") * F.col("rate")
    )


def bar_pnl(rows: DataFrame, fee_bps: float) -> DataFrame:
    """Per-bar profit at one fee level."""
    fees = F.col("turnover") * (fee_bps / 1e4)
    return bar_flows(rows).withColumn("fees", fees).withColumn(
        "net", F.col("gross") - F.col("fees") - F.col("funding")
    )


def frame_on_bars(frame: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every bar of the period for every configuration of the frame, predictions where present."""
    configurations = settle(frame.select(*keys).distinct())
    base = bars.join(configurations, "coin")
    columns = [c for c in frame.columns if c not in ("open_time", "close", "bar_return", "rate")]
    return base.join(frame.select(*columns), [*keys, "pos"], "left")


def strategy_bars(
    frame: DataFrame,
    bars: DataFrame,
    keys: Sequence[str],
    study: Study,
    rules: Sequence[str] = ("median",),
    delays: Sequence[int] = (0,),
) -> DataFrame:
    """Positions and flows of every configuration, rule and delay."""
    rows = frame_on_bars(frame, bars, keys).select(
        *keys, "pos", "open_time", "bar_return", "rate", *[rule_signal(r).alias(f"_r_{r}") for r in rules]
    )
    cells = [Cell({"rule": F.lit(r), "signal": F.col(f"_r_{r}")}, f"_r_{r}") for r in rules]
    placed = with_positions(
        rows, keys, cells, study.horizons, delays, study.block_rows, whole=True
    )
    return bar_flows(placed.drop(*[f"_r_{r}" for r in rules]))


def daily_flows(bars: DataFrame, keys: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Day sums, with the counts that time in market and long share need."""
    position = F.col("position")
    return bars.groupBy(*keys, day_of().alias("day")).agg(
        F.sum("gross").alias("gross"),
        F.sum("funding").alias("funding"),
        F.sum("turnover").alias("turnover"),
        F.count(F.lit(1)).alias("bars"),
        F.count_if(position != 0).alias("open_bars"),
        F.sum(F.greatest(position, F.lit(0.0))).alias("long_exposure"),
        F.sum(F.abs(position)).alias("exposure"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )


def with_fees(daily: DataFrame, study: Study) -> DataFrame:
    """One row per fee level, net of fees and funding."""
    levels = F.array(
        *[F.struct(F.lit(n).alias("fee"), F.lit(b).alias("bps")) for n, b in study.fees_bps]
    )
    rows = daily.withColumn("_fee", F.explode(levels)).withColumn("fee", F.col("_fee.fee"))
    return net_of(rows, F.col("_fee.bps")).drop("_fee")


def net_of(daily: DataFrame, fee_bps: Column) -> DataFrame:
    fees = fee_bps / 1e4 * F.col("turnover")
    return daily.withColumn("fees", fees).withColumn(
        "net", F.col("gross") - F.col("fees") - F.col("funding")
    )


def breakeven_bps(gross: str = "gross", funding: str = "funding", turnover: str = "turnover") -> Column:
    traded = F.sum(turnover)
    return F.when(traded > 0, (F.sum(gross) - F.sum(funding)) / traded * 1e4)


def drawdown(daily: DataFrame, keys: Sequence[str], value: str = "net") -> DataFrame:
    """Largest fall from the running peak of the summed series, which starts at zero."""
    line = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    equity = daily.withColumn("_equity", F.sum(value).over(line))
    peak = F.greatest(F.max("_equity").over(line), F.lit(0.0))
    return (
        equity.withColumn("_fall", peak - F.col("_equity"))
        .groupBy(*keys)
        .agg(F.max("_fall").alias("max_drawdown"))
    )


def strategy_stats(daily: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    """Daily means, t, Sharpe ratio with interval, drawdown, turnover and breakeven fee."""
    keys = list(keys)
    base = daily.groupBy(*keys).agg(
        (F.avg("gross") * 1e4).alias("gross_bps_day"),
        (F.avg("net") * 1e4).alias("net_bps_day"),
        sharpe("net").alias("sharpe"),
        F.avg("turnover").alias("turnover_day"),
        breakeven_bps().alias("breakeven_bps"),
    )
    return base.join(gross_and_net(daily, keys, study), keys, "left").join(
        drawdown(daily, keys), keys, "left"
    )


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Daily simple return of the forward-filled close; the first day starts at the first price."""
    line = Window.partitionBy("coin").orderBy("day")
    filled = F.last("close", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    closes = daily_closes(bars.withColumnRenamed("coin", "asset")).withColumnRenamed("asset", "coin")
    first = bars.groupBy("coin").agg(F.min_by(F.struct("close"), "pos").alias("_first"))
    rows = closes.withColumn("_filled", filled).join(first, "coin")
    previous = F.when(
        F.row_number().over(line) == 1, F.col("_first.close")
    ).otherwise(F.lag("_filled").over(line))
    return rows.select("coin", "day", (ratio(F.col("_filled"), previous) - 1).alias("hold"))


def exposure_stats(daily: DataFrame, hold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Beta to the target, the target's own return, time in market and long share."""
    joined = daily.join(hold, ["coin", "day"], "left")
    return joined.groupBy(*keys).agg(
        ratio(F.covar_samp("net", "hold"), F.var_samp("hold")).alias("beta"),
        (F.avg("hold") * 1e4).alias("buy_and_hold_bps_day"),
        ratio(F.sum("open_bars").cast("double"), F.sum("bars")).alias("time_in_market"),
        ratio(F.sum("long_exposure"), F.sum("exposure")).alias("long_share"),
    )


def pnl_stats(daily: DataFrame, hold: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    settled = settle(daily)
    return strategy_stats(settled, keys, study).join(
        exposure_stats(settled, hold, keys), list(keys), "left"
    )


def portfolio_daily(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal-weight mean over coins; ``keys`` leaves the coin out."""
    return equal_weight(daily, keys, FLOWS)


def equity_curves(
    net: DataFrame, hold: DataFrame, coins: Sequence[str], value: str = "net"
) -> DataFrame:
    """Running sums per day: each coin's strategy and holding, and the portfolio."""
    strategies = net.select(F.concat("coin", F.lit("_strategy")).alias("curve"), "day", F.col(value).alias("v"))
    holdings = hold.select(F.concat("coin", F.lit("_buy_and_hold")).alias("curve"), "day", F.col("hold").alias("v"))
    together = equal_weight(net, [], [value]).select(
        F.lit("portfolio_strategy").alias("curve"), "day", F.col(value).alias("v")
    )
    names = [f"{c}_{k}" for c in coins for k in ("strategy", "buy_and_hold")]
    return cumulated(
        strategies.unionByName(holdings).unionByName(together), [*names, "portfolio_strategy"]
    )


def cumulated(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long ``curve, day, v`` to one running-sum column per curve."""
    line = Window.partitionBy("curve").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = series.withColumn("_sum", F.when(F.col("v").isNotNull(), F.sum("v").over(line)))
    return wide(sums, ["day"], names, "_sum", "curve")
