"""Return, volatility and correlation statistics.

Pairwise statistics pivot the listed universe to one row per time, so a pair is an aggregate over
two columns and no row is ever joined with every other asset's row.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import (
    bar_position,
    between,
    moment,
    ratio,
    stack_columns,
)
from tapegrid.operators.blocks import (
    blocked,
    in_block,
    order_counts,
    owned,
    quantiles,
    standardised_ranks,
    with_previous,
)
from tapegrid.operators.rolling import PairTrailing, add_pair_sums


def day_of(time: Column | str = "open_time") -> Column:
    return F.to_date(time)


def in_event(study: Study, time: str = "open_time") -> Column:
    return between(time, *study.event_window)


def first_window(df: DataFrame, study: Study) -> DataFrame:
    """Rows of the first training window."""
    end = f"{study.research_months[0]}-01 00:00:00"
    return df.where(between("open_time", study.train_start, end))


def wide(df: DataFrame, by: Sequence[str], names: Sequence[str], value: str, key: str = "asset") -> DataFrame:
    """One column per listed key value."""
    picks = [F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names]
    return df.where(F.col(key).isin(list(names))).groupBy(*by).agg(*picks)


def correlation_matrix(table: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Pairwise-complete Pearson matrix of the listed columns, from one aggregate."""
    pairs = list(itertools.combinations(names, 2))
    row = table.agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[F.var_samp(n).alias(f"{n}|{n}") for n in names],
    )

    def cell(a: str, b: str) -> Column:
        if a == b:
            return F.when(F.col(f"`{a}|{b}`") > 0, F.lit(1.0))
        return F.col(f"`{a}|{b}`") if (a, b) in pairs else F.col(f"`{b}|{a}`")

    lines = [
        F.struct(F.lit(a).alias(label), *[cell(a, b).alias(b) for b in names]) for a in names
    ]
    return row.select(F.inline(F.array(*lines)))


def return_correlation(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    return correlation_matrix(wide(returns, ["pos"], names, "log_return"), names, "asset")


def rolling_benchmark_correlation(returns: DataFrame, study: Study) -> DataFrame:
    """Last value per day of the trailing correlation with the benchmark, one column per target."""
    window = int(study.benchmark_days * study.bars_per_day)
    least = int(study.benchmark_min_days * study.bars_per_day)
    table = wide(returns, ["pos", "open_time"], (*study.targets, study.benchmark), "log_return")
    rows = blocked(table, "pos", before=window, block_rows=study.block_rows)
    line = in_block([], "pos")
    market = F.col(study.benchmark)
    rows = add_pair_sums(rows, line, {t: (F.col(t), market) for t in study.targets})
    rows = owned(
        rows.withColumns(
            {f"corr_{t}": PairTrailing(t, window, line, least).pearson for t in study.targets}
        )
    )
    last = [
        F.max_by(f"corr_{t}", F.when(F.col(f"corr_{t}").isNotNull(), F.col("pos"))).alias(t)
        for t in study.targets
    ]
    daily = rows.groupBy(day_of().alias("day")).agg(*last)
    return daily.dropna(how="all", subset=list(study.targets))


def lead_lag(returns: DataFrame, study: Study) -> DataFrame:
    """Correlation of each target with the benchmark shifted by up to ``lead_lag`` bars.

    Event rows turn null but stay on the grid, so a shift still counts time.
    """
    names = (*study.targets, study.benchmark)
    table = wide(returns, ["pos", "open_time"], names, "log_return")
    calm = table.select("pos", *[F.when(~in_event(study), F.col(n)).alias(n) for n in names])
    reach = study.lead_lag
    shifts = range(-reach, reach + 1)
    line = in_block([], "pos")
    rows = blocked(calm, "pos", before=reach, after=reach, block_rows=study.block_rows)
    market = {f"_m{i}": F.lag(study.benchmark, s).over(line) for i, s in enumerate(shifts)}
    rows = owned(rows.withColumns(market))
    row = rows.agg(
        *[F.corr(t, f"_m{i}").alias(f"{t}|{i}") for t in study.targets for i in range(len(shifts))]
    )
    lines = [
        F.struct(
            F.lit(s).alias("benchmark_lead_bars"),
            *[F.col(f"`{t}|{i}`").alias(t) for t in study.targets],
        )
        for i, s in enumerate(shifts)
    ]
    return row.select(F.inline(F.array(*lines)))


def without_event(df: DataFrame, study: Study) -> DataFrame:
    """Event rows removed and the later positions moved up, so a lag crosses the cut."""
    start, end = (bar_position(moment(t), study.bar_seconds) for t in study.event_window)
    later = F.col("open_time") >= moment(study.event_window[1])
    moved = F.when(later, F.col("pos") - (end - start)).otherwise(F.col("pos"))
    return df.where(~in_event(study)).withColumn("pos", moved)


def autocorrelation(returns: DataFrame, study: Study) -> DataFrame:
    """Lag-one autocorrelation: all rows, without the event, and of ranks without the event."""

    def lagged(df: DataFrame, value: str, name: str) -> DataFrame:
        rows = blocked(df, "pos", before=1, block_rows=study.block_rows)
        rows = rows.withColumn("_lag", F.lag(value).over(in_block(["asset"], "pos")))
        return owned(rows).groupBy("asset").agg(F.corr(value, "_lag").alias(name))

    rows = returns.select("asset", "pos", "open_time", "log_return")
    calm = without_event(rows, study)
    ranked = standardised_ranks(calm, ["asset"], "log_return", "rank")
    return (
        lagged(rows, "log_return", "lag1")
        .join(lagged(calm, "log_return", "lag1_without_event"), "asset", "left")
        .join(lagged(ranked, "rank", "lag1_rank_without_event"), "asset", "left")
    )


def daily_volatility(returns: DataFrame, study: Study) -> DataFrame:
    """Sample spread of a day's returns on the daily scale, one column per target."""
    daily = (
        returns.where(F.col("asset").isin(list(study.targets)))
        .groupBy("asset", day_of().alias("day"))
        .agg((F.stddev_samp("log_return") * study.bars_per_day**0.5).alias("volatility"))
    )
    table = wide(daily, ["day"], study.targets, "volatility")
    return table.dropna(how="all", subset=list(study.targets))


def daily_closes(grid: DataFrame) -> DataFrame:
    """Last known close per asset and day; a day without one stays, with null."""
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("pos")))
    return grid.groupBy("asset", day_of().alias("day")).agg(last.alias("close"))


def daily_returns(grid: DataFrame) -> DataFrame:
    """Close-to-close simple returns; the calendar bounds the rows of a window."""
    line = Window.partitionBy("asset").orderBy("day")
    closes = daily_closes(grid)
    return closes.withColumn("ret", ratio("close", F.lag("close").over(line)) - 1)


def benchmark_correlation(grid: DataFrame, study: Study) -> DataFrame:
    """Correlation of daily returns with the benchmark in the first window."""
    daily = daily_returns(first_window(grid, study)).where(F.col("ret").isNotNull())
    market = daily.where(F.col("asset") == study.benchmark).select("day", F.col("ret").alias("_m"))
    return (
        daily.where(F.col("asset").isin(list(study.targets)))
        .join(market, "day")
        .groupBy(F.col("asset").alias("coin"))
        .agg(F.corr("ret", "_m").alias("benchmark_correlation"))
    )


def realised_sigma(grid: DataFrame, study: Study) -> DataFrame:
    """Sample spread of forward log moves per target and horizon, event labels left out."""
    rows = first_window(grid, study).where(F.col("asset").isin(list(study.targets)))
    rows = blocked(
        rows.select("asset", "pos", "open_time", F.ln("close").alias("_log")),
        "pos",
        after=max(study.horizons),
        block_rows=study.block_rows,
    )
    line = in_block(["asset"], "pos")
    moves = {h: F.lead("_log", h).over(line) - F.col("_log") for h in study.horizons}
    rows = owned(rows.withColumns({f"_f{h}": move for h, move in moves.items()}))
    start, end = (moment(t) for t in study.event_window)
    kept = {}
    for h in study.horizons:
        label_end = F.col("open_time") + F.make_dt_interval(secs=F.lit(h * study.bar_seconds))
        touches = (label_end >= start) & (F.col("open_time") < end)
        kept[h] = F.stddev_samp(F.when(~touches, F.col(f"_f{h}"))).alias(str(h))
    table = rows.groupBy(F.col("asset").alias("coin")).agg(*kept.values())
    stacked = stack_columns(table, ["coin"], [str(h) for h in study.horizons], "horizon", "sigma")
    return stacked.withColumn("horizon", F.col("horizon").cast("int"))


def weekly_volatility(returns: DataFrame, study: Study) -> DataFrame:
    """Spread in bps per seven-day bucket counted from the first grid day."""
    first = F.to_date(moment(study.grid_start))
    week = F.floor(F.datediff(day_of(), first) / 7).cast("int")
    return (
        returns.where(F.col("asset").isin(list(study.targets)))
        .groupBy("asset", F.date_add(first, week * 7).alias("week"))
        .agg((F.stddev_samp("log_return") * 1e4).alias("volatility_bps"))
    )


def hourly_volatility(returns: DataFrame, study: Study) -> DataFrame:
    """Spread in bps by hour of day, event rows left out."""
    return (
        returns.where(F.col("asset").isin(list(study.targets)) & ~in_event(study))
        .groupBy("asset", F.hour("open_time").alias("hour"))
        .agg((F.stddev_samp("log_return") * 1e4).alias("volatility_bps"))
    )


def volatility_summary(weekly: DataFrame, hourly: DataFrame) -> DataFrame:
    """Median and highest week, busiest hour and its ratio to the quietest."""

    def first_max(name: str, tie: str) -> Column:
        order = F.struct(F.col("volatility_bps"), -F.unix_date(tie) if tie == "week" else -F.col(tie))
        return F.max_by(name, F.when(F.col("volatility_bps").isNotNull(), order))

    weeks = weekly.groupBy("asset").agg(
        F.round(F.median("volatility_bps"), 1).alias("median_week_bps"),
        F.round(F.max("volatility_bps"), 1).alias("highest_week_bps"),
        first_max("week", "week").alias("highest_week"),
    )
    hours = hourly.groupBy("asset").agg(
        first_max("hour", "hour").alias("busiest_hour"),
        F.round(ratio(F.max("volatility_bps"), F.min("volatility_bps")), 2).alias("busy_over_quiet"),
    )
    return weeks.join(hours, "asset", "full")


def excess_kurtosis(value: str) -> Column:
    """Bias-corrected sample excess kurtosis; the built-in is the population form."""
    n = F.count(value).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, corrected)


def top_share(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.001) -> DataFrame:
    """Share of the squared values that sits in the largest ``share`` of rows."""
    squares = df.where(F.col(value).isNotNull()).withColumn("_sq", F.col(value) * F.col(value))
    ordered = order_counts(squares, keys, "_sq")
    above = F.col("n") - F.col("below") - F.col("ties")
    taken = F.bround(F.lit(share) * F.col("n"))
    inside = F.greatest(F.least(taken - above, F.col("ties").cast("double")), F.lit(0.0))
    return ordered.groupBy(*keys).agg(
        ratio(F.sum(F.col("_sq") * inside), F.sum(F.col("_sq") * F.col("ties"))).alias("top_share")
    )


def tail_table(returns: DataFrame, study: Study, share: float = 0.001) -> DataFrame:
    """Kurtosis and top share, with and without the event rows."""
    calm = returns.where(~in_event(study))
    parts = []
    for suffix, rows in (("", returns), ("_without_event", calm)):
        parts.append(
            rows.groupBy("asset").agg(excess_kurtosis("log_return").alias(f"kurtosis{suffix}"))
        )
        parts.append(
            top_share(rows, ["asset"], "log_return", share).withColumnRenamed(
                "top_share", f"top_share{suffix}"
            )
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, "asset", "left")
    return table


def funding_summary(funding: DataFrame, study: Study, start: str, end: str, at: str) -> DataFrame:
    """Spacing, base-rate share, sign and range of the settlements in bps."""
    rates = funding.where(between("open_time", start, end)).withColumn("bps", F.col("rate") * 1e4)
    rows = with_previous(rates, ["asset"], "pos", ["pos"], study.block_rows)
    rows = rows.withColumn(
        "hours", (F.col("pos") - F.col("prev_pos")) * (study.bar_seconds / 3600.0)
    )
    spacing = quantiles(rows, ["asset"], "hours", {"spacing_hours": 0.5})
    days = (F.unix_timestamp(moment(end)) - F.unix_timestamp(moment(start))) / 86_400
    n = F.count("bps")
    at_base = F.round("bps", 6) == F.col("spacing_hours") / 8
    return (
        rates.join(spacing, "asset", "left")
        .groupBy("asset", "spacing_hours")
        .agg(
            (F.count_if(at_base) / n * 100).alias("at_base_pct"),
            (F.count_if(F.col("bps") < 0) / n * 100).alias("negative_pct"),
            (F.sum("bps") / days).alias("mean_bps_day"),
            F.min("bps").alias("lowest_bps"),
            F.max("bps").alias("highest_bps"),
            F.max(F.when(F.col("open_time") == moment(at), F.col("bps"))).alias("bps_at"),
        )
    )


def indexed_around(grid: DataFrame, study: Study, start: str, end: str) -> DataFrame:
    """Closes and lows indexed to 100 at the first bar of a window whose last bar is ``end``."""
    first = bar_position(moment(start), study.bar_seconds)
    final = bar_position(moment(end), study.bar_seconds)
    rows = grid.where(F.col("pos").between(first, final))
    base = F.max(F.when(F.col("pos") == first, F.col("close")))
    lowest = F.min_by(
        F.col("open_time"), F.when(F.col("close").isNotNull(), F.struct("close", "pos"))
    )
    scale = ratio(F.lit(100.0), F.col("_base"))
    return (
        rows.groupBy("asset")
        .agg(
            base.alias("_base"),
            F.min("close").alias("_min"),
            lowest.alias("_at"),
            F.min("low").alias("_low"),
            F.max(F.when(F.col("pos") == final, F.col("close"))).alias("_last"),
        )
        .select(
            "asset",
            (F.col("_min") * scale).alias("lowest_close"),
            F.when(F.col("_base").isNotNull(), F.col("_at")).alias("lowest_close_at"),
            (F.col("_low") * scale).alias("lowest_low"),
            (F.col("_last") * scale).alias("last_close"),
        )
    )


def coverage(grid: DataFrame, audit: DataFrame) -> DataFrame:
    """Bars, gaps, zero-trade bars and the median daily traded value."""
    daily = grid.groupBy("asset", day_of().alias("day")).agg(
        F.coalesce(F.sum("quote_volume"), F.lit(0.0)).alias("_value"),
        F.count("close").alias("_bars"),
        F.count_if(F.col("close").isNull()).alias("_gaps"),
    )
    totals = daily.groupBy("asset").agg(
        F.sum("_bars").alias("bars"),
        F.sum("_gaps").alias("missing"),
        F.median("_value").alias("median_daily_value"),
    )
    halts = audit.groupBy("asset").agg(F.sum("zero_trade").alias("zero_trade"))
    return totals.join(halts, "asset", "left")


def event_correlation_change(grid: DataFrame, study: Study, names: Sequence[str]) -> DataFrame:
    """Pairwise correlation of daily returns with and without the event days."""
    daily = wide(daily_returns(grid), ["day"], names, "ret").dropna(subset=list(names))
    calm = ~between(F.col("day").cast("timestamp"), *study.event_window)
    pairs = list(itertools.combinations(names, 2))
    row = daily.agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[
            F.corr(F.when(calm, F.col(a)), F.when(calm, F.col(b))).alias(f"{a}|{b}|calm")
            for a, b in pairs
        ],
    )
    lines = [
        F.struct(
            F.lit(a).alias("asset_a"),
            F.lit(b).alias("asset_b"),
            F.col(f"`{a}|{b}`").alias("all_days"),
            F.col(f"`{a}|{b}|calm`").alias("without_event"),
            (F.col(f"`{a}|{b}`") - F.col(f"`{a}|{b}|calm`")).alias("change"),
        )
        for a, b in pairs
    ]
    return row.select(F.inline(F.array(*lines)))


