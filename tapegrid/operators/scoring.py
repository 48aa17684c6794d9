"""Rank skill of predictions.

Prediction frames carry their configuration as key columns, so one plan scores all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import month_of, ratio
from tapegrid.operators.blocks import (
    average_rank,
    order_counts,
    quantiles,
    rank_columns,
    spearman,
)
from tapegrid.operators.bootstrap import mean_summary
from tapegrid.operators.returns import correlation_matrix, day_of, wide


def centred_signal(column: str = "pred") -> Column:
    """A value on the scale of its validation month; null where that month has no spread."""
    scale = F.col("q90") - F.col("q10")
    return F.when(scale > 0, (F.col(column) - F.col("q50")) / scale)


def with_rank_products(
    df: DataFrame, keys: Sequence[str], pred: str, realised: str, name: str = "product"
) -> DataFrame:
    """Product of the whole-period standardised ranks, null where either side is missing."""
    complete = F.col(pred).isNotNull() & F.col(realised).isNotNull()
    rows = df.withColumns(
        {"_a": F.when(complete, F.col(pred)), "_b": F.when(complete, F.col(realised))}
    )
    rows = rank_columns(rows, keys, {"_a": "_za", "_b": "_zb"})
    return rows.withColumn(name, F.col("_za") * F.col("_zb")).drop("_a", "_b", "_za", "_zb")


def rank_products(df: DataFrame, keys: Sequence[str], pred: str, realised: str) -> DataFrame:
    return with_rank_products(df, keys, pred, realised).where(F.col("product").isNotNull())


def daily_rank_ic(df: DataFrame, keys: Sequence[str], pred: str, realised: str) -> DataFrame:
    """Mean rank product per day; a day whose rows have none counts as zero."""
    return (
        with_rank_products(df, keys, pred, realised)
        .groupBy(*keys, day_of().alias("day"))
        .agg(F.coalesce(F.avg("product"), F.lit(0.0)).alias("ic"))
    )


def daily_ic(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = frame.select(*keys, "open_time", centred_signal().alias("_signal"), "fwd_logret")
    return daily_rank_ic(rows, keys, "_signal", "fwd_logret")


def equal_weight(daily: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean over the coins present on each day."""
    return daily.groupBy(*keys, "day").agg(*[F.avg(v).alias(v) for v in values])


def ic_summary(daily: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    return mean_summary(daily, keys, "ic", study)


def pooled_ic_summary(daily: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    """Summary of the equal-weight mean over coins; ``keys`` leaves the coin out."""
    return mean_summary(equal_weight(daily, keys, ["ic"]), keys, "ic", study)


def paired_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily difference of two series over the days both have."""
    other = b.select(*keys, "day", F.col("ic").alias("_b"))
    return a.join(other, [*keys, "day"]).select(*keys, "day", (F.col("ic") - F.col("_b")).alias("ic"))


def paired_ic_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    return ic_summary(paired_difference(a, b, keys), keys, study)


def pooled_ic_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], study: Study) -> DataFrame:
    """Summary of the coin mean of the per-coin differences."""
    return pooled_ic_summary(paired_difference(a, b, [*keys, "coin"]), keys, study)


def ic_by_month(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    return daily.groupBy(*keys, month_of("day").alias("month")).agg(F.avg("ic").alias("ic"))


def hit_rate(side: Column, realised: Column) -> Column:
    """Share of agreeing rows among those whose product is not zero; an unknown one still counts."""
    product = side * realised
    return ratio(
        F.count_if(product > 0).cast("double"), F.count_if(product.isNull() | (product != 0))
    )


def oos_r2(pred: Column, y: Column) -> Column:
    """One minus squared error over squared outcome: the benchmark predicts zero."""
    return 1 - ratio(F.sum((y - pred) * (y - pred)), F.sum(y * y))


def r2_against_training_mean() -> Column:
    mean = F.col("train_mean")
    return oos_r2(F.col("pred") - mean, F.col("y") - mean)


def within_month_spearman(
    df: DataFrame, keys: Sequence[str], a: str, b: str, month: str, name: str
) -> DataFrame:
    """Mean over months of the rank correlation inside each month."""
    monthly = spearman(df.where(F.col(month).isNotNull()), [*keys, month], a, b, "_rho")
    return monthly.groupBy(*keys).agg(F.avg("_rho").alias(name))


def decile_returns(
    df: DataFrame, keys: Sequence[str], pred: str, realised: str, month: str
) -> DataFrame:
    """Mean outcome per month and prediction decile, deciles formed inside the month."""
    ordered = order_counts(
        df,
        [*keys, month],
        pred,
        {"_sum": F.col(realised), "_known": F.when(F.col(realised).isNotNull(), 1).otherwise(0)},
    )
    decile = F.ceil(10 * (average_rank() / F.col("n"))).cast("int")
    return (
        ordered.groupBy(*keys, month, decile.alias("decile"))
        .agg(ratio(F.sum("_sum"), F.sum("_known")).alias("mean_return"))
    )


def decile_means(deciles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over months in bps."""
    return deciles.groupBy(*keys, "decile").agg((F.avg("mean_return") * 1e4).alias("mean_bps"))


def prediction_correlation(frame: DataFrame, coins: Sequence[str]) -> DataFrame:
    """Coin by coin matrix of within-month rank correlations of the centred signals."""
    rows = frame.select("coin", "pos", "test_month", centred_signal().alias("_s"))
    months = F.max("test_month").alias("month")
    picks = [F.max(F.when(F.col("coin") == c, F.col("_s"))).alias(c) for c in coins]
    table = rows.groupBy("pos").agg(months, *picks)
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
        for a, b in itertools.combinations_with_replacement(coins, 2)
    ]
    long = table.select("month", F.explode(F.array(*pairs)).alias("_p")).select("month", "_p.*")
    half = within_month_spearman(long, ["a", "b"], "va", "vb", "month", "rho")
    mirror = half.where(F.col("a") != F.col("b")).select(
        F.col("b").alias("a"), F.col("a").alias("b"), "rho"
    )
    return wide(half.unionByName(mirror), ["a"], coins, "rho", "b").withColumnRenamed("a", "coin")


def family_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Within-month rank correlation of two families' centred signals per coin and horizon."""
    left = a.select(*keys, "pos", "test_month", centred_signal().alias("_sa"))
    right = b.select(*keys, "pos", centred_signal().alias("_sb"))
    joined = left.join(right, [*keys, "pos"])
    return within_month_spearman(joined, keys, "_sa", "_sb", "test_month", name)


def tercile_table(frame: DataFrame, volatility: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank products by tercile of trailing volatility (``keys, pos, volatility``)."""
    rows = frame.select(*keys, "pos", centred_signal().alias("_signal"), "fwd_logret")
    products = rank_products(rows, keys, "_signal", "fwd_logret").join(volatility, [*keys, "pos"])
    known = products.where(F.col("volatility").isNotNull())
    edges = quantiles(known, keys, "volatility", {"_third": 1 / 3, "_two_thirds": 2 / 3})
    v = F.col("volatility")
    tercile = (
        F.when(v <= F.col("_third"), "low").when(v <= F.col("_two_thirds"), "middle").otherwise("high")
    )
    return (
        known.join(edges, list(keys))
        .groupBy(*keys, tercile.alias("tercile"))
        .agg(F.avg("product").alias("ic"), F.count(F.lit(1)).alias("rows"))
    )


def daily_correlation(daily: DataFrame, coins: Sequence[str], value: str) -> DataFrame:
    """Pairwise-complete correlation of the coins' daily series."""
    return correlation_matrix(wide(daily, ["day"], coins, value, "coin"), coins, "coin")


def coin_pivot(table: DataFrame, column: str, values: Sequence, value: str) -> DataFrame:
    """One row per coin and one column per listed key value."""
    return table.groupBy("coin").pivot(column, list(values)).agg(F.max(value))


def decay_table(by_month: DataFrame, coins: Sequence[str]) -> DataFrame:
    """The never-refit model's IC per coin and the expanding coin mean, by month position."""
    fixed = wide(
        by_month.where(F.col("policy") == "fixed"), ["research_month"], coins, "ic", "coin"
    )
    mean = (
        by_month.where(F.col("policy") == "expanding")
        .groupBy("research_month")
        .agg(F.avg("ic").alias("expanding_mean"))
    )
    return fixed.join(mean, "research_month", "full")
