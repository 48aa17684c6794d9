"""Trailing features and forward labels.

Each asset's features are computed once, in long form, and then meet by time: the listed contexts
fold into one row per bar, and every target joins that row. All windows run in time blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.config import EPS, Study
from tapegrid.functions.columns import all_known, both
from tapegrid.operators.blocks import blocked, in_block, owned
from tapegrid.operators.rolling import PairTrailing, Trailing, add_pair_sums, add_running_sums
from tapegrid.schema import (
    ACTIVITY_FIELDS,
    BAR_FIELDS,
    FLOW_KINDS,
    asset_feature_names,
    excess_pairs,
    feature_names,
    har_inputs,
    label_names,
    model_inputs,
)


def log_return(close: Column, earlier: Column) -> Column:
    return F.ln(close / (earlier + EPS))


def asset_features(grid: DataFrame, study: Study, horizons: Sequence[int] = ()) -> DataFrame:
    """Price, activity and flow features of every asset, and labels for the given horizons."""
    s = study
    long = s.long_window
    reach = max(long + 1, *s.lags, *(n + 1 for n in s.mean_windows), *s.flow_windows) + 1
    rows = blocked(
        grid.select("asset", "pos", "open_time", *BAR_FIELDS),
        "pos",
        before=reach,
        after=max(horizons, default=0),
        block_rows=s.block_rows,
    )
    line = in_block(["asset"], "pos")
    close, high, low, opened = (F.col(c) for c in ("close", "high", "low", "open"))
    first = {"logret_1": log_return(close, F.lag("close", 1).over(line))}
    for n in s.lags:
        first[f"trail_ret_{n}"] = log_return(close, F.lag("close", n).over(line))
    for h in horizons:
        first[f"fwd_logret_{h}"] = log_return(F.lead("close", h).over(line), close)
    for kind, (bought, whole) in FLOW_KINDS.items():
        first[f"taker_buy_ratio_{kind}"] = F.col(bought) / (F.col(whole) + EPS)
    rows = rows.withColumns(first)
    series = {"ret": F.col("logret_1")}
    series |= {k: F.col(f"taker_buy_ratio_{k}") for k in FLOW_KINDS}
    series |= {f: F.col(f) for f in ACTIVITY_FIELDS}
    rows = add_running_sums(rows, line, series)
    base = close + EPS
    upper = both(opened, close, F.greatest(opened, close))
    lower = both(opened, close, F.least(opened, close))
    spread = Trailing("ret", long, line).std
    second = {f"roll_mean_logret_{n}": Trailing("ret", n, line).mean for n in s.mean_windows}
    second[f"roll_vol_logret_{long}"] = spread
    second["candle_range_pct"] = (high - low) / base
    second["candle_body_pct"] = (close - opened) / base
    second["upper_wick_pct"] = (high - upper) / base
    second["lower_wick_pct"] = (lower - low) / base
    for f in ACTIVITY_FIELDS:
        second[f"{f}_log"] = F.log1p(f)
        second[f"{f}_z_{long}"] = Trailing(f, long, line).zscore(F.col(f))
    for n in s.flow_windows:
        for kind in FLOW_KINDS:
            second[f"taker_buy_ratio_{kind}_ma{n}"] = Trailing(kind, n, line).mean
    rows = rows.withColumns(second)
    labels = {}
    for h in horizons:
        sigma = F.col(f"roll_vol_logret_{long}") * float(h) ** 0.5
        labels[f"sigma_{h}"] = sigma
        labels[f"y_{h}"] = F.tanh(F.col(f"fwd_logret_{h}") / (sigma + EPS))
    if labels:
        rows = rows.withColumns(labels)
    kept = [f"{k}_{h}" for h in horizons for k in ("fwd_logret", "sigma", "y")]
    return owned(rows).select("asset", "pos", "open_time", "close", *asset_feature_names(s), *kept)


def context_features(per_asset: DataFrame, study: Study) -> DataFrame:
    """One row per bar with every context's features, prefixed by its name."""
    picks = [
        F.max(F.when(F.col("asset") == c, F.col(n))).alias(f"{c}_{n}")
        for c in study.contexts
        for n in asset_feature_names(study)
    ]
    inside = F.col("asset").isin(list(study.contexts))
    return per_asset.where(inside).groupBy("pos").agg(*picks)


def cross_features(rows: DataFrame, study: Study) -> DataFrame:
    """Excess returns, correlations and betas of the target against each context."""
    s = study
    excess = {
        f"x_minus_{c}_trail_ret_{n}": F.col(f"x_trail_ret_{n}") - F.col(f"{c}_trail_ret_{n}")
        for c, n in excess_pairs(s)
    }
    rows = blocked(
        rows.withColumns(excess),
        "pos",
        before=max(s.corr_window, s.beta_window),
        block_rows=s.block_rows,
    )
    line = in_block(["coin"], "pos")
    own = F.col("x_logret_1")
    rows = add_pair_sums(rows, line, {c: (own, F.col(f"{c}_logret_1")) for c in s.contexts})
    moments = {}
    for c in s.contexts:
        moments[f"corr_x_{c}_logret_{s.corr_window}"] = PairTrailing(c, s.corr_window, line).corr
        moments[f"beta_x_{c}_{s.beta_window}"] = PairTrailing(c, s.beta_window, line).beta
    return owned(rows.withColumns(moments))


def build_features(grid: DataFrame, study: Study) -> DataFrame:
    """``coin, pos, open_time, x_close``, every feature, and the labels of each horizon."""
    s = study
    # One plan for all assets: the asset filter moves below the windows in each of its two uses.
    every = asset_features(grid, s, s.horizons)
    own = every.where(F.col("asset").isin(list(s.targets))).select(
        F.col("asset").alias("coin"),
        "pos",
        "open_time",
        F.col("close").alias("x_close"),
        *[F.col(n).alias(f"x_{n}") for n in asset_feature_names(s)],
        *label_names(s),
    )
    contexts = context_features(every, s)
    rows = cross_features(own.join(contexts, "pos", "left"), s)
    return rows.select("coin", "pos", "open_time", "x_close", *feature_names(s), *label_names(s))


def project_inputs(features: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return features.select("coin", "pos", "open_time", *inputs)


def log_volatility(total: Column) -> Column:
    """Half the log of a sum of squares; null if nothing moved."""
    return F.when(total > 0, 0.5 * F.ln(total))


def volatility_frame(features: DataFrame, study: Study, horizons: Sequence[int]) -> DataFrame:
    """Volatility inputs and forward log volatility per horizon.

    The label exists only where every input of every model does, so models share their rows. It
    is stored twice, as ``y`` and as ``fwd_logret``, because the walk-forward fits one and ranks
    the other.
    """
    s = study
    inputs = [*model_inputs(s), "hour", *har_inputs(s)]
    rows = blocked(
        features.select("coin", "pos", "open_time", "x_close", *model_inputs(s)),
        "pos",
        before=max(s.har_windows) + 1,
        after=max(horizons),
        block_rows=s.block_rows,
    )
    line = in_block(["coin"], "pos")
    step = F.ln("x_close") - F.ln(F.lag("x_close").over(line))
    rows = rows.withColumn("_step", step).withColumn("_step2", F.col("_step") * F.col("_step"))
    rows = add_running_sums(rows, line, {"sq": F.col("_step2")})
    trailing = {f"log_rv_{n}": log_volatility(_square_sum(n, line)) for n in s.har_windows}
    ahead = {f"_rv_{h}": log_volatility(_square_sum(h, line)) for h in horizons}
    rows = rows.withColumns({**trailing, **ahead, "hour": F.hour("open_time")})
    rows = rows.withColumns({f"_label_{h}": F.lead(f"_rv_{h}", h).over(line) for h in horizons})
    known = all_known(inputs)
    labels = {h: F.when(known, F.col(f"_label_{h}")) for h in horizons}
    return owned(rows).select(
        "coin",
        "pos",
        "open_time",
        *inputs,
        *[c for h in horizons for c in (labels[h].alias(f"y_{h}"), labels[h].alias(f"fwd_logret_{h}"))],
    )


def _square_sum(size: int, line) -> Column:
    """Sum of squared steps; exactly zero where the window holds no step but zeros."""
    part = Trailing("sq", size, line)
    flat = (part._difference("d", size - 1) == 0) & (F.col("_v_sq") == 0)
    return F.when(flat, F.lit(0.0)).otherwise(part.total)


def look_ahead_violations(
    before: DataFrame, after: DataFrame, cut: Column, columns: Sequence[str], digits: int = 12
) -> DataFrame:
    """Rows before the cut whose features changed although only later bars were rewritten."""
    names = ["coin", "pos", *[F.round(c, digits).alias(c) for c in columns]]
    early = F.col("open_time") < cut
    return before.where(early).select(*names).exceptAll(after.where(early).select(*names))


__all__ = [
    "asset_features",
    "build_features",
    "context_features",
    "cross_features",
    "log_return",
    "log_volatility",
    "look_ahead_violations",
    "project_inputs",
    "volatility_frame",
]
