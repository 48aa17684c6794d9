import numpy as np
import pandas as pd
import pytest
from helpers import gridded, make_bars
from pyspark.sql import functions as F

from tapegrid import schema
from tapegrid.config import EPS, Study
from tapegrid.operators import features as feat
from tapegrid.operators import grid

BARS = 900


@pytest.fixture(scope="module")
def market(spark, study):
    raw = make_bars(study.assets, BARS, seed=11)
    aligned = grid.align_on_grid(spark.createDataFrame(raw), study).cache()
    built = feat.build_features(aligned, study).cache()
    return gridded(raw, BARS), aligned, built


def one(built, coin):
    return built.where(F.col("coin") == coin).orderBy("pos").toPandas()


def test_default_feature_lists():
    s = Study()
    assert len(schema.feature_names(s)) == len(set(schema.feature_names(s))) == 111
    assert len(schema.model_inputs(s)) == 75
    assert len(schema.own_inputs(s)) == 16
    assert set(schema.model_inputs(s)) <= set(schema.feature_names(s))
    groups = schema.importance_groups(s)
    assert sum(len(v) for v in groups.values()) == 75
    assert schema.model_inputs(s)[:2] == ["x_logret_1", "x_trail_ret_4"]


def loop(values, size, fn):
    out = np.full(len(values), np.nan)
    for i in range(size - 1, len(values)):
        window = values[i - size + 1 : i + 1]
        if not np.isnan(window).any():
            out[i] = fn(window)
    return out


def test_features_match_plain_loops(market, study):
    tables, _, built = market
    x = tables["aa"]
    mine = one(built, "aa")
    close = x["close"].to_numpy()
    logret = np.log(close / (np.r_[np.nan, close[:-1]] + EPS))
    check = {
        "x_logret_1": logret,
        "x_trail_ret_5": np.log(close / (np.r_[[np.nan] * 5, close[:-5]] + EPS)),
        "x_roll_mean_logret_7": loop(logret, 7, np.mean),
        "x_roll_vol_logret_24": loop(logret, 24, np.std),
        "x_candle_range_pct": (x["high"] - x["low"]) / (close + EPS),
        "x_upper_wick_pct": (x["high"] - np.maximum(x["open"], close)) / (close + EPS),
        "x_lower_wick_pct": (np.minimum(x["open"], close) - x["low"]) / (close + EPS),
        "x_volume_log": np.log1p(x["volume"]),
        "x_volume_z_24": (x["volume"] - loop(x["volume"].to_numpy(), 24, np.mean))
        / (loop(x["volume"].to_numpy(), 24, np.std) + EPS),
        "x_taker_buy_ratio_vol_ma6": loop(
            (x["taker_buy_volume"] / (x["volume"] + EPS)).to_numpy(), 6, np.mean
        ),
    }
    c = tables["cc"]["close"].to_numpy()
    market_ret = np.log(c / (np.r_[np.nan, c[:-1]] + EPS))
    pair = np.column_stack([logret, market_ret])

    def windows(size, fn):
        out = np.full(len(pair), np.nan)
        for i in range(size - 1, len(pair)):
            w = pair[i - size + 1 : i + 1]
            if not np.isnan(w).any():
                out[i] = fn(w[:, 0], w[:, 1])
        return out

    cov = lambda a, b: np.mean(a * b) - a.mean() * b.mean()
    check["corr_x_cc_logret_12"] = windows(12, lambda a, b: cov(a, b) / (a.std() * b.std() + EPS))
    check["beta_x_cc_20"] = windows(20, lambda a, b: cov(a, b) / (b.var() + EPS))
    check["x_minus_cc_trail_ret_5"] = check["x_trail_ret_5"] - np.log(
        c / (np.r_[[np.nan] * 5, c[:-5]] + EPS)
    )
    forward = np.log(np.r_[close[5:], [np.nan] * 5] / (close + EPS))
    sigma = check["x_roll_vol_logret_24"] * np.sqrt(5)
    check |= {"fwd_logret_5": forward, "sigma_5": sigma, "y_5": np.tanh(forward / (sigma + EPS))}
    for name, expected in check.items():
        np.testing.assert_allclose(
            mine[name].astype(float), np.asarray(expected, dtype=float), rtol=1e-7, atol=1e-10, err_msg=name
        )


def test_one_missing_bar_voids_exactly_its_windows(spark, study):
    raw = make_bars(study.assets, 400, gaps=0, halts=0)
    full = feat.build_features(grid.align_on_grid(spark.createDataFrame(raw), study), study)
    hole = raw[~((raw["asset"] == "aa") & (raw["pos"] == raw["pos"].min() + 200))]
    holed = feat.build_features(grid.align_on_grid(spark.createDataFrame(hole), study), study)

    def known(df):
        names = schema.feature_names(study)
        return df.where("coin = 'aa'").agg(*[F.count(n).alias(n) for n in names]).first().asDict()

    a, b = known(full), known(holed)
    lost = {n: a[n] - b[n] for n in a}
    assert lost["x_logret_1"] == 2
    assert lost["x_trail_ret_5"] == 2
    assert lost["x_roll_mean_logret_7"] == 8
    assert lost["x_roll_vol_logret_24"] == 25
    assert lost["x_volume_z_24"] == 24
    assert lost["x_taker_buy_ratio_vol_ma6"] == 6
    assert lost["corr_x_cc_logret_12"] == 13
    assert lost["beta_x_cc_20"] == 21
    assert lost["cc_logret_1"] == 0


def test_later_bars_change_no_earlier_feature(market, study):
    _, aligned, built = market
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rewritten = aligned.withColumn(
        "close", F.when(F.col("open_time") >= cut, F.col("close") * 9).otherwise(F.col("close"))
    )
    after = feat.build_features(rewritten, study)
    names = schema.feature_names(study)
    assert feat.look_ahead_violations(built, after, cut, names).isEmpty()
    later = F.lit("2024-01-21 00:00:00").cast("timestamp")
    assert not feat.look_ahead_violations(built, after, later, names).isEmpty()


def test_the_target_takes_the_role_x_for_every_coin(market, study):
    tables, _, built = market
    for coin in study.targets:
        np.testing.assert_allclose(
            one(built, coin)["x_close"].astype(float), tables[coin]["close"].to_numpy()
        )


def test_volatility_labels(market, study):
    tables, _, built = market
    frame = feat.volatility_frame(built, study, study.horizons)
    mine = one(frame, "bb")
    close = tables["bb"]["close"]
    squares = np.log(close).diff() ** 2
    for n in study.har_windows:
        expected = 0.5 * np.log(squares.rolling(n).sum())
        np.testing.assert_allclose(mine[f"log_rv_{n}"].astype(float), expected, rtol=1e-7, atol=1e-9)
    inputs = [*schema.model_inputs(study), *schema.har_inputs(study)]
    label = (0.5 * np.log(squares.rolling(5).sum())).shift(-5).to_numpy()
    label = np.where(mine[inputs].notna().all(axis=1), label, np.nan)
    np.testing.assert_allclose(mine["y_5"].astype(float), label, rtol=1e-7, atol=1e-9)
    assert mine["hour"].tolist() == [int(t.hour) for t in mine["open_time"]]


def test_a_window_without_a_move_has_no_volatility(spark, study):
    raw = make_bars(study.assets, 120, gaps=0, halts=0)
    raw["close"] = raw["close"].where(raw["pos"] % 120 < 60, 77.0)
    built = feat.build_features(grid.align_on_grid(spark.createDataFrame(raw), study), study)
    mine = one(feat.volatility_frame(built, study, study.horizons), "aa")
    flat = raw[raw["asset"] == "aa"].set_index("pos")["close"].diff().abs().rolling(3).sum().eq(0)
    assert pd.isna(mine["log_rv_3"]).to_numpy()[3:].tolist() == flat.to_numpy()[3:].tolist()
    assert flat.sum() > 20
