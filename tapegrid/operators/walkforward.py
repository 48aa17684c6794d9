"""Out-of-sample predictions: fit every window, read its scale, score the test months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.config import QUANTILES, RIDGE_ALPHAS, Study
from tapegrid.operators.blocks import join_ranks, order_counts, quantiles_of
from tapegrid.operators.fitting import (
    FAMILIES,
    MODEL_KEYS,
    Family,
    pooled_spreads,
    predict_scores,
    ridge_models,
    standard_scores,
    training_means,
    window_moments,
    window_products,
    with_unit_spread,
)
from tapegrid.operators.folds import Fold, horizon_rows, monthly_folds, test_rows, window_rows
from tapegrid.session import settle

OUTPUT = ["pred", "y", "fwd_logret", "test_month", *QUANTILES, "valid_ic", "setting"]


def prediction_scale(scored: DataFrame) -> DataFrame:
    """Per window: five quantiles of ``pred`` and the rank correlation ``valid_ic``.

    ``scored`` has the validation-month rows with the refit model's ``pred`` and, on the rows whose
    label is known, the inner model's ``inner_pred`` and the forward return. One sort serves all
    three columns.
    """
    valid = F.col("inner_pred").isNotNull() & F.col("fwd_logret").isNotNull()
    rows = settle(
        scored.select(
            *MODEL_KEYS,
            "pred",
            F.when(valid, F.col("inner_pred")).alias("_a"),
            F.when(valid, F.col("fwd_logret")).alias("_b"),
        )
    )
    sides = F.array(
        *[
            F.struct(F.lit(i).alias("side"), F.col(c).alias("value"))
            for i, c in enumerate(("_a", "_b", "pred"))
        ]
    )
    stacked = rows.select(*MODEL_KEYS, F.explode(sides).alias("_s")).select(
        *MODEL_KEYS, F.col("_s.side").alias("_side"), F.col("_s.value").alias("_value")
    )
    ordered = order_counts(stacked, [*MODEL_KEYS, "_side"], "_value")
    scale = quantiles_of(
        ordered.where(F.col("_side") == 2), MODEL_KEYS, "_value", QUANTILES
    )
    known = rows.where(F.col("_a").isNotNull())
    skill = (
        join_ranks(known, ordered, MODEL_KEYS, {"_a": "_za", "_b": "_zb"})
        .groupBy(*MODEL_KEYS)
        .agg(F.avg(F.col("_za") * F.col("_zb")).alias("valid_ic"))
    )
    return scale.join(skill, MODEL_KEYS, "left")


def fit_windows(
    rows: DataFrame, folds: Sequence[Fold], family: Family, inputs: Sequence[str], study: Study
) -> tuple[DataFrame, DataFrame]:
    """Refit parameters, and per window the prediction quantiles, validation IC and setting.

    The quantiles come from the refit model on rows that need no label; the validation IC ranks
    the inner model's predictions against the forward return.
    """
    params = settle(family.fit(rows, folds, inputs, study))
    setting = params.where(F.col("role") == "refit").select(*MODEL_KEYS, "setting")
    models = params.drop("setting")
    inner = models.where(F.col("role") == "inner").drop("role")
    refit = models.where(F.col("role") == "refit").drop("role")
    predicted = family.predict(inputs)
    flagged = window_rows(rows, folds, inputs, study).where(F.col("threshold"))
    keep = [*MODEL_KEYS, "valid", "fwd_logret", *inputs]
    scored = (
        flagged.join(inner, MODEL_KEYS)
        .select(*keep, F.when(F.col("valid"), predicted).alias("inner_pred"))
        .join(refit, MODEL_KEYS)
        .select(*MODEL_KEYS, predicted.alias("pred"), "inner_pred", "fwd_logret")
    )
    levels = prediction_scale(scored).join(setting, MODEL_KEYS, "left")
    return refit, settle(levels)


def out_of_sample(
    frame: DataFrame,
    study: Study,
    family: str,
    inputs: Sequence[str],
    policy: str,
    months: Sequence[str],
    end: str,
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """Predictions of the test months for every coin and horizon in one plan."""
    horizons = tuple(horizons or study.horizons)
    study = study.with_changes(horizons=horizons)
    rows = horizon_rows(frame, inputs, horizons)
    folds = monthly_folds(months, study, policy)
    chosen = FAMILIES[family]
    params, levels = fit_windows(rows, folds, chosen, inputs, study)
    tested = test_rows(rows, folds, inputs, study, end)
    return (
        tested.join(params, MODEL_KEYS)
        .withColumn("pred", chosen.predict(inputs))
        .select("coin", "horizon", "window", "pos", "open_time", "pred", "y", "fwd_logret", "test_month")
        .join(levels, MODEL_KEYS)
        .select("coin", "horizon", "pos", "open_time", *OUTPUT)
    )


def volatility_out_of_sample(
    frame: DataFrame,
    study: Study,
    model: str,
    inputs: Sequence[str],
    mean_inputs: Sequence[str],
    months: Sequence[str],
    end: str,
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """Predictions of log volatility with the mean training label as benchmark column."""
    horizons = tuple(horizons or study.horizons)
    predictions = out_of_sample(frame, study, model, inputs, "expanding", months, end, horizons)
    return predictions.join(
        month_means(frame, study, mean_inputs, months, horizons),
        ["coin", "horizon", "test_month"],
        "left",
    )


def month_means(
    frame: DataFrame, study: Study, inputs: Sequence[str], months: Sequence[str], horizons: Sequence[int]
) -> DataFrame:
    """Mean training label per coin, horizon and test month."""
    folds = monthly_folds(months, study)
    rows = horizon_rows(frame, inputs, horizons)
    means = training_means(rows, folds, inputs, study)
    months_of = F.create_map(*[F.lit(x) for f in folds for x in (f.window, f.test_month)])
    return settle(
        means.select(
            "coin", "horizon", months_of[F.col("window")].alias("test_month"), "train_mean"
        )
    )


def pooled_out_of_sample(
    frame: DataFrame,
    study: Study,
    inputs: Sequence[str],
    months: Sequence[str],
    end: str,
    horizons: Sequence[int] | None = None,
) -> DataFrame:
    """One ridge per horizon and window over all coins, each coin on its own scale."""
    horizons = tuple(horizons or study.horizons)
    study = study.with_changes(horizons=horizons)
    rows = horizon_rows(frame, inputs, horizons)
    folds = monthly_folds(months, study)
    raw = settle(window_moments(rows, folds, inputs, study))
    moments = with_unit_spread(raw).drop("rows")
    pool_keys = ["horizon", "window"]
    pooled = settle(pooled_spreads(raw, len(inputs)))
    across = pooled.select(*pool_keys, "role", F.col("spreads").alias("_across"))
    both = F.zip_with("spreads", "_across", lambda own, across: own * across)
    scales = moments.join(across, [*pool_keys, "role"]).withColumn("spreads", both).drop("_across")
    products = window_products(rows, folds, inputs, study, settle(scales), pool_keys)
    models = settle(ridge_models(products, pool_keys, RIDGE_ALPHAS).join(pooled, [*pool_keys, "role"]))
    own = moments.where(F.col("role") == "refit").drop("role")
    final = models.where(F.col("role") == "refit").drop("role", "setting")
    first = models.where(F.col("role") == "inner").drop("role", "setting")
    setting = models.where(F.col("role") == "refit").select(*pool_keys, "setting")
    predicted = predict_scores(F.col("x"))
    # validation rows on the training scale for the inner model, on the refit scale for the final one
    own_first = moments.where(F.col("role") == "inner").drop("role")
    own_inputs = standard_scores(F.array(*inputs)).alias("x")
    flags = [*MODEL_KEYS, "valid", "fwd_logret"]
    threshold = window_rows(rows, folds, inputs, study).where(F.col("threshold"))
    inner = (
        threshold.join(own_first, MODEL_KEYS)
        .select(*flags, *inputs, own_inputs)
        .join(first, pool_keys)
        .select(*flags, *inputs, F.when(F.col("valid"), predicted).alias("inner_pred"))
    )
    scored = (
        inner.join(own, MODEL_KEYS)
        .select(*MODEL_KEYS, "fwd_logret", "inner_pred", own_inputs)
        .join(final, pool_keys)
        .select(*MODEL_KEYS, predicted.alias("pred"), "inner_pred", "fwd_logret")
    )
    levels = settle(prediction_scale(scored).join(setting, pool_keys, "left"))
    keep = [*MODEL_KEYS, "pos", "open_time", "y", "fwd_logret", "test_month"]
    return (
        test_rows(rows, folds, inputs, study, end)
        .join(own, MODEL_KEYS)
        .select(*keep, own_inputs)
        .join(final, pool_keys)
        .select(*keep, predicted.alias("pred"))
        .join(levels, MODEL_KEYS)
        .select("coin", "horizon", "pos", "open_time", *OUTPUT)
    )
