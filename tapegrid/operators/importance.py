"""Permutation importance of input groups on the test months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.config import QUANTILES, Study
from tapegrid.operators.blocks import order_counts
from tapegrid.operators.fitting import FAMILIES, MODEL_KEYS
from tapegrid.operators.folds import horizon_rows, monthly_folds, test_rows
from tapegrid.operators.scoring import daily_ic
from tapegrid.operators.walkforward import fit_windows
from tapegrid.session import settle

FOLD_KEYS = ["coin", "horizon", "test_month"]


def shuffled_inputs(
    tested: DataFrame, groups: Mapping[str, Sequence[str]], inputs: Sequence[str], seed: int
) -> DataFrame:
    """Test rows once per group, with that group's columns taken jointly from another row.

    The donor of the k-th row in time is the k-th row in digest order. Both orders come from range
    partitioned ranks, so a large month is never sorted in one task.
    """
    listed = F.array(*[F.lit(g) for g in groups])
    rows = tested.withColumn("group", F.explode(listed)).withColumn(
        "_digest", F.md5(F.concat_ws("|", F.lit(str(seed)), "group", F.col("pos").cast("string")))
    )
    keys = [*FOLD_KEYS, "group"]
    by_time = order_counts(rows, keys, "pos").select(*keys, "pos", F.col("below").alias("_k"))
    by_digest = order_counts(rows, keys, "_digest").select(
        *keys, "_digest", F.col("below").alias("_k")
    )
    donors = (
        rows.select(*keys, "_digest", *[F.col(n).alias(f"_d_{n}") for n in inputs])
        .join(by_digest, [*keys, "_digest"])
        .drop("_digest")
    )
    paired = rows.drop("_digest").join(by_time, [*keys, "pos"]).join(donors, [*keys, "_k"])
    kept = [c for c in tested.columns if c not in inputs]
    swapped = []
    for n in inputs:
        owners = [g for g, columns in groups.items() if n in columns]
        value = F.col(n)
        if owners:
            value = F.when(F.col("group").isin(owners), F.col(f"_d_{n}")).otherwise(value)
        swapped.append(value.alias(n))
    return paired.select(*kept, "group", *swapped)


def permutation_importance(
    frame: DataFrame,
    study: Study,
    family: str,
    inputs: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    months: Sequence[str],
    end: str,
    horizons: Sequence[int],
) -> DataFrame:
    """Drop in mean daily IC per coin, horizon and group when the group is shuffled."""
    study = study.with_changes(horizons=tuple(horizons))
    rows = horizon_rows(frame, inputs, horizons)
    folds = monthly_folds(months, study)
    chosen = FAMILIES[family]
    params, levels = fit_windows(rows, folds, chosen, inputs, study)
    tested = settle(test_rows(rows, folds, inputs, study, end))
    plain = tested.withColumn("group", F.lit(""))
    shuffled = shuffled_inputs(tested, groups, inputs, study.seed)
    both = plain.unionByName(shuffled.select(*plain.columns))
    scored = (
        both.join(params, MODEL_KEYS)
        .withColumn("pred", chosen.predict(inputs))
        .select(*MODEL_KEYS, "group", "open_time", "pred", "fwd_logret")
        .join(levels.select(*MODEL_KEYS, *QUANTILES), MODEL_KEYS)
    )
    keys = ["coin", "horizon", "group"]
    means = daily_ic(settle(scored), keys).groupBy(*keys).agg(F.avg("ic").alias("ic"))
    base = means.where(F.col("group") == "").select("coin", "horizon", F.col("ic").alias("_base"))
    return (
        means.where(F.col("group") != "")
        .join(base, ["coin", "horizon"])
        .select("coin", "horizon", "group", (F.col("_base") - F.col("ic")).alias("ic_drop"))
    )
