"""Comparison tables and the choices read off them. Ties keep the row listed first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.config import (
    FAMILIES,
    ONE_INPUT_FAMILIES,
    PAIRED_T,
    PER_COIN_T,
    POLICIES,
    POOLED_T,
    TOP_DECILE_EDGE,
    Study,
)
from tapegrid.functions.columns import moment, ratio
from tapegrid.operators.positions import breakeven_bps
from tapegrid.operators.returns import wide
from tapegrid.operators.scoring import (
    equal_weight,
    ic_summary,
    paired_ic_difference,
    pooled_ic_difference,

)


def place_in(column: str, listed: Sequence) -> Column:
    """1-based place of a value in the caller's list."""
    return F.array_position(F.array(*[F.lit(v) for v in listed]), F.col(column))


def settled_merit(value: Column) -> Column:
    """A score without the last digits, so that summation order does not decide a tie."""
    return F.round(value, 9)


def at_least(value: Column, limit: float) -> Column:
    """Threshold test in which an undefined value fails."""
    return F.coalesce(value >= limit, F.lit(False))


def configuration_table(scores: DataFrame) -> DataFrame:
    return scores.withColumn("detected", at_least(F.col("t"), PER_COIN_T))


def pooled_table(configurations: DataFrame, pooled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled skill with the breakeven fee over all coins and the detection flag."""
    edge = configurations.groupBy(*keys).agg(breakeven_bps().alias("breakeven_bps"))
    return pooled.join(edge, list(keys), "left").withColumn(
        "detected", at_least(F.col("t"), POOLED_T)
    )


def choose_recipe(pooled: DataFrame, study: Study) -> DataFrame:
    """Best breakeven among the detected recipes, else the best t."""
    merit = F.when(F.col("detected"), F.col("breakeven_bps")).otherwise(F.col("t"))
    return (
        pooled.withColumn("_merit", settled_merit(merit))
        .where(F.col("_merit").isNotNull())
        .orderBy(
            F.desc("detected"),
            F.desc("_merit"),
            place_in("horizon", study.horizons),
            place_in("family", FAMILIES),
        )
        .limit(1)
        .drop("_merit")
    )


def best_per_coin(configurations: DataFrame, study: Study) -> DataFrame:
    """Configuration with the highest t of each coin."""
    order = F.struct(
        settled_merit(F.col("t")),
        -place_in("horizon", study.horizons),
        -place_in("family", FAMILIES),
    )
    best = F.max_by(F.struct("horizon", "family", "t"), F.when(F.col("t").isNotNull(), order))
    return configurations.groupBy("coin").agg(best.alias("_b")).select("coin", "_b.*")


def needed_ic(sigma: Column, fee_bps: float) -> Column:
    """Rank correlation at which the top decile pays both ways of a trade."""
    return ratio(F.lit(2 * fee_bps), sigma * (TOP_DECILE_EDGE * 1e4))


def needed_ic_table(sigma: DataFrame, research_ic: DataFrame, study: Study) -> DataFrame:
    fees = {f"needed_ic_{n}": needed_ic(F.col("sigma"), b) for n, b in study.fees_bps}
    return (
        sigma.withColumns(fees)
        .join(research_ic, ["coin", "horizon"], "left")
        .select("coin", "horizon", (F.col("sigma") * 1e4).alias("sigma_bps"), *fees, "research_ic")
    )


def detectability_table(pooled: DataFrame, sigma: DataFrame, study: Study) -> DataFrame:
    """Smallest detectable pooled IC, the best found, and the IC each coin would need."""
    days = F.datediff(moment(study.research_end), moment(f"{study.research_months[0]}-01"))
    noise = F.sqrt(F.col("horizon") / F.lit(study.bars_per_day))
    best = pooled.groupBy("horizon").agg(F.max("ic").alias("best_pooled_ic"))
    fee = dict(study.fees_bps)["taker"]
    needed = wide(
        sigma.withColumn("_need", needed_ic(F.col("sigma"), fee)),
        ["horizon"],
        study.targets,
        "_need",
        "coin",
    )
    for c in study.targets:
        needed = needed.withColumnRenamed(c, f"needed_ic_{c}")
    return best.withColumn("detectable_ic", POOLED_T * noise / F.sqrt(days)).join(
        needed, "horizon", "left"
    )


def settings_table(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First setting of each month."""
    return frame.groupBy(*keys, F.col("test_month").alias("month")).agg(
        F.min_by("setting", "pos").alias("setting")
    )


def shared_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames cut to the rows the other one scored too."""
    on = [*keys, "pos"]
    return a.join(b.select(*on), on, "left_semi"), b.join(a.select(*on), on, "left_semi")


def fitted_family(family: Column) -> Column:
    """Family used to compare input sets: a one-input rule cannot show them."""
    return F.when(family.isin(list(ONE_INPUT_FAMILIES)), "ridge").otherwise(family)


def sources_table(
    daily_all: DataFrame, daily_own: DataFrame, benchmark: DataFrame, study: Study
) -> DataFrame:
    """All inputs against own inputs per coin."""
    gain = paired_ic_difference(daily_all, daily_own, ["coin"], study)
    return (
        daily_all.groupBy("coin")
        .agg(F.avg("ic").alias("ic_all"))
        .join(daily_own.groupBy("coin").agg(F.avg("ic").alias("ic_own")), "coin")
        .join(
            gain.select("coin", F.col("ic").alias("gain"), F.col("t").alias("gain_t")), "coin", "left"
        )
        .join(benchmark, "coin", "left")
    )


def choose_inputs(own_minus_all: DataFrame) -> DataFrame:
    """Own inputs replace all inputs only with a clear pooled gain."""
    choice = F.when(at_least(F.col("t"), PAIRED_T), "own").otherwise("all")
    return own_minus_all.select(
        choice.alias("inputs"), F.col("ic").alias("own_minus_all"), F.col("t")
    )


def retraining_by_month(by_month: DataFrame, study: Study) -> DataFrame:
    return by_month.withColumn(
        "research_month", place_in("month", study.research_months).cast("int")
    )


def choose_policy(challengers: DataFrame) -> DataFrame:
    """Highest t among the challengers that reach the bar, else the expanding window.

    ``challengers`` has ``policy`` and ``t``; always returns one row.
    """
    passed = at_least(F.col("t"), PAIRED_T)
    order = F.struct(settled_merit(F.col("t")), -place_in("policy", POLICIES))
    best = F.max_by("policy", F.when(passed, order))
    return challengers.agg(F.coalesce(best, F.lit("expanding")).alias("policy"))


def choose_rule(portfolio: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Rule with the best taker Sharpe ratio without delay."""
    rows = portfolio.where((F.col("fee") == "taker") & (F.col("delay") == 0))
    order = F.struct(settled_merit(F.col("sharpe")), -place_in("rule", rules))
    return rows.agg(F.max_by("rule", F.when(F.col("sharpe").isNotNull(), order)).alias("rule"))


def is_consistent() -> Column:
    """Same sign in both periods and a difference inside the 95 percent band."""
    band = 1.96 * F.hypot("research_se", "forward_se")
    gap = F.abs(F.col("forward_ic") - F.col("research_ic"))
    same = F.signum("research_ic") == F.signum("forward_ic")
    return F.coalesce(same & (gap < band), F.lit(False))


def forward_table(research: DataFrame, forward: DataFrame, study: Study) -> DataFrame:
    """Research against forward skill per coin and pooled."""

    def summaries(daily: DataFrame) -> DataFrame:
        pooled = equal_weight(daily, [], ["ic"]).withColumn("coin", F.lit("pooled"))
        return ic_summary(daily.select("coin", "day", "ic").unionByName(pooled), ["coin"], study)

    past = summaries(research).select(
        "coin", F.col("ic").alias("research_ic"), F.col("se").alias("research_se")
    )
    later = summaries(forward).select(
        "coin",
        F.col("ic").alias("forward_ic"),
        F.col("se").alias("forward_se"),
        F.col("t").alias("forward_t"),
    )
    return past.join(later, "coin", "left").withColumn("consistent", is_consistent())


def shrinkage_table(best: DataFrame, daily: DataFrame) -> DataFrame:
    """IC of each coin's best research configuration in both periods."""
    means = daily.groupBy("coin", "horizon", "family", "period").agg(F.avg("ic").alias("ic"))
    return (
        best.select("coin", "horizon", "family")
        .join(means, ["coin", "horizon", "family"], "left")
        .groupBy("coin", "horizon", "family")
        .agg(
            *[
                F.max(F.when(F.col("period") == p, F.col("ic"))).alias(f"{p}_ic")
                for p in ("research", "forward")
            ]
        )
    )


def gain_table(
    challenger: DataFrame, default: DataFrame, sigma: DataFrame, keys: Sequence[str], study: Study
) -> DataFrame:
    """Paired gain of one model over another per coin, and pooled over coins."""
    keys = list(keys)
    own = paired_ic_difference(challenger, default, [*keys, "coin"], study)
    pooled = pooled_ic_difference(challenger, default, keys, study).withColumn(
        "coin", F.lit("pooled")
    )
    bps = sigma.select("coin", "horizon", (F.col("sigma") * 1e4).alias("sigma_bps"))
    return (
        own.unionByName(pooled)
        .join(bps, ["coin", "horizon"], "left")
        .select(*keys, "coin", F.col("ic").alias("gain"), "se", "t", "sigma_bps")
    )


def choose_models(gains: DataFrame, challenger: str, default: str) -> DataFrame:
    """Challenger per horizon if its pooled research gain is clear."""
    rows = gains.where((F.col("coin") == "pooled") & (F.col("period") == "research"))
    model = F.when(at_least(F.col("t"), PAIRED_T), challenger).otherwise(default)
    return rows.select("horizon", model.alias("model"), "gain", "t")


def choose_version(portfolio: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Version with the best research Sharpe ratio at taker fees."""
    rows = portfolio.where((F.col("period") == "research") & (F.col("fee") == "taker"))
    order = F.struct(settled_merit(F.col("sharpe")), -place_in("version", versions))
    return rows.agg(
        F.max_by("version", F.when(F.col("sharpe").isNotNull(), order)).alias("version")
    )


def comparison_table(
    pooled_model: DataFrame, per_coin: DataFrame, sigma: DataFrame, keys: Sequence[str], study: Study
) -> DataFrame:
    """One model for all coins against one model each, per coin and overall."""
    keys = list(keys)

    def means(daily: DataFrame, name: str) -> DataFrame:
        overall = equal_weight(daily, keys, ["ic"]).withColumn("coin", F.lit("pooled"))
        rows = daily.select(*keys, "coin", "day", "ic").unionByName(overall)
        return rows.groupBy(*keys, "coin").agg(F.avg("ic").alias(name))

    gains = gain_table(pooled_model, per_coin, sigma, keys, study)
    return (
        means(pooled_model, "pooled_model_ic")
        .join(means(per_coin, "per_coin_ic"), [*keys, "coin"])
        .join(gains.withColumnRenamed("gain", "diff"), [*keys, "coin"], "left")
    )


def choose_pooling(comparison: DataFrame) -> DataFrame:
    rows = comparison.where((F.col("coin") == "pooled") & (F.col("period") == "research"))
    model = F.when(at_least(F.col("t"), PAIRED_T), "pooled").otherwise("per_coin")
    return rows.select(
        "horizon", F.col("diff").alias("pooled_minus_per_coin"), "t", model.alias("model")
    )


def chosen_configuration(
    recipe: DataFrame, inputs: DataFrame, policy: DataFrame, rule: DataFrame
) -> DataFrame:
    """The one-row choices of the earlier steps side by side."""
    row = recipe.select("horizon", "family", F.lit(1).alias("_one"))
    for part, column in ((inputs, "inputs"), (policy, "policy"), (rule, "rule")):
        row = row.join(part.select(column, F.lit(1).alias("_one")), "_one", "full")
    return row.drop("_one")


def differences_from_frozen(chosen: DataFrame, frozen: dict) -> DataFrame:
    """Rows of the choice that differ from the frozen record; empty when they agree."""
    record = chosen.sparkSession.createDataFrame(
        [tuple(frozen[c] for c in chosen.columns)], chosen.schema
    )
    return chosen.exceptAll(record).unionByName(record.exceptAll(chosen))


def require_frozen(chosen: DataFrame, frozen: dict) -> None:
    if not differences_from_frozen(chosen, frozen).isEmpty():
        raise ValueError(f"the frozen record {frozen} differs from the choices {chosen.collect()}")


