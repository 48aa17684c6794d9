"""The experiments: each table is one plan over all configurations, keyed by columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid import schema
from tapegrid.config import DELAYS, POLICIES, RULES, VERSIONS
from tapegrid.functions.columns import between
from tapegrid.operators import decisions, gating, grid, importance, positions, returns, scoring
from tapegrid.plans.lab import Lab

CONFIGURATION = ("coin", "horizon", "family")
RULE_FAMILIES = ("momentum", "best_feature", "ridge")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- audit


def audit_tables(lab: Lab) -> dict[str, DataFrame]:
    """Data-quality and return statistics of the research window."""
    s = lab.study
    raw = lab.raw.where(between("open_time", None, s.research_end))
    seams = grid.find_seams(raw, s)
    grid.require_no_late_seams(seams, s)
    rows = lab.research_returns
    first = returns.first_window(rows, s)
    return {
        "bars": grid.audit_bars(raw, s),
        "seams": seams,
        "extreme_bars": grid.extreme_returns(rows, s),
        "return_correlation": returns.return_correlation(rows, s.assets),
        "rolling_benchmark_correlation": returns.rolling_benchmark_correlation(rows, s),
        "lead_lag": returns.lead_lag(first, s),
        "autocorrelation": returns.autocorrelation(first, s),
        "daily_volatility": returns.daily_volatility(rows, s),
    }


# ---------------------------------------------------------------- horizon sweep


def sweep_frame(lab: Lab, families: Sequence[str] = RULE_FAMILIES, period: str = "research") -> DataFrame:
    return union([lab.predictions(f, period=period) for f in families])


def sweep_daily(lab: Lab, families: Sequence[str] = RULE_FAMILIES, period: str = "research") -> DataFrame:
    return lab.daily_ic(
        ("sweep", tuple(families), period), sweep_frame(lab, families, period), CONFIGURATION
    )


def evaluate(lab: Lab, frame: DataFrame, daily: DataFrame, period: str = "research") -> DataFrame:
    """Skill, hit rate, error and the median-rule flows of every configuration."""
    keys = list(CONFIGURATION)
    rates = frame.groupBy(*keys).agg(
        scoring.hit_rate(positions.rule_signal("median"), F.col("fwd_logret")).alias("hit_rate"),
        scoring.oos_r2(F.col("pred"), F.col("y")).alias("oos_r2"),
    )
    bars = positions.strategy_bars(frame, lab.period_bars(period), keys, lab.study)
    flows = bars.groupBy(*keys).agg(
        F.sum("gross").alias("gross"),
        F.sum("funding").alias("funding"),
        F.sum("turnover").alias("turnover"),
        positions.breakeven_bps().alias("breakeven_bps"),
    )
    skill = scoring.ic_summary(daily, keys, lab.study)
    return decisions.configuration_table(skill.join(rates, keys).join(flows, keys))


def sweep_configurations(lab: Lab, families: Sequence[str] = RULE_FAMILIES) -> DataFrame:
    return lab._once(
        ("configurations", tuple(families)),
        lambda: evaluate(lab, sweep_frame(lab, families), sweep_daily(lab, families)),
    )


def sweep_pooled(lab: Lab, families: Sequence[str] = RULE_FAMILIES) -> DataFrame:
    keys = ["horizon", "family"]
    return lab._once(
        ("sweep_pooled", tuple(families)),
        lambda: decisions.pooled_table(
            sweep_configurations(lab, families),
            scoring.pooled_ic_summary(sweep_daily(lab, families), keys, lab.study),
            keys,
        ),
    )


def sweep_tables(lab: Lab, families: Sequence[str] = RULE_FAMILIES) -> dict[str, DataFrame]:
    frame, daily = sweep_frame(lab, families), sweep_daily(lab, families)
    pooled = sweep_pooled(lab, families)
    recipe = decisions.choose_recipe(pooled, lab.study)
    on_recipe = recipe.select("horizon", "family")
    chosen = frame.join(on_recipe, ["horizon", "family"])
    chosen_daily = daily.join(on_recipe, ["horizon", "family"])
    return {
        "configurations": sweep_configurations(lab, families),
        "pooled": pooled,
        "detectability": decisions.detectability_table(pooled, lab.sigma, lab.study),
        "ic_by_month": scoring.ic_by_month(daily, CONFIGURATION),
        "settings": decisions.settings_table(frame, CONFIGURATION),
        "deciles": scoring.decile_returns(frame, CONFIGURATION, "pred", "fwd_logret", "test_month"),
        "daily_ic_correlation": scoring.daily_correlation(chosen_daily, lab.study.targets, "ic"),
        "prediction_correlation": scoring.prediction_correlation(chosen, lab.study.targets),
        "selection": recipe,
        "per_coin_best": decisions.best_per_coin(sweep_configurations(lab, families), lab.study),
    }


def model_agreement(lab: Lab, a: str, b: str, **options) -> DataFrame:
    return scoring.family_agreement(
        lab.predictions(a, **options),
        lab.predictions(b, **options),
        ["coin", "horizon"],
        f"{a}_{b}_spearman",
    )


# ---------------------------------------------------------------- input sources


def source_dailies(lab: Lab, horizon: int, family: str) -> tuple[DataFrame, DataFrame]:
    """Daily IC with all and with own inputs on the rows both scored."""
    everything, own = (
        lab.predictions(family, inputs, horizons=(horizon,)) for inputs in ("all", "own")
    )
    shared = decisions.shared_rows(everything, own, ["coin", "horizon"])
    return tuple(
        lab.daily_ic(("sources", family, horizon, name), frame, ("coin",))
        for name, frame in zip(("all", "own"), shared, strict=True)
    )


def source_tables(lab: Lab, horizon: int, family: str) -> dict[str, DataFrame]:
    s = lab.study
    daily_all, daily_own = source_dailies(lab, horizon, family)
    gain = scoring.pooled_ic_difference(daily_own, daily_all, [], s)
    months, end = s.periods["research"]
    return {
        "sources": decisions.sources_table(
            daily_all, daily_own, returns.benchmark_correlation(lab.grid, s), s
        ),
        "importance": importance.permutation_importance(
            lab.features, s, family, schema.model_inputs(s), schema.importance_groups(s),
            months, end, (horizon,),
        ),
        "choice": decisions.choose_inputs(gain),
    }


# ---------------------------------------------------------------- retraining


def retraining_daily(lab: Lab, horizon: int, family: str, inputs: str = "all") -> DataFrame:
    frames = [lab.predictions(family, inputs, p, horizons=(horizon,)) for p in POLICIES]
    return lab.daily_ic(
        ("retraining", horizon, family, inputs), union(frames), ("coin", "policy")
    )


def retraining_challengers(lab: Lab, daily: DataFrame) -> DataFrame:
    """Pooled gain of each other policy over the expanding window."""
    challengers = daily.where(F.col("policy") != "expanding")
    base = daily.where(F.col("policy") == "expanding").select(
        "coin", "day", F.col("ic").alias("_b")
    )
    gains = challengers.join(base, ["coin", "day"]).select(
        "policy", "coin", "day", (F.col("ic") - F.col("_b")).alias("ic")
    )
    return scoring.pooled_ic_summary(gains, ["policy"], lab.study)


def retraining_tables(lab: Lab, horizon: int, family: str, inputs: str = "all") -> dict[str, DataFrame]:
    daily = retraining_daily(lab, horizon, family, inputs)
    by_month = decisions.retraining_by_month(
        scoring.ic_by_month(daily, ["coin", "policy"]), lab.study
    )
    challengers = retraining_challengers(lab, daily)
    return {
        "retraining": scoring.ic_summary(daily, ["coin", "policy"], lab.study),
        "retraining_by_month": by_month,
        "challengers": challengers,
        "choice": decisions.choose_policy(challengers),
    }


# ---------------------------------------------------------------- economics


STRATEGY = ("coin", "horizon", "rule", "delay", "fee")


def strategy_daily(
    lab: Lab,
    horizon: int,
    family: str,
    period: str = "research",
    rules: Sequence[str] = tuple(RULES),
    delays: Sequence[int] = DELAYS,
    inputs: str = "all",
    policy: str = "expanding",
) -> DataFrame:
    """Daily flows per coin, rule, delay and fee."""

    def build() -> DataFrame:
        frame = lab.predictions(family, inputs, policy, period, (horizon,))
        study = lab.study.with_changes(horizons=(horizon,))
        bars = positions.strategy_bars(
            frame, lab.period_bars(period), ["coin", "horizon"], study, rules, delays
        )
        keys = ["coin", "horizon", "rule", "delay"]
        return positions.with_fees(positions.daily_flows(bars, keys), study)

    return lab._once(
        ("strategy", horizon, family, period, tuple(rules), tuple(delays), inputs, policy), build
    )


def strategy_table(lab: Lab, daily: DataFrame, period: str) -> DataFrame:
    return positions.pnl_stats(daily, lab.hold(period), list(STRATEGY), lab.study)


def portfolio_table(lab: Lab, daily: DataFrame) -> DataFrame:
    keys = ["rule", "delay", "fee"]
    return positions.strategy_stats(positions.portfolio_daily(daily, keys), keys, lab.study)


def taker_net(daily: DataFrame, rule: str, delay: int = 0) -> DataFrame:
    return daily.where(
        (F.col("rule") == rule) & (F.col("fee") == "taker") & (F.col("delay") == delay)
    )


def only_value(choice: DataFrame, column: str, what: str):
    """The value of a one-row decision; an error where nothing could be chosen."""
    row = choice.first()
    if row is None or row[column] is None:
        raise ValueError(f"no {what} can be chosen: no candidate has a known merit")
    return row[column]


def economics_tables(
    lab: Lab, horizon: int, family: str, inputs: str = "all", policy: str = "expanding"
) -> dict[str, DataFrame]:
    s = lab.study
    daily = strategy_daily(lab, horizon, family, inputs=inputs, policy=policy)
    portfolio = portfolio_table(lab, daily)
    choice = decisions.choose_rule(portfolio, tuple(RULES))
    net = taker_net(daily, only_value(choice, "rule", "rule"))
    ic = lab.daily_ic(
        ("economics", horizon, family, inputs, policy),
        lab.predictions(family, inputs, policy, horizons=(horizon,)),
        ("coin", "horizon"),
    )
    research = ic.groupBy("coin", "horizon").agg(F.avg("ic").alias("research_ic"))
    return {
        "economics": strategy_table(lab, daily, "research"),
        "portfolio": portfolio,
        "pnl_correlation": scoring.daily_correlation(net, s.targets, "net"),
        "equity": positions.equity_curves(net, lab.hold("research"), s.targets),
        "needed_ic": decisions.needed_ic_table(
            lab.sigma.where(F.col("horizon") == horizon), research, s
        ),
        "choice": choice,
    }


# ---------------------------------------------------------------- forward


def forward_daily(
    lab: Lab, horizon: int, family: str, period: str, inputs: str = "all", policy: str = "expanding"
) -> DataFrame:
    return lab.daily_ic(
        ("forward", horizon, family, period, inputs, policy),
        lab.predictions(family, inputs, policy, period, (horizon,)),
        ("coin",),
    )


def forward_equity(lab: Lab, daily: DataFrame, rule: str) -> DataFrame:
    """Running net of the portfolio per fee and of each coin at taker fees."""
    rows = daily.where((F.col("rule") == rule) & (F.col("delay") == 0))
    together = positions.portfolio_daily(rows, ["fee"]).select(
        F.concat(F.lit("portfolio_"), "fee").alias("curve"), "day", F.col("net").alias("v")
    )
    coins = rows.where(F.col("fee") == "taker").select(
        F.concat("coin", F.lit("_taker")).alias("curve"), "day", F.col("net").alias("v")
    )
    names = [f"portfolio_{n}" for n, _ in lab.study.fees_bps]
    names += [f"{c}_taker" for c in lab.study.targets]
    return positions.cumulated(together.unionByName(coins), names)


def forward_tables(
    lab: Lab,
    horizon: int,
    family: str,
    rule: str,
    inputs: str = "all",
    policy: str = "expanding",
    families: Sequence[str] = RULE_FAMILIES,
) -> dict[str, DataFrame]:
    s = lab.study
    research, forward = (
        forward_daily(lab, horizon, family, p, inputs, policy) for p in ("research", "forward")
    )
    daily = strategy_daily(lab, horizon, family, "forward", (rule,), (0,), inputs, policy)
    frame = lab.predictions(family, inputs, policy, "forward", (horizon,))
    both = union(
        [
            sweep_daily(lab, families, p).withColumn("period", F.lit(p))
            for p in ("research", "forward")
        ]
    )
    best = decisions.best_per_coin(sweep_configurations(lab, families), s)
    context = union([lab.predictions(f, inputs, policy, "forward", (horizon,)) for f in families])
    context_daily = lab.daily_ic(
        ("context", horizon, inputs, policy, tuple(families)), context, CONFIGURATION
    )
    return {
        "forward": decisions.forward_table(research, forward, s),
        "context": scoring.ic_summary(context_daily, list(CONFIGURATION), s),
        "shrinkage": decisions.shrinkage_table(best, both),
        "economics": strategy_table(lab, daily, "forward"),
        "volatility_terciles": scoring.tercile_table(frame, trailing_volatility(lab), ["coin"]),
        "equity": forward_equity(lab, daily, rule),
        "audit": grid.forward_audit(lab.raw, s),
        "verdict": portfolio_table(lab, daily),
    }


def trailing_volatility(lab: Lab) -> DataFrame:
    name = f"x_roll_vol_logret_{lab.study.long_window}"
    return lab.features.select("coin", "pos", F.col(name).alias("volatility"))


# ---------------------------------------------------------------- volatility


VOLATILITY = ("coin", "horizon", "model", "period")


def volatility_frame(lab: Lab, models: Sequence[str], periods: Sequence[str]) -> DataFrame:
    return union([lab.volatility_predictions(m, p) for m in models for p in periods])


def volatility_daily(
    lab: Lab, models: Sequence[str] = ("har",), periods: Sequence[str] = ("research", "forward")
) -> DataFrame:
    return lab.daily_ic(
        ("volatility", tuple(models), tuple(periods)),
        volatility_frame(lab, models, periods),
        VOLATILITY,
    )


def volatility_table(
    lab: Lab, models: Sequence[str] = ("har",), periods: Sequence[str] = ("research", "forward")
) -> DataFrame:
    keys = list(VOLATILITY)
    error = volatility_frame(lab, models, periods).groupBy(*keys).agg(
        scoring.r2_against_training_mean().alias("oos_r2")
    )
    skill = scoring.ic_summary(volatility_daily(lab, models, periods), keys, lab.study)
    return skill.join(error, keys)


def volatility_gains(
    lab: Lab, challenger: str, default: str, periods: Sequence[str] = ("research", "forward")
) -> DataFrame:
    daily = volatility_daily(lab, (default, challenger), periods)
    return decisions.gain_table(
        daily.where(F.col("model") == challenger),
        daily.where(F.col("model") == default),
        lab.sigma,
        ["horizon", "period"],
        lab.study,
    )


def volatility_tables(lab: Lab, challenger: str, default: str = "har") -> dict[str, DataFrame]:
    models = (default, challenger)
    daily = volatility_daily(lab, models)
    gains = volatility_gains(lab, challenger, default)
    return {
        "volatility": volatility_table(lab, models),
        "ic_by_month": scoring.ic_by_month(daily, VOLATILITY),
        "pooled": scoring.pooled_ic_summary(daily, ["horizon", "model", "period"], lab.study),
        "gain": gains,
        "choice": decisions.choose_models(gains, challenger, default),
    }


# ---------------------------------------------------------------- volatility strategy


GATED = ("coin", "version", "fee", "period")


def gated_daily(
    lab: Lab,
    horizon: int,
    family: str,
    rule: str,
    model: str = "har",
    periods: Sequence[str] = ("research", "forward"),
    inputs: str = "all",
    policy: str = "expanding",
) -> DataFrame:
    """Daily flows per coin, version, fee and period."""

    def build() -> DataFrame:
        study = lab.study.with_changes(horizons=(horizon,))
        keys = ["coin", "horizon"]
        parts = []
        for p in periods:
            rows = gating.version_bars(
                lab.predictions(family, inputs, policy, p, (horizon,)),
                lab.volatility_predictions(model, p, (horizon,)),
                lab.period_bars(p),
                keys,
                study,
                rule,
            )
            parts.append(gating.version_daily(rows, keys).withColumn("period", F.lit(p)))
        return union(parts)

    key = ("gated", horizon, family, rule, model, tuple(periods), inputs, policy)
    return lab._once(key, build)


def gated_strategy(lab: Lab, daily: DataFrame, periods: Sequence[str] = ("research", "forward")) -> DataFrame:
    hold = union([lab.hold(p) for p in periods])
    return gating.version_stats(daily, hold, list(GATED), lab.study)


def gated_months(
    lab: Lab,
    daily: DataFrame,
    horizon: int,
    family: str,
    periods: Sequence[str] = ("research", "forward"),
    inputs: str = "all",
    policy: str = "expanding",
) -> DataFrame:
    direction = union([lab.predictions(family, inputs, policy, p, (horizon,)) for p in periods])
    return gating.monthly_gate(daily, direction, ["coin", "period"])


def gated_portfolio_daily(daily: DataFrame) -> DataFrame:
    return positions.portfolio_daily(daily, ["version", "fee", "period"])


def gated_portfolio(lab: Lab, daily: DataFrame) -> DataFrame:
    keys = ["version", "fee", "period"]
    return positions.strategy_stats(gated_portfolio_daily(daily), keys, lab.study)


def gated_equity(lab: Lab, daily: DataFrame) -> DataFrame:
    """Running taker net over both periods per coin and version, and of the portfolio."""
    taker = daily.where(F.col("fee") == "taker")
    coins = taker.select(F.concat_ws("_", "coin", "version").alias("curve"), "day", F.col("net").alias("v"))
    together = gated_portfolio_daily(taker).select(
        F.concat(F.lit("portfolio_"), "version").alias("curve"), "day", F.col("net").alias("v")
    )
    names = [f"{c}_{v}" for v in VERSIONS for c in (*lab.study.targets, "portfolio")]
    return positions.cumulated(coins.unionByName(together), names)


def gated_tables(
    lab: Lab,
    horizon: int,
    family: str,
    rule: str,
    model: str = "har",
    inputs: str = "all",
    policy: str = "expanding",
) -> dict[str, DataFrame]:
    daily = gated_daily(lab, horizon, family, rule, model, inputs=inputs, policy=policy)
    portfolio = gated_portfolio(lab, daily)
    choice = decisions.choose_version(portfolio, VERSIONS)
    version = only_value(choice, "version", "version")
    net = daily.where(
        (F.col("version") == version)
        & (F.col("fee") == "taker")
        & (F.col("period") == "research")
    )
    return {
        "strategy": gated_strategy(lab, daily),
        "gate": gated_months(lab, daily, horizon, family, inputs=inputs, policy=policy),
        "portfolio": portfolio,
        "pnl_correlation": scoring.daily_correlation(net, lab.study.targets, "net"),
        "equity": gated_equity(lab, daily),
        "choice": choice,
    }


def coins_and_portfolio(strategy: DataFrame, portfolio: DataFrame, fee: str = "taker") -> DataFrame:
    """Strategy rows of the coins and the portfolio at one fee."""
    return strategy.unionByName(
        portfolio.withColumn("coin", F.lit("portfolio")), allowMissingColumns=True
    ).where(F.col("fee") == fee)


# ---------------------------------------------------------------- pooled model


def pooling_dailies(
    lab: Lab, horizons: tuple[int, ...] | None = None, periods: Sequence[str] = ("research", "forward")
) -> tuple[DataFrame, DataFrame]:
    """Daily skill of one model for all coins and of one each; all horizons in one walk."""
    keys = ("coin", "horizon", "period")
    pooled = union([lab.pooled_predictions(period=p, horizons=horizons) for p in periods])
    single = union([lab.predictions("ridge", period=p, horizons=horizons) for p in periods])
    return (
        lab.daily_ic(("pooling", "one", horizons, tuple(periods)), pooled, keys),
        lab.daily_ic(("pooling", "each", horizons, tuple(periods)), single, keys),
    )


def pooled_model_tables(lab: Lab, horizon: int) -> dict[str, DataFrame]:
    pooled, single = pooling_dailies(lab, (horizon,))
    table = decisions.comparison_table(pooled, single, lab.sigma, ["horizon", "period"], lab.study)
    both = union(
        [pooled.withColumn("model", F.lit("pooled")), single.withColumn("model", F.lit("per_coin"))]
    )
    frames = union(
        [lab.pooled_predictions(period=p, horizons=(horizon,)) for p in ("research", "forward")]
    )
    return {
        "pooled": table,
        "ic_by_month": scoring.ic_by_month(both, ["coin", "model", "period"]),
        "settings": decisions.settings_table(
            frames.where(F.col("coin") == lab.study.targets[0]), ["period"]
        ),
        "choice": decisions.choose_pooling(table),
    }


# ---------------------------------------------------------------- the whole study


def study_tables(
    lab: Lab,
    families: Sequence[str] = RULE_FAMILIES,
    challenger: str = "ridge",
    frozen: dict | None = None,
) -> Iterator[tuple[str, dict[str, DataFrame]]]:
    """Experiment by experiment, each with what the earlier ones chose.

    The recipe of the sweep goes to the input comparison, its inputs to the retraining, the policy
    to the economics, the rule to the forward run, and the volatility model to the gated strategy.
    ``frozen`` is a record of horizon, family, inputs, policy and rule: the forward run stops where
    the choices differ from it.
    """
    yield "audit", audit_tables(lab)
    sweep = sweep_tables(lab, families)
    yield "horizon_sweep", sweep
    horizon = only_value(sweep["selection"], "horizon", "recipe")
    family = only_value(sweep["selection"], "family", "recipe")
    compared = "ridge" if family in decisions.ONE_INPUT_FAMILIES else family
    sources = source_tables(lab, horizon, compared)
    yield "feature_sources", sources
    inputs = only_value(sources["choice"], "inputs", "input set")
    retraining = retraining_tables(lab, horizon, family, inputs)
    yield "retraining", retraining
    policy = only_value(retraining["choice"], "policy", "policy")
    economics = economics_tables(lab, horizon, family, inputs, policy)
    yield "economics", economics
    rule = only_value(economics["choice"], "rule", "rule")
    chosen = decisions.chosen_configuration(
        sweep["selection"], sources["choice"], retraining["choice"], economics["choice"]
    )
    if frozen is not None:
        decisions.require_frozen(chosen, frozen)
    yield "forward", forward_tables(lab, horizon, family, rule, inputs, policy, families)
    volatility = volatility_tables(lab, challenger)
    yield "volatility", volatility
    at_horizon = volatility["choice"].where(F.col("horizon") == horizon)
    model = only_value(at_horizon, "model", "volatility model")
    yield "volatility_strategy", gated_tables(lab, horizon, family, rule, model, inputs, policy)
    yield "pooled", pooled_model_tables(lab, horizon)
