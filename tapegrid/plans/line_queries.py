"""Walk-forward, scoring, strategy and decision queries over the daily order-line bars."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from tapegrid import schema
from tapegrid.config import DELAYS, FAMILIES, POLICIES, RULES, VERSIONS, EDGE_PER_UNIT_IC, SIZE_CAP
from tapegrid.functions.columns import month_of
from tapegrid.operators import (
    blocks,
    bootstrap,
    decisions,
    fitting,
    folds,
    gating,
    importance,
    positions,
    scoring,
    walkforward,
)
from tapegrid.operators import grid as gridding
from tapegrid.oracle import sql as o
from tapegrid.plans import experiments as exp
from tapegrid.plans.catalog import ORACLES, query
from tapegrid.plans.studies import LINES, lines_lab
from tapegrid.session import prepare, settle, shared_folder
from tapegrid.sources import derived, store

S = LINES
INPUTS = schema.model_inputs(S)
OWN = schema.own_inputs(S)
HAR = schema.har_inputs(S)
RULE_NAMES = tuple(RULES)
BARS = o.bars(o.LINE_TICKS, S)
FEATURES = o.features(BARS, S)
COINS = S.targets
PERIODS = S.periods
KEYS = "coin, horizon"
FUNDING = """SELECT 'flag_' || lower(l_returnflag) AS asset,
    ((epoch_us(l_shipdate) // 86400000000) // 7 * 7)::BIGINT AS pos, (avg(l_tax) - 0.04) / 100 AS rate
    FROM lineitem GROUP BY ALL"""


def walked(period="research", policy="expanding", inputs=INPUTS, horizons=None, tag="", base=FEATURES):
    months, end = PERIODS[period]
    study = S.with_changes(horizons=tuple(horizons or S.horizons))
    return o.walk(base, study, inputs, months, end, policy, horizons=horizons, tag=tag), study


def momentum(period="research", policy="expanding", horizons=None, tag="", base=FEATURES, inputs=INPUTS):
    q, study = walked(period, policy, inputs, horizons, tag, base)
    return o.momentum(q, study, tag)


def best(period="research", horizons=None, tag="", base=FEATURES, inputs=INPUTS):
    q, study = walked(period, "expanding", inputs, horizons, tag, base)
    return o.best_feature(q, study, inputs, tag)


def stacked(q: o.Query, name: str, parts: dict[str, str]) -> o.Query:
    """Union of prediction tables with a literal column block each."""
    return q.add(name, " UNION ALL ".join(f"SELECT *, {extra} FROM {source}" for source, extra in parts.items()))


PRED = "coin, horizon, pos, ~pred, ~y, ~fwd_logret, test_month, ~q10, ~q30, ~q50, ~q70, ~q90, ~valid_ic, setting"
PRED_COLUMNS = [c.strip(" ~") for c in PRED.split(",")]
SWEEP_FAMILIES = ("momentum", "best_feature")


def both_families(period="research") -> o.Query:
    q = best(period, tag="_b", base=momentum(period, tag="_m"))
    return stacked(
        q,
        "frames",
        {"predictions_m": "'momentum' AS family", "predictions_b": "'best_feature' AS family"},
    )


SWEEP = both_families()
CONFIG = "coin, horizon, family"
SWEEP_DAILY = SWEEP.extend(o.daily_ic("frames", CONFIG))
MOM = momentum()
MOM_DAILY = MOM.extend(o.daily_ic("predictions", KEYS))


# ---------------------------------------------------------------- E: ranks, folds, fits


@query(
    "standardised_ranks",
    o.Query({"k": o.ranks("lineitem", "l_returnflag", "l_quantity", "k", "l_returnflag, l_quantity")}).sql(
        f"""SELECT DISTINCT l_returnflag, l_quantity, round({o.z("k", "l_returnflag")}, 6) + 0.0 AS z FROM k"""
    ),
)
def _(spark, folder):
    prepare(spark)
    lines = derived.read(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    return blocks.standardised_ranks(lines, ["l_returnflag"], "l_quantity", "z").distinct()


@query(
    "exact_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) + 0.0 AS q10,
    round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q50,
    round(quantile_cont(l_extendedprice, 0.9), 6) + 0.0 AS q90 FROM lineitem GROUP BY ALL""",
)
def _(spark, folder):
    prepare(spark)
    lines = derived.read(spark, folder, "lineitem")
    levels = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    return blocks.quantiles(lines, ["l_returnflag"], "l_extendedprice", levels)


def split_sql(policy: str) -> str:
    q, _ = walked("research", policy)
    return q.sql(
        f"""SELECT '{policy}' AS policy, coin, horizon, test_month, train_rows, valid_rows, refit_rows,
        threshold_rows, test_rows FROM (SELECT coin, horizon, test_month,
        count(*) FILTER (train) AS train_rows, count(*) FILTER (valid) AS valid_rows,
        count(*) FILTER (train OR valid) AS refit_rows, count(*) FILTER (threshold) AS threshold_rows
        FROM fitting GROUP BY ALL) JOIN (SELECT coin, horizon, test_month, count(*) AS test_rows
        FROM tested GROUP BY ALL) USING (coin, horizon, test_month)"""
    )


def split_query(policy: str) -> None:
    @query(f"fold_rows_{policy}", split_sql(policy))
    def _(spark, folder):
        lab = lines_lab(spark, folder)
        months, end = PERIODS["research"]
        rows = folds.horizon_rows(lab.features, INPUTS, S.horizons)
        table = folds.split_counts(rows, folds.monthly_folds(months, S, policy), INPUTS, S, end)
        return table.drop("window").withColumn("policy", F.lit(policy))


for _policy in POLICIES:
    split_query(_policy)


@query(
    "monthly_folds",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS policy, test_month, train_start::TIMESTAMP AS train_start,
        valid_start::TIMESTAMP AS valid_start, train_end::TIMESTAMP AS train_end, n AS lines FROM
        ({o.folds(PERIODS["research"][0], S, p)}) JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS test_month,
        count(*) AS n FROM lineitem GROUP BY ALL) USING (test_month)"""
        for p in POLICIES
    ),
)
def _(spark, folder):
    """Folds of every policy with the order lines of their test month."""
    prepare(spark)
    lines = derived.read(spark, folder, "lineitem")
    monthly = lines.groupBy(month_of("l_shipdate").alias("test_month")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    table = exp.union(
        [
            folds.folds_table(
                spark, folds.monthly_folds(PERIODS["research"][0], S, p)
            ).withColumn("policy", F.lit(p))
            for p in POLICIES
        ]
    )
    return table.drop("test_start", "test_end").join(monthly, "test_month")


@query(
    "line_fit",
    FEATURES.sql("""SELECT coin, round(regr_slope(y_2, x_trail_ret_2), 6) + 0.0 AS slope,
        round(regr_intercept(y_2, x_trail_ret_2), 6) + 0.0 AS intercept FROM features GROUP BY coin"""),
)
def _(spark, folder):
    return fitting.fit_line(lines_lab(spark, folder).features, ["coin"], "x_trail_ret_2", "y_2")


# Equal values that two engines compute in another order differ in the last digits only.
NINE_DIGITS = FEATURES.add("raw_features", FEATURES.parts["features"]).add(
    "features",
    "SELECT coin, pos, open_time, x_close, "
    + ", ".join(f"round({n}, 9) + 0.0 AS {n}" for n in INPUTS)
    + ", "
    + ", ".join(schema.label_names(S))
    + " FROM raw_features",
)
NINE_DIGITS = o.Query(
    {
        **{k: v for k, v in NINE_DIGITS.parts.items() if k != "features"},
        "features": NINE_DIGITS.parts["features"],
    }
)


@query(
    "input_rank_correlations",
    best(base=NINE_DIGITS).sql(
        f"""SELECT coin, horizon, test_month, role, list_extract([{", ".join(f"'{n}'" for n in INPUTS)}],
        (place + 1)::BIGINT) AS input, round(spearman, 6) + 0.0 AS spearman FROM rho"""
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    cleaned = lab.features.withColumns({n: F.round(n, 9) for n in INPUTS})
    rows = folds.horizon_rows(cleaned, INPUTS, S.horizons)
    table = folds.monthly_folds(PERIODS["research"][0], S)
    months = F.create_map(*[F.lit(x) for f in table for x in (f.window, f.test_month)])
    rho = fitting.input_rank_correlations(rows, table, INPUTS, S)
    return rho.select(
        "coin", "horizon", months[F.col("window")].alias("test_month"), "role", "input", "spearman"
    )


@query(
    "most_correlated_input",
    best(inputs=OWN).sql("SELECT coin, horizon, test_month, role, setting AS input FROM model"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    rows = folds.horizon_rows(lab.features, OWN, S.horizons)
    table = folds.monthly_folds(PERIODS["research"][0], S)
    months = F.create_map(*[F.lit(x) for f in table for x in (f.window, f.test_month)])
    rho = fitting.input_rank_correlations(rows, table, OWN, S)
    return fitting.most_correlated_input(rho).select(
        "coin", "horizon", months[F.col("window")].alias("test_month"), "role", "input"
    )


def prediction_query(name: str, sql: str | None, **options) -> None:
    @query(name, sql)
    def _(spark, folder):
        return lines_lab(spark, folder).predictions(**options).select(*PRED_COLUMNS)


def fixed_momentum(policy: str) -> str:
    return momentum(policy=policy).select(PRED, "predictions")


prediction_query("momentum_predictions", MOM.select(PRED, "predictions"), family="momentum")
prediction_query(
    "momentum_predictions_fixed", fixed_momentum("fixed"), family="momentum", policy="fixed"
)
prediction_query(
    "momentum_predictions_rolling", fixed_momentum("rolling_3m"), family="momentum", policy="rolling_3m"
)
prediction_query(
    "momentum_predictions_forward",
    momentum("forward").select(PRED, "predictions"),
    family="momentum",
    period="forward",
)
prediction_query("best_feature_predictions", best().select(PRED, "predictions"), family="best_feature")
prediction_query(
    "best_feature_own_predictions",
    best(inputs=OWN).select(PRED, "predictions"),
    family="best_feature",
    inputs="own",
)
prediction_query("ridge_predictions", None, family="ridge")
prediction_query("tree_predictions", None, family="trees", policy="fixed")


@query("stored_predictions", momentum().select(PRED, "predictions"))
def _(spark, folder):
    """Predictions computed once per key: asked for one horizon, then for all of them."""
    lab = lines_lab(spark, folder)
    path = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    keys = ["family", "inputs", "policy", "period", "horizon"]
    held = store.PredictionStore(spark, path, keys)

    def wanted(horizons):
        rows = [("momentum", "all", "expanding", "research", h) for h in horizons]
        return spark.createDataFrame(rows, "family string, inputs string, policy string, period string, horizon int")

    def compute(missing):
        return lab.predictions("momentum", horizons=tuple(sorted(r["horizon"] for r in missing.collect())))

    held.get(wanted(S.horizons[:1]), compute)
    return held.get(wanted(S.horizons), compute).select(*PRED_COLUMNS)


@query("pooled_predictions", None)
def _(spark, folder):
    return lines_lab(spark, folder).pooled_predictions().select(*PRED_COLUMNS)


PAIR = ("x_trail_ret_2", "x_candle_body_pct")


def ridge_sql() -> str:
    """Two-input ridge: clipped scores, six penalties, validation choice, refit."""
    q, _ = walked(inputs=PAIR)
    key = "coin, horizon, test_month"
    alphas = ", ".join(f"({a})" for a in (1e2, 1e3, 1e4, 1e5, 1e6, 1e7))
    a, b = PAIR
    solve = """(say * (sbb + alpha) - sby * sab) / ((saa + alpha) * (sbb + alpha) - sab * sab) AS w1,
        (sby * (saa + alpha) - say * sab) / ((saa + alpha) * (sbb + alpha) - sab * sab) AS w2"""
    return q.extend(
        {
            "moments": f"""SELECT {key}, role, avg({a}) AS ma, stddev_pop({a}) AS sa, avg({b}) AS mb,
                stddev_pop({b}) AS sb FROM roles GROUP BY ALL""",
            "scores": f"""SELECT {key}, r.*, least(greatest(({a} - ma) / sa, -5), 5) AS za,
                least(greatest(({b} - mb) / sb, -5), 5) AS zb FROM
                (SELECT {key}, role, y, {a}, {b} FROM roles) r JOIN moments USING ({key}, role)""".replace(
                f"SELECT {key}, r.*", "SELECT r.*"
            ),
            "sums": f"""SELECT {key}, role, count(*) AS n, avg(za) AS ca, avg(zb) AS cb, avg(y) AS cy,
                count(*) * var_pop(za) AS saa, count(*) * var_pop(zb) AS sbb,
                count(*) * covar_pop(za, zb) AS sab, count(*) * covar_pop(za, y) AS say,
                count(*) * covar_pop(zb, y) AS sby FROM scores GROUP BY ALL""",
            "fits": f"""SELECT {key}, role, alpha, ca, cb, cy, {solve} FROM sums
                CROSS JOIN (VALUES {alphas}) t(alpha)""",
            "errors": f"""SELECT {key}, alpha, avg((y - (cy + w1 * (least(greatest(({a} - ma) / sa, -5), 5) - ca)
                + w2 * (least(greatest(({b} - mb) / sb, -5), 5) - cb))) ** 2) AS mse
                FROM (SELECT * FROM fitting WHERE valid) v JOIN (SELECT * FROM moments WHERE role = 'inner') m
                USING ({key}) JOIN (SELECT * FROM fits WHERE role = 'inner') f USING ({key}) GROUP BY ALL""",
            "picked": f"""SELECT {key}, alpha FROM errors QUALIFY row_number() OVER
                (PARTITION BY {key} ORDER BY mse, alpha) = 1""",
            "model": f"""SELECT {key}, role, w1, w2, cy - w1 * ca - w2 * cb AS intercept, ma, sa, mb, sb,
                'alpha=' || format('{{:.0e}}', alpha) AS setting FROM fits JOIN picked USING ({key}, alpha)
                JOIN moments USING ({key}, role)""",
            **o.levels(
                "model",
                f"(intercept + w1 * least(greatest(({a} - ma) / sa, -5), 5) "
                f"+ w2 * least(greatest(({b} - mb) / sb, -5), 5))",
            ),
        }
    ).select(PRED, "predictions")


@query("ridge_two_inputs", ridge_sql())
def _(spark, folder):
    lab = lines_lab(spark, folder)
    months, end = PERIODS["research"]
    return walkforward.out_of_sample(
        lab.features, S, "ridge", PAIR, "expanding", months, end
    ).select(*PRED_COLUMNS)


def pooled_sql(period: str, tag: str = "") -> o.Query:
    """Two-input ridge over all coins: own scale, then the scale of all, six penalties, one choice."""
    q, _ = walked(period, inputs=PAIR, tag=tag)
    a, b = PAIR
    own, key = "coin, horizon, test_month", "horizon, test_month"
    alphas = ", ".join(f"({x})" for x in (1e2, 1e3, 1e4, 1e5, 1e6, 1e7))
    det = "((saa + alpha) * (sbb + alpha) - sab * sab)"
    za = f"least(greatest(({a} - ma) / sa / qa, -5), 5)"
    zb = f"least(greatest(({b} - mb) / sb / qb, -5), 5)"
    return q.extend(
        {
            f"own{tag}": f"""SELECT {own}, role, avg({a}) AS ma, stddev_pop({a}) AS sa, avg({b}) AS mb,
                stddev_pop({b}) AS sb FROM roles{tag} GROUP BY ALL""",
            f"across{tag}": f"""SELECT {key}, role, stddev_pop(({a} - ma) / sa) AS qa,
                stddev_pop(({b} - mb) / sb) AS qb
                FROM roles{tag} JOIN own{tag} USING ({own}, role) GROUP BY ALL""",
            f"scales{tag}_two": f"SELECT * FROM own{tag} JOIN across{tag} USING ({key}, role)",
            f"scored{tag}": f"""SELECT {key}, role, y, {za} AS za, {zb} AS zb
                FROM roles{tag} JOIN scales{tag}_two USING ({own}, role)""",
            f"sums{tag}": f"""SELECT {key}, role, avg(za) AS ca, avg(zb) AS cb, avg(y) AS cy,
                count(*) * var_pop(za) AS saa, count(*) * var_pop(zb) AS sbb,
                count(*) * covar_pop(za, zb) AS sab, count(*) * covar_pop(za, y) AS say,
                count(*) * covar_pop(zb, y) AS sby FROM scored{tag} GROUP BY ALL""",
            f"fits{tag}": f"""SELECT {key}, role, alpha, ca, cb, cy,
                (say * (sbb + alpha) - sby * sab) / {det} AS w1,
                (sby * (saa + alpha) - say * sab) / {det} AS w2
                FROM sums{tag} CROSS JOIN (VALUES {alphas}) t(alpha)""",
            f"errors{tag}": f"""SELECT {key}, alpha,
                avg((y - (cy + w1 * ({za} - ca) + w2 * ({zb} - cb))) ** 2) AS mse
                FROM (SELECT * FROM fitting{tag} WHERE valid) v
                JOIN (SELECT * FROM scales{tag}_two WHERE role = 'inner') m USING ({own})
                JOIN (SELECT * EXCLUDE (role) FROM fits{tag} WHERE role = 'inner') f USING ({key}) GROUP BY ALL""",
            f"picked{tag}": f"""SELECT {key}, alpha FROM errors{tag} QUALIFY row_number() OVER
                (PARTITION BY {key} ORDER BY mse, alpha) = 1""",
            f"model{tag}": f"""SELECT {own}, role, w1, w2, cy - w1 * ca - w2 * cb AS intercept, ma, sa, mb, sb,
                qa, qb, 'alpha=' || format('{{:.0e}}', alpha) AS setting
                FROM fits{tag} JOIN picked{tag} USING ({key}, alpha) JOIN scales{tag}_two USING ({key}, role)""",
            **o.levels(f"model{tag}", f"(intercept + w1 * {za} + w2 * {zb})", tag),
        }
    )


def pooled_pair(spark, folder, period):
    months, end = PERIODS[period]
    return walkforward.pooled_out_of_sample(lines_lab(spark, folder).features, S, PAIR, months, end)


@query("pooled_two_inputs", pooled_sql("research").select(PRED, "predictions"))
def _(spark, folder):
    return pooled_pair(spark, folder, "research").select(*PRED_COLUMNS)


@query("pooled_two_inputs_forward", pooled_sql("forward").select(PRED, "predictions"))
def _(spark, folder):
    return pooled_pair(spark, folder, "forward").select(*PRED_COLUMNS)


@query(
    "pooled_two_inputs_settings",
    pooled_sql("research").sql(
        f"""SELECT DISTINCT horizon, test_month, setting FROM predictions WHERE coin = '{COINS[0]}'"""
    ),
)
def _(spark, folder):
    """The penalty each month's model of all coins has chosen."""
    frame = pooled_pair(spark, folder, "research")
    return frame.where(F.col("coin") == COINS[0]).select("horizon", "test_month", "setting").distinct()


@query(
    "input_moments",
    walked(inputs=OWN)[0]
    .add("long", f"""SELECT coin, horizon, test_month, role, unnest(range({len(OWN)})) AS place,
        unnest([{", ".join(OWN)}]) AS x FROM roles""")
    .sql("""SELECT coin, horizon, test_month, role, place::INT AS place, round(avg(x), 6) + 0.0 AS centre,
        round(stddev_pop(x), 6) + 0.0 AS spread FROM long GROUP BY ALL"""),
)
def _(spark, folder):
    """Own scale of every coin: means and spreads of its training and refit rows."""
    lab = lines_lab(spark, folder)
    rows = folds.horizon_rows(lab.features, OWN, S.horizons)
    table = folds.monthly_folds(PERIODS["research"][0], S)
    months = F.create_map(*[F.lit(x) for f in table for x in (f.window, f.test_month)])
    moments = fitting.window_moments(rows, table, OWN, S)
    return moments.select(
        "coin",
        "horizon",
        months[F.col("window")].alias("test_month"),
        "role",
        F.posexplode(F.arrays_zip("centres", "spreads")).alias("place", "_m"),
    ).select(
        "coin", "horizon", "test_month", "role", "place",
        F.col("_m.centres").alias("centre"), F.col("_m.spreads").alias("spread"),
    )


VOLATILITY = o.volatility(FEATURES, S, S.horizons)


def har(period="research", horizons=None, tag="", base=VOLATILITY) -> o.Query:
    months, end = PERIODS[period]
    study = S.with_changes(horizons=tuple(horizons or S.horizons))
    q = o.walk(
        base, study, HAR, months, end, source="volatility", realised="y", horizons=horizons, tag=tag
    )
    q = o.har(q, study, tag)
    return q.extend(
        {
            f"means{tag}": f"""SELECT coin, horizon, test_month, avg(y) AS train_mean FROM roles{tag}
                WHERE role = 'refit' GROUP BY ALL""",
            f"volatilities{tag}": f"""SELECT * FROM predictions{tag}
                LEFT JOIN means{tag} USING (coin, horizon, test_month)""",
        }
    )


@query("volatility_predictions", har().select(f"{PRED}, ~train_mean", "volatilities"))
def _(spark, folder):
    frame = lines_lab(spark, folder).volatility_predictions()
    return frame.select(*PRED_COLUMNS, "train_mean")


@query(
    "training_means",
    har().sql("SELECT coin, horizon, test_month, round(train_mean, 6) + 0.0 AS train_mean FROM means"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return walkforward.month_means(
        lab.volatility_frame, S, HAR, PERIODS["research"][0], S.horizons
    )


@query("permutation_importance", None)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    months, end = PERIODS["research"]
    return importance.permutation_importance(
        lab.features, S, "ridge", INPUTS, schema.importance_groups(S), months, end, (2,)
    )


def shuffle_sql() -> str:
    """Digest-order donors: the k-th row in time takes the k-th row's values in digest order."""
    groups = ", ".join(f"('{g}')" for g in schema.importance_groups(S))
    q, _ = walked(horizons=(2,))
    own = "CASE WHEN t.\"group\" = 'x' THEN d.x_trail_ret_2 ELSE t.x_trail_ret_2 END"
    first = S.contexts[0]
    other = f"CASE WHEN t.\"group\" = '{first}' THEN d.{first}_trail_ret_2 ELSE t.{first}_trail_ret_2 END"
    return q.extend(
        {
            "copies": f"""SELECT *, md5('{S.seed}|' || "group" || '|' || pos) AS digest
                FROM tested CROSS JOIN (VALUES {groups}) g("group")""",
            "placed": """SELECT *, row_number() OVER (PARTITION BY coin, test_month, "group" ORDER BY pos) AS k,
                row_number() OVER (PARTITION BY coin, test_month, "group" ORDER BY digest) AS j FROM copies""",
        }
    ).sql(f"""SELECT t.coin, t."group", t.pos, round({own}, 6) + 0.0 AS own_value,
        round({other}, 6) + 0.0 AS context_value FROM placed t JOIN placed d ON d.coin = t.coin
        AND d.test_month = t.test_month AND d."group" = t."group" AND d.j = t.k""")


@query("shuffled_inputs", shuffle_sql())
def _(spark, folder):
    lab = lines_lab(spark, folder)
    months, end = PERIODS["research"]
    rows = folds.horizon_rows(lab.features, INPUTS, (2,))
    tested = folds.test_rows(rows, folds.monthly_folds(months, S), INPUTS, S, end)
    shuffled = importance.shuffled_inputs(tested, schema.importance_groups(S), INPUTS, S.seed)
    return shuffled.select(
        "coin", "group", "pos", F.col("x_trail_ret_2").alias("own_value"),
        F.col(f"{S.contexts[0]}_trail_ret_2").alias("context_value"),
    )


# ---------------------------------------------------------------- F: scoring


@query(
    "centred_signal",
    MOM.sql(f"SELECT coin, horizon, pos, round({o.CENTRED}, 6) + 0.0 AS signal FROM predictions"),
)
def _(spark, folder):
    frame = lines_lab(spark, folder).predictions("momentum")
    return frame.select("coin", "horizon", "pos", scoring.centred_signal().alias("signal"))


@query("rank_products", MOM_DAILY.select("coin, horizon, pos, ~product", "products"))
def _(spark, folder):
    frame = lines_lab(spark, folder).predictions("momentum")
    rows = frame.select("coin", "horizon", "pos", scoring.centred_signal().alias("s"), "fwd_logret")
    products = scoring.rank_products(rows, ["coin", "horizon"], "s", "fwd_logret")
    return products.select("coin", "horizon", "pos", "product")


def momentum_daily(lab, **options):
    frame = lab.predictions("momentum", **options)
    return lab.daily_ic(("momentum", *sorted(options.items())), frame, ("coin", "horizon"))


@query("daily_rank_ic", MOM_DAILY.select("coin, horizon, day, ~ic", "daily"))
def _(spark, folder):
    return momentum_daily(lines_lab(spark, folder))


EQUAL = MOM_DAILY.add("combined", "SELECT horizon, day, avg(ic) AS ic FROM daily GROUP BY ALL")


@query("equal_weight", EQUAL.select("horizon, day, ~ic", "combined"))
def _(spark, folder):
    return scoring.equal_weight(momentum_daily(lines_lab(spark, folder)), ["horizon"], ["ic"])


@query(
    "bootstrap_indices",
    MOM_DAILY.extend(o.bootstrap("daily", KEYS, "ic", S)).sql(
        """SELECT n::INT AS days, day_no::INT AS at, count(*) AS draws, sum(times)::BIGINT AS times,
        sum(d * times)::BIGINT AS checked FROM
        (SELECT n, d, day_no, count(*) AS times FROM picked GROUP BY ALL) GROUP BY ALL"""
    ),
)
def _(spark, folder):
    """All draws, summed per day; the draw numbers are in the sum, so that none can change places."""
    daily = momentum_daily(lines_lab(spark, folder))
    sizes = bootstrap.numbered_days(daily, ["coin", "horizon"], "ic").select("days").distinct()
    return bootstrap.draw_weights(sizes, S).groupBy("days", "at").agg(
        F.count(F.lit(1)).alias("draws"),
        F.sum("times").alias("times"),
        F.sum(F.col("draw") * F.col("times")).alias("checked"),
    )


@query(
    "bootstrap_se",
    MOM_DAILY.extend(o.bootstrap("daily", KEYS, "ic", S)).select("coin, horizon, ~se", "se"),
)
def _(spark, folder):
    daily = momentum_daily(lines_lab(spark, folder))
    return bootstrap.bootstrap_se(daily, ["coin", "horizon"], "ic", S)


SUMMARY = "~ic, ~se, ~t, days"


@query("ic_summary", SWEEP_DAILY.extend(o.summary("daily", CONFIG, "ic", S)).select(f"{CONFIG}, {SUMMARY}", "summary"))
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return scoring.ic_summary(exp.sweep_daily(lab, SWEEP_FAMILIES), list(exp.CONFIGURATION), S)


def pooled_summary(q: o.Query, keys: str, tag: str = "") -> o.Query:
    return q.add(
        f"pooled{tag}", f"SELECT {keys}, day, avg(ic) AS ic FROM daily{tag} GROUP BY ALL"
    ).extend(o.summary(f"pooled{tag}", keys, "ic", S, f"_pooled{tag}"))


@query(
    "pooled_ic_summary",
    pooled_summary(SWEEP_DAILY, "horizon, family").select(f"horizon, family, {SUMMARY}", "summary_pooled"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    daily = exp.sweep_daily(lab, SWEEP_FAMILIES)
    return scoring.pooled_ic_summary(daily, ["horizon", "family"], S)


PAIRED = SWEEP_DAILY.add(
    "gap",
    """SELECT coin, horizon, day, a.ic - b.ic AS ic FROM daily a JOIN daily b USING (coin, horizon, day)
    WHERE a.family = 'best_feature' AND b.family = 'momentum'""",
)


def family_pair(spark, folder):
    daily = exp.sweep_daily(lines_lab(spark, folder), SWEEP_FAMILIES)
    parts = [daily.where(F.col("family") == f).drop("family") for f in ("best_feature", "momentum")]
    return parts


@query(
    "paired_ic_difference",
    PAIRED.extend(o.summary("gap", KEYS, "ic", S)).select(f"coin, horizon, {SUMMARY}", "summary"),
)
def _(spark, folder):
    return scoring.paired_ic_difference(*family_pair(spark, folder), ["coin", "horizon"], S)


@query(
    "pooled_ic_difference",
    PAIRED.add("gap_day", "SELECT horizon, day, avg(ic) AS ic FROM gap GROUP BY ALL")
    .extend(o.summary("gap_day", "horizon", "ic", S))
    .select(f"horizon, {SUMMARY}", "summary"),
)
def _(spark, folder):
    return scoring.pooled_ic_difference(*family_pair(spark, folder), ["horizon"], S)


@query(
    "ic_by_month",
    SWEEP_DAILY.sql("""SELECT coin, horizon, family, strftime(day, '%Y-%m') AS month,
        round(avg(ic), 6) + 0.0 AS ic FROM daily GROUP BY ALL"""),
)
def _(spark, folder):
    daily = exp.sweep_daily(lines_lab(spark, folder), SWEEP_FAMILIES)
    return scoring.ic_by_month(daily, exp.CONFIGURATION)


@query(
    "hit_rate_and_r2",
    SWEEP.add("sides", f"SELECT *, {o.rule_case('median')} * fwd_logret AS p FROM frames").sql(
        """SELECT coin, horizon, family, round(count(*) FILTER (p > 0)::DOUBLE /
        nullif(count(*) FILTER (p IS NULL OR p <> 0), 0), 6) + 0.0 AS hit_rate,
        round(1 - sum((y - pred) ** 2) / sum(y ** 2), 6) + 0.0 AS oos_r2 FROM sides GROUP BY ALL"""
    ),
)
def _(spark, folder):
    frame = exp.sweep_frame(lines_lab(spark, folder), SWEEP_FAMILIES)
    return frame.groupBy(*exp.CONFIGURATION).agg(
        scoring.hit_rate(positions.rule_signal("median"), F.col("fwd_logret")).alias("hit_rate"),
        scoring.oos_r2(F.col("pred"), F.col("y")).alias("oos_r2"),
    )


def spearman_sql(q: o.Query, source: str, a: str, b: str, keys: str, name: str) -> str:
    key = f"{keys}, test_month"
    return q.extend(
        {
            "rank_one": o.ranks(f"(SELECT * FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)", key, a, "r1"),
            "rank_two": o.ranks("rank_one", key, b, "r2"),
            "monthly": f"SELECT {key}, CASE WHEN stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN corr(r1, r2) END AS rho FROM rank_two GROUP BY ALL",
        }
    ).sql(f"SELECT {keys}, round(avg(rho), 6) + 0.0 AS {name} FROM monthly GROUP BY ALL")


@query(
    "within_month_spearman",
    spearman_sql(MOM, "predictions", "pred", "fwd_logret", KEYS, "spearman"),
)
def _(spark, folder):
    frame = lines_lab(spark, folder).predictions("momentum")
    return scoring.within_month_spearman(
        frame, ["coin", "horizon"], "pred", "fwd_logret", "test_month", "spearman"
    )


DECILES = SWEEP.extend(
    {
        "ranked": o.ranks("frames", f"{CONFIG}, test_month", "pred", "k"),
        "sized": f"SELECT *, count(*) OVER (PARTITION BY {CONFIG}, test_month) AS n FROM ranked",
        "deciles": f"""SELECT {CONFIG}, test_month, ceil(10 * (k / n))::INT AS decile,
            avg(fwd_logret) AS mean_return FROM sized GROUP BY ALL""",
    }
)


def sweep_deciles(spark, folder):
    frame = exp.sweep_frame(lines_lab(spark, folder), SWEEP_FAMILIES)
    return scoring.decile_returns(frame, exp.CONFIGURATION, "pred", "fwd_logret", "test_month")


@query("decile_returns", DECILES.select(f"{CONFIG}, test_month, decile, ~mean_return", "deciles"))
def _(spark, folder):
    return sweep_deciles(spark, folder)


@query(
    "decile_means",
    DECILES.sql(f"""SELECT {CONFIG}, decile, round(avg(mean_return) * 1e4, 6) + 0.0 AS mean_bps
        FROM deciles GROUP BY ALL"""),
)
def _(spark, folder):
    return scoring.decile_means(sweep_deciles(spark, folder), exp.CONFIGURATION)


MOM2 = momentum(horizons=(2,))


def prediction_matrix_sql() -> str:
    q = MOM2.add(
        "signal_wide",
        "SELECT pos, max(test_month) AS test_month, "
        + ", ".join(f"max({o.CENTRED}) FILTER (coin = '{c}') AS {c}" for c in COINS)
        + " FROM predictions GROUP BY pos",
    )
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, test_month, {a} AS va, {b} AS vb FROM signal_wide"
        for a in COINS
        for b in COINS
    )
    q = q.add("pairs", f"SELECT * FROM ({pairs}) WHERE va IS NOT NULL AND vb IS NOT NULL")
    q = q.add("pair_a", o.ranks("pairs", "a, b, test_month", "va", "ra"))
    q = q.add("pair_b", o.ranks("pair_a", "a, b, test_month", "vb", "rb"))
    q = q.add("monthly", "SELECT a, b, test_month, corr(ra, rb) AS rho FROM pair_b GROUP BY ALL")
    q = q.add("means", "SELECT a, b, avg(rho) AS rho FROM monthly GROUP BY ALL")
    cells = ", ".join(f"round(max(rho) FILTER (b = '{c}'), 6) + 0.0 AS {c}" for c in COINS)
    return q.sql(f"SELECT a AS coin, {cells} FROM means GROUP BY a")


@query("prediction_correlation", prediction_matrix_sql())
def _(spark, folder):
    frame = lines_lab(spark, folder).predictions("momentum", horizons=(2,))
    return scoring.prediction_correlation(frame, COINS)


@query(
    "model_agreement",
    spearman_sql(
        SWEEP.add(
            "together",
            f"""SELECT coin, horizon, a.test_month, a.s AS sa, b.s AS sb FROM
            (SELECT *, {o.CENTRED} AS s FROM predictions_m) a JOIN
            (SELECT *, {o.CENTRED} AS s FROM predictions_b) b USING (coin, horizon, pos)""",
        ),
        "together",
        "sa",
        "sb",
        KEYS,
        "momentum_best_feature_spearman",
    ),
)
def _(spark, folder):
    return exp.model_agreement(lines_lab(spark, folder), "momentum", "best_feature")


VOLUME = f"x_roll_vol_logret_{S.long_window}"


@query(
    "volatility_terciles",
    MOM_DAILY.extend(
        {
            "known": f"""SELECT p.coin, p.horizon, p.product, f.{VOLUME} AS v FROM products p
                JOIN features f ON f.coin = p.coin AND f.pos = p.pos WHERE f.{VOLUME} IS NOT NULL""",
            "edges": """SELECT coin, horizon, quantile_cont(v, 1/3.0) AS e1, quantile_cont(v, 2/3.0) AS e2
                FROM known GROUP BY ALL""",
        }
    ).sql("""SELECT coin, horizon, CASE WHEN v <= e1 THEN 'low' WHEN v <= e2 THEN 'middle' ELSE 'high' END
        AS tercile, round(avg(product), 6) + 0.0 AS ic, count(*) AS rows FROM known
        JOIN edges USING (coin, horizon) GROUP BY ALL"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    both = exp.trailing_volatility(lab).withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in S.horizons]))
    )
    return scoring.tercile_table(lab.predictions("momentum"), both, ["coin", "horizon"])


def matrix_sql(q: o.Query, source: str, value: str, condition: str = "true") -> str:
    q = q.add(
        "wide_days",
        "SELECT day, "
        + ", ".join(f"max({value}) FILTER (coin = '{c}') AS {c}" for c in COINS)
        + f" FROM {source} WHERE {condition} GROUP BY day",
    )
    lines = [
        f"SELECT '{a}' AS coin, "
        + ", ".join(
            f"1.0::DOUBLE AS {b}" if a == b else f"round(corr({a}, {b}), 6) + 0.0 AS {b}" for b in COINS
        )
        + " FROM wide_days"
        for a in COINS
    ]
    return q.sql(" UNION ALL ".join(lines))


@query("daily_ic_correlation", matrix_sql(MOM_DAILY, "daily", "ic", "horizon = 2"))
def _(spark, folder):
    daily = momentum_daily(lines_lab(spark, folder)).where(F.col("horizon") == 2)
    return scoring.daily_correlation(daily, COINS, "ic")


@query(
    "coin_pivot",
    MOM_DAILY.add("monthly", """SELECT coin, strftime(day, '%Y-%m') AS month, avg(ic) AS ic FROM daily
        WHERE horizon = 2 GROUP BY ALL""").sql(
        "SELECT coin, "
        + ", ".join(
            f"""round(max(ic) FILTER (month = '{m}'), 6) + 0.0 AS "{m}" """ for m in S.research_months
        )
        + " FROM monthly GROUP BY coin"
    ),
)
def _(spark, folder):
    daily = momentum_daily(lines_lab(spark, folder)).where(F.col("horizon") == 2)
    by_month = scoring.ic_by_month(daily, ["coin"])
    return scoring.coin_pivot(by_month, "month", S.research_months, "ic")


# ---------------------------------------------------------------- G: strategies

PRICED = BARS.extend(o.period_bars(S, "research", FUNDING))
MOM2_PRICED = MOM2.extend({k: v for k, v in PRICED.parts.items() if k not in MOM2.parts})
PNL = MOM2_PRICED.extend(
    o.strategy("predictions", S, "research", RULE_NAMES, DELAYS, KEYS, (2,))
).add("fee_flows", o.with_fees("flows", S))
CELL = "coin, horizon, rule, delay"
CELLS = f"{CELL}, fee"


def research_bars(lab, rules=RULE_NAMES, delays=DELAYS):
    frame = lab.predictions("momentum", horizons=(2,))
    study = S.with_changes(horizons=(2,))
    return positions.strategy_bars(
        frame, lab.period_bars("research"), ["coin", "horizon"], study, rules, delays
    )


def research_daily(lab):
    return exp.strategy_daily(lab, 2, "momentum")


@query(
    "rule_signals",
    MOM2.sql(
        "SELECT coin, pos, "
        + ", ".join(f"({o.rule_case(r)})::INT AS {r}" for r in RULE_NAMES)
        + " FROM predictions"
    ),
)
def _(spark, folder):
    frame = lines_lab(spark, folder).predictions("momentum", horizons=(2,))
    return frame.select("coin", "pos", *[positions.rule_signal(r).alias(r) for r in RULE_NAMES])


@query("period_returns", PRICED.select("coin, pos, ~close, ~bar_return, ~rate", "moves_research"))
def _(spark, folder):
    bars = lines_lab(spark, folder).period_bars("research")
    return bars.select("coin", "pos", "close", "bar_return", "rate")


@query("tranche_positions", PNL.select(f"{CELL}, pos, ~position, ~turnover", "pnl"))
def _(spark, folder):
    rows = research_bars(lines_lab(spark, folder))
    return rows.select("coin", "horizon", "rule", "delay", "pos", "position", "turnover")


@query(
    "bar_pnl",
    PNL.sql(f"""SELECT {CELL}, pos, round(gross, 6) + 0.0 AS gross, round(5.0 / 1e4 * turnover, 6) + 0.0
        AS fees, round(funding, 6) + 0.0 AS funding,
        round(gross - 5.0 / 1e4 * turnover - funding, 6) + 0.0 AS net FROM pnl"""),
)
def _(spark, folder):
    rows = positions.bar_pnl(research_bars(lines_lab(spark, folder)), 5.0)
    return rows.select("coin", "horizon", "rule", "delay", "pos", "gross", "fees", "funding", "net")


FLOW_COLUMNS = "~gross, ~fees, ~funding, ~net, ~turnover"


@query("daily_pnl", PNL.select(f"{CELLS}, day, {FLOW_COLUMNS}", "fee_flows"))
def _(spark, folder):
    daily = research_daily(lines_lab(spark, folder))
    return daily.select(
        "coin", "horizon", "rule", "delay", "fee", "day", *positions.FLOWS
    )


@query(
    "sharpe_and_interval",
    PNL.extend(o.stats("fee_flows", CELLS, S)).select(
        f"{CELLS}, ~sharpe, ~sharpe_low, ~sharpe_high", "stats"
    ),
)
def _(spark, folder):
    daily = research_daily(lines_lab(spark, folder))
    keys = list(exp.STRATEGY)
    point = daily.groupBy(*keys).agg(bootstrap.sharpe("net").alias("sharpe"))
    return point.join(bootstrap.sharpe_interval(daily, keys, "net", S), keys)


@query(
    "max_drawdown",
    PNL.extend(o.stats("fee_flows", CELLS, S)).select(f"{CELLS}, ~max_drawdown", "drawdown"),
)
def _(spark, folder):
    return positions.drawdown(research_daily(lines_lab(spark, folder)), list(exp.STRATEGY))


@query(
    "breakeven_fee",
    PNL.sql("""SELECT coin, rule, delay, round(CASE WHEN sum(turnover) > 0 THEN
        (sum(gross) - sum(funding)) / sum(turnover) * 1e4 END, 6) + 0.0 AS breakeven_bps
        FROM flows GROUP BY ALL"""),
)
def _(spark, folder):
    daily = research_daily(lines_lab(spark, folder)).where(F.col("fee") == "taker")
    return daily.groupBy("coin", "rule", "delay").agg(
        positions.breakeven_bps().alias("breakeven_bps")
    )


@query("buy_and_hold", PRICED.select("coin, day, ~hold", "hold_research"))
def _(spark, folder):
    return lines_lab(spark, folder).hold("research")


@query(
    "exposure_stats",
    PNL.extend(o.exposure("fee_flows", "hold_research", CELLS)).select(
        f"{CELLS}, {o.EXPOSURE}", "exposure"
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return positions.exposure_stats(research_daily(lab), lab.hold("research"), list(exp.STRATEGY))


@query(
    "strategy_table",
    PNL.extend({**o.stats("fee_flows", CELLS, S), **o.exposure("fee_flows", "hold_research", CELLS)})
    .add("full_stats", f"SELECT * FROM stats JOIN exposure USING ({CELLS})")
    .select(f"{CELLS}, {o.STATS}, {o.EXPOSURE}", "full_stats"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.strategy_table(lab, research_daily(lab), "research")


PORTFOLIO_MEANS = """avg(gross) AS gross, avg(fees) AS fees, avg(funding) AS funding, avg(net) AS net,
    avg(turnover) AS turnover"""
PORTFOLIO = PNL.add(
    "portfolio", f"SELECT rule, delay, fee, day, {PORTFOLIO_MEANS} FROM fee_flows GROUP BY ALL"
).extend(o.stats("portfolio", "rule, delay, fee", S))


@query("portfolio_table", PORTFOLIO.select(f"rule, delay, fee, {o.STATS}", "stats"))
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.portfolio_table(lab, research_daily(lab))


@query(
    "choose_rule",
    PORTFOLIO.sql("""SELECT rule FROM stats WHERE fee = 'taker' AND delay = 0 AND sharpe IS NOT NULL
        ORDER BY round(sharpe, 9) DESC, list_position(['median', 'outer30', 'outer10'], rule) LIMIT 1"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.choose_rule(exp.portfolio_table(lab, research_daily(lab)), RULE_NAMES)


def pivot_curves(q: o.Query, names, source: str) -> str:
    cells = ", ".join(f"round(max(s) FILTER (curve = '{n}'), 6) + 0.0 AS {n}" for n in names)
    q = q.add(
        "running",
        f"SELECT curve, day, sum(v) OVER (PARTITION BY curve ORDER BY day) AS s FROM {source}",
    )
    return q.sql(f"SELECT day, {cells} FROM running GROUP BY day")


EQUITY_NAMES = [f"{c}_{k}" for c in COINS for k in ("strategy", "buy_and_hold")]


@query(
    "equity_curves",
    pivot_curves(
        PNL.add(
            "curves",
            """SELECT coin || '_strategy' AS curve, day, net AS v FROM fee_flows
            WHERE rule = 'outer30' AND fee = 'taker' AND delay = 0 UNION ALL
            SELECT coin || '_buy_and_hold', day, hold FROM hold_research UNION ALL
            SELECT 'portfolio_strategy', day, avg(net) FROM fee_flows
            WHERE rule = 'outer30' AND fee = 'taker' AND delay = 0 GROUP BY day""",
        ),
        [*EQUITY_NAMES, "portfolio_strategy"],
        "curves",
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    net = exp.taker_net(research_daily(lab), "outer30")
    return positions.equity_curves(net, lab.hold("research"), COINS)


@query(
    "pnl_correlation",
    matrix_sql(PNL, "fee_flows", "net", "rule = 'outer30' AND fee = 'taker' AND delay = 0"),
)
def _(spark, folder):
    net = exp.taker_net(research_daily(lines_lab(spark, folder)), "outer30")
    return scoring.daily_correlation(net, COINS, "net")


# gated and sized versions

GATE_RULE = "outer30"


BOTH = tuple(PERIODS)


def gated() -> o.Query:
    """``gate_bars`` per version, fee and period, and ``gate_flows`` per day."""
    q = FEATURES
    for p in BOTH:
        q = momentum(p, horizons=(2,), tag=f"_d_{p}", base=q)
    q = o.volatility(q, S, (2,))
    for p in BOTH:
        q = har(p, (2,), f"_v_{p}", q)
        priced = BARS.extend(o.period_bars(S, p, FUNDING))
        q = q.extend({k: v for k, v in priced.parts.items() if k not in q.parts})
    fees = ", ".join(f"('{n}', {b})" for n, b in S.fees_bps)
    versions = ", ".join(f"('{v}')" for v in VERSIONS)
    k = EDGE_PER_UNIT_IC[GATE_RULE]
    key = "coin, version, fee, period"

    def opens(p: str) -> str:
        return f"""SELECT m.coin, m.pos, m.open_time, m.bar_return, m.rate, version, fee, bps, '{p}' AS period,
                coalesce({o.rule_case(GATE_RULE)}, 0) AS signal,
                coalesce({k} * d.valid_ic * exp(v.vpred) >= 2 * bps / 1e4, false) AS is_open,
                CASE WHEN v.vpred IS NOT NULL THEN least(exp(v.vmid - v.vpred), {SIZE_CAP}) END AS size
                FROM moves_{p} m
                LEFT JOIN predictions_d_{p} d ON d.coin = m.coin AND d.pos = m.pos
                LEFT JOIN (SELECT coin, pos, pred AS vpred, q50 AS vmid FROM predictions_v_{p}) v
                ON v.coin = m.coin AND v.pos = m.pos
                CROSS JOIN (VALUES {versions}) a(version) CROSS JOIN (VALUES {fees}) b(fee, bps)"""

    return q.extend(
        {
            "opens": " UNION ALL ".join(map(opens, BOTH)),
            "scaled": """SELECT *, CASE version WHEN 'base' THEN 1.0 WHEN 'gated' THEN
                CASE WHEN is_open THEN 1.0 ELSE 0.0 END ELSE CASE WHEN is_open THEN size ELSE 0.0 END
                END AS scale FROM opens""",
            "gate_positions": f"""SELECT *, coalesce(sum(coalesce(signal * scale, 0.0)) OVER (PARTITION BY {key}
                ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0.0) / 2 AS position FROM scaled""",
            "gate_bars": f"""SELECT *, coalesce(lag(position) OVER q, 0.0) AS held,
                abs(position - coalesce(lag(position) OVER q, 0.0)) + CASE WHEN lead(pos) OVER q IS NULL
                THEN abs(position) ELSE 0 END AS turnover FROM gate_positions
                WINDOW q AS (PARTITION BY {key} ORDER BY pos)""",
            "gate_sums": """SELECT coin, version, fee, bps, period, open_time::DATE AS day,
                sum(held * bar_return) AS gross, sum(held * rate) AS funding, sum(turnover) AS turnover,
                count(*) AS bars, count(*) FILTER (position <> 0) AS open_bars,
                sum(greatest(position, 0.0)) AS long_exposure, sum(abs(position)) AS exposure,
                count(*) FILTER (signal <> 0) AS signalled,
                count(*) FILTER (signal <> 0 AND scale > 0) AS opened,
                sum(scale) FILTER (signal <> 0 AND scale > 0) AS opened_size FROM gate_bars GROUP BY ALL""",
            "gate_flows": """SELECT *, bps / 1e4 * turnover AS fees,
                gross - bps / 1e4 * turnover - funding AS net FROM gate_sums""",
            "hold_both": " UNION ALL ".join(f"SELECT * FROM hold_{p}" for p in BOTH),
        }
    )


GATED = gated()
GATE_KEYS = "coin, version, fee, period"


def gated_bars(lab):
    study = S.with_changes(horizons=(2,))
    return exp.union(
        [
            gating.version_bars(
                lab.predictions("momentum", period=p, horizons=(2,)),
                lab.volatility_predictions("har", p, (2,)),
                lab.period_bars(p),
                ["coin", "horizon"],
                study,
                GATE_RULE,
            ).withColumn("period", F.lit(p))
            for p in BOTH
        ]
    )


def gated_daily(lab):
    return exp.gated_daily(lab, 2, "momentum", GATE_RULE)


@query("version_bars", GATED.select(f"{GATE_KEYS}, pos, signal, ~scale, ~position, ~turnover", "gate_bars"))
def _(spark, folder):
    rows = gated_bars(lines_lab(spark, folder))
    return rows.select("coin", "version", "fee", "period", "pos", "signal", "scale", "position", "turnover")


@query("version_daily", GATED.select(f"{GATE_KEYS}, day, {FLOW_COLUMNS}, opened, signalled", "gate_flows"))
def _(spark, folder):
    daily = gated_daily(lines_lab(spark, folder))
    return daily.select("coin", "version", "fee", "period", "day", *positions.FLOWS, "opened", "signalled")


GATE_STATS = GATED.extend(
    {
        **o.stats("gate_flows", GATE_KEYS, S),
        **o.exposure("gate_flows", "hold_both", GATE_KEYS),
        "shares": f"""SELECT {GATE_KEYS}, sum(opened)::DOUBLE / nullif(sum(signalled), 0) AS gate_share,
            sum(opened_size) / nullif(sum(opened), 0) AS mean_size FROM gate_flows GROUP BY ALL""",
        "all_stats": f"""SELECT * FROM stats JOIN exposure USING ({GATE_KEYS})
            JOIN shares USING ({GATE_KEYS})""",
    }
)


@query(
    "version_stats",
    GATE_STATS.select(
        f"{GATE_KEYS}, {o.STATS}, {o.EXPOSURE}, ~gate_share, ~mean_size", "all_stats"
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.gated_strategy(lab, gated_daily(lab))


MONTH_GATE = GATED.add(
    "gate_months",
    """SELECT coin, fee, period, strftime(day, '%Y-%m') AS month,
    sum(opened)::DOUBLE / nullif(sum(signalled), 0) AS gate_share,
    sum(opened_size) / nullif(sum(opened), 0) AS mean_size, FROM gate_flows WHERE version = 'sized' GROUP BY ALL""",
).add(
    "gate_table",
    "SELECT g.*, valid_ic FROM gate_months g LEFT JOIN ("
    + " UNION ALL ".join(
        f"""SELECT coin, '{p}' AS period, test_month AS month, any_value(valid_ic) AS valid_ic
        FROM predictions_d_{p} GROUP BY ALL"""
        for p in BOTH
    )
    + ") USING (coin, period, month)",
)


def month_gate(lab):
    return exp.gated_months(lab, gated_daily(lab), 2, "momentum")


@query("monthly_gate", MONTH_GATE.select("coin, fee, period, month, ~valid_ic, ~gate_share, ~mean_size", "gate_table"))
def _(spark, folder):
    return month_gate(lines_lab(spark, folder))


@query(
    "gate_text",
    MONTH_GATE.sql("""SELECT coin, fee, period, month, CASE WHEN valid_ic IS NULL THEN 'no IC'
        WHEN valid_ic <= 0 THEN 'IC ≤ 0' ELSE round_even(gate_share * 100, 0)::INT || '%' END AS label
        FROM gate_table"""),
)
def _(spark, folder):
    return month_gate(lines_lab(spark, folder)).select(
        "coin", "fee", "period", "month", gating.gate_text().alias("label")
    )


GATE_PORTFOLIO = GATED.add(
    "portfolio",
    f"SELECT version, fee, period, day, {PORTFOLIO_MEANS} FROM gate_flows GROUP BY ALL",
).extend(o.stats("portfolio", "version, fee, period", S))


@query("gated_portfolio", GATE_PORTFOLIO.select(f"version, fee, period, {o.STATS}", "stats"))
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.gated_portfolio(lab, gated_daily(lab))


@query(
    "choose_version",
    GATE_PORTFOLIO.sql("""SELECT version FROM stats WHERE fee = 'taker' AND period = 'research' AND sharpe IS NOT NULL
        ORDER BY round(sharpe, 9) DESC, list_position(['base', 'gated', 'sized'], version) LIMIT 1"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.choose_version(exp.gated_portfolio(lab, gated_daily(lab)), VERSIONS)


@query(
    "gated_equity",
    pivot_curves(
        GATED.add(
            "curves",
            """SELECT coin || '_' || version AS curve, day, net AS v FROM gate_flows WHERE fee = 'taker'
            UNION ALL SELECT 'portfolio_' || version, day, avg(net) FROM gate_flows WHERE fee = 'taker'
            GROUP BY version, day""",
        ),
        [f"{c}_{v}" for v in VERSIONS for c in (*COINS, "portfolio")],
        "curves",
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.gated_equity(lab, gated_daily(lab))


@query(
    "coins_and_portfolio",
    GATE_STATS.extend(
        {
            "portfolio": f"SELECT version, fee, period, day, {PORTFOLIO_MEANS} FROM gate_flows GROUP BY ALL",
            **o.stats("portfolio", "version, fee, period", S, "_p"),
        }
    ).sql("""SELECT coin, version, period, round(sharpe, 6) + 0.0 AS sharpe, round(sharpe_low, 6) + 0.0 AS sharpe_low,
        round(sharpe_high, 6) + 0.0 AS sharpe_high FROM (SELECT coin, version, fee, period, sharpe, sharpe_low, sharpe_high
        FROM stats UNION ALL SELECT 'portfolio', version, fee, period, sharpe, sharpe_low, sharpe_high FROM stats_p)
        WHERE fee = 'taker'"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    daily = gated_daily(lab)
    rows = exp.coins_and_portfolio(
        exp.gated_strategy(lab, daily), exp.gated_portfolio(lab, daily)
    )
    return rows.select("coin", "version", "period", "sharpe", "sharpe_low", "sharpe_high")


# ---------------------------------------------------------------- H: decisions

SIGMA_PARTS = {
    "logs": f"""SELECT asset, pos, open_time, ln(close) AS l FROM bars
        WHERE asset IN ({", ".join(f"'{c}'" for c in COINS)}) AND open_time >= TIMESTAMP '{S.train_start}'
        AND open_time < TIMESTAMP '{S.research_months[0]}-01'""",
    "ahead": " UNION ALL ".join(
        f"""SELECT asset AS coin, {h} AS horizon, lead(l, {h}) OVER (PARTITION BY asset ORDER BY pos) - l AS f,
        open_time AS t, open_time + INTERVAL {h} DAY AS e FROM logs"""
        for h in S.horizons
    ),
    "sigma": f"""SELECT coin, horizon, stddev_samp(f) AS sigma FROM ahead
        WHERE NOT (e >= TIMESTAMP '{S.event_window[0]}' AND t < TIMESTAMP '{S.event_window[1]}')
        GROUP BY ALL""",
}


def configurations() -> o.Query:
    q = SWEEP_DAILY.extend({k: v for k, v in PRICED.parts.items() if k not in SWEEP_DAILY.parts})
    q = q.extend(o.strategy("frames", S, "research", ("median",), (0,), CONFIG, S.horizons))
    q = q.extend(o.summary("daily", CONFIG, "ic", S))
    return q.extend(
        {
            "sides": f"SELECT *, {o.rule_case('median')} * fwd_logret AS p FROM frames",
            "rates": f"""SELECT {CONFIG}, count(*) FILTER (p > 0)::DOUBLE /
                nullif(count(*) FILTER (p IS NULL OR p <> 0), 0) AS hit_rate,
                1 - sum((y - pred) ** 2) / sum(y ** 2) AS oos_r2 FROM sides GROUP BY ALL""",
            "sums": f"""SELECT {CONFIG}, sum(gross) AS gross, sum(funding) AS funding,
                sum(turnover) AS turnover, (sum(gross) - sum(funding)) / nullif(sum(turnover), 0) * 1e4
                AS breakeven_bps FROM flows GROUP BY ALL""",
            "configurations": f"""SELECT *, coalesce(t >= 3.2, false) AS detected FROM summary
                JOIN rates USING ({CONFIG}) JOIN sums USING ({CONFIG})""",
        }
    )


CONFIGURATIONS = configurations()
RECIPES = pooled_summary(CONFIGURATIONS, "horizon, family").add(
    "recipes",
    """SELECT p.*, breakeven_bps, coalesce(t >= 3.0, false) AS detected FROM summary_pooled p
    JOIN (SELECT horizon, family, (sum(gross) - sum(funding)) / nullif(sum(turnover), 0) * 1e4 AS breakeven_bps
    FROM configurations GROUP BY ALL) USING (horizon, family)""",
)
FAMILY_ORDER = f"list_position([{', '.join(repr(f) for f in FAMILIES)}], family)"
HORIZON_ORDER = f"list_position([{', '.join(str(h) for h in S.horizons)}], horizon)"


@query(
    "sweep_configurations",
    CONFIGURATIONS.select(
        f"{CONFIG}, {SUMMARY}, ~hit_rate, ~oos_r2, ~gross, ~funding, ~turnover, ~breakeven_bps, detected",
        "configurations",
    ),
)
def _(spark, folder):
    return exp.sweep_configurations(lines_lab(spark, folder), SWEEP_FAMILIES)


@query(
    "sweep_pooled",
    RECIPES.select(f"horizon, family, {SUMMARY}, ~breakeven_bps, detected", "recipes"),
)
def _(spark, folder):
    return exp.sweep_pooled(lines_lab(spark, folder), SWEEP_FAMILIES)


@query(
    "choose_recipe",
    RECIPES.sql(f"""SELECT horizon, family, detected FROM recipes ORDER BY detected DESC,
        round(CASE WHEN detected THEN breakeven_bps ELSE t END, 9) DESC NULLS LAST, {HORIZON_ORDER}, {FAMILY_ORDER} LIMIT 1"""),
)
def _(spark, folder):
    pooled = exp.sweep_pooled(lines_lab(spark, folder), SWEEP_FAMILIES)
    return decisions.choose_recipe(pooled, S).select("horizon", "family", "detected")


PER_COIN_BEST = f"""SELECT coin, horizon, family, t FROM configurations QUALIFY row_number() OVER
    (PARTITION BY coin ORDER BY round(t, 9) DESC NULLS LAST, {HORIZON_ORDER}, {FAMILY_ORDER}) = 1"""


@query(
    "best_per_coin",
    CONFIGURATIONS.add("best_rows", PER_COIN_BEST).select("coin, horizon, family, ~t", "best_rows"),
)
def _(spark, folder):
    table = exp.sweep_configurations(lines_lab(spark, folder), SWEEP_FAMILIES)
    return decisions.best_per_coin(table, S)


@query(
    "needed_ic",
    MOM_DAILY.extend(SIGMA_PARTS).sql("""SELECT coin, horizon, round(sigma * 1e4, 6) + 0.0 AS sigma_bps,
        round(10.0 / (1.755 * sigma * 1e4), 6) + 0.0 AS needed_ic_taker,
        round(4.0 / (1.755 * sigma * 1e4), 6) + 0.0 AS needed_ic_maker,
        round(ic, 6) + 0.0 AS research_ic FROM sigma LEFT JOIN
        (SELECT coin, horizon, avg(ic) AS ic FROM daily GROUP BY ALL) USING (coin, horizon)"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    ic = momentum_daily(lab).groupBy("coin", "horizon").agg(F.avg("ic").alias("research_ic"))
    return decisions.needed_ic_table(lab.sigma, ic, S)


@query(
    "detectability",
    RECIPES.extend(SIGMA_PARTS).sql(
        """SELECT horizon, round(max(ic), 6) + 0.0 AS best_pooled_ic,
        round(3.0 * sqrt(horizon / 1.0) / sqrt(181), 6) + 0.0 AS detectable_ic, """
        + ", ".join(f"any_value(needed_ic_{c}) AS needed_ic_{c}" for c in COINS)
        + " FROM recipes JOIN (SELECT horizon, "
        + ", ".join(
            f"round(10.0 / (1.755 * max(sigma) FILTER (coin = '{c}') * 1e4), 6) + 0.0 AS needed_ic_{c}"
            for c in COINS
        )
        + " FROM sigma GROUP BY horizon) USING (horizon) GROUP BY horizon"
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.detectability_table(exp.sweep_pooled(lab, SWEEP_FAMILIES), lab.sigma, S)


@query(
    "settings_table",
    SWEEP.sql("""SELECT coin, horizon, family, test_month AS month, arg_min(setting, pos) AS setting
        FROM frames GROUP BY ALL"""),
)
def _(spark, folder):
    frame = exp.sweep_frame(lines_lab(spark, folder), SWEEP_FAMILIES)
    return decisions.settings_table(frame, exp.CONFIGURATION)


def sources() -> o.Query:
    q = best(horizons=(2,), tag="_own", inputs=OWN, base=best(horizons=(2,), tag="_all"))
    for mine, other in (("all", "own"), ("own", "all")):
        q = q.add(
            f"shared_{mine}",
            f"""SELECT * FROM predictions_{mine} WHERE (coin, pos) IN
            (SELECT (coin, pos) FROM predictions_{other})""",
        ).extend(o.daily_ic(f"shared_{mine}", "coin", f"_{mine}"))
    return q.extend(
        {
            "gap": """SELECT coin, day, a.ic - b.ic AS ic FROM daily_all a JOIN daily_own b USING (coin, day)""",
            **o.summary("gap", "coin", "ic", S),
            "day_closes": f"""SELECT asset, open_time::DATE AS day, arg_max(close, pos) FILTER (close IS NOT NULL)
                AS close FROM bars WHERE open_time >= TIMESTAMP '{S.train_start}'
                AND open_time < TIMESTAMP '{S.research_months[0]}-01' GROUP BY ALL""",
            "day_returns": """SELECT asset, day, close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1
                AS ret FROM day_closes""",
            "market": f"""SELECT c.asset AS coin, corr(c.ret, b.ret) AS benchmark_correlation
                FROM day_returns c JOIN day_returns b ON b.day = c.day AND b.asset = '{S.benchmark}'
                WHERE c.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1""",
            "sources": """SELECT coin, ic_all, ic_own, s.ic AS gain, s.t AS gain_t, benchmark_correlation FROM
                (SELECT coin, avg(ic) AS ic_all FROM daily_all GROUP BY coin) JOIN
                (SELECT coin, avg(ic) AS ic_own FROM daily_own GROUP BY coin) USING (coin)
                JOIN summary s USING (coin) LEFT JOIN market USING (coin)""",
            "gap_day": "SELECT 1 AS one, day, avg(-ic) AS ic FROM gap GROUP BY day",
            **o.summary("gap_day", "one", "ic", S, "_day"),
        }
    )


SOURCES = sources()


@query(
    "sources_table",
    SOURCES.select("coin, ~ic_all, ~ic_own, ~gain, ~gain_t, ~benchmark_correlation", "sources"),
)
def _(spark, folder):
    from tapegrid.operators.returns import benchmark_correlation

    lab = lines_lab(spark, folder)
    daily_all, daily_own = exp.source_dailies(lab, 2, "best_feature")
    return decisions.sources_table(daily_all, daily_own, benchmark_correlation(lab.grid, S), S)


@query(
    "choose_inputs",
    SOURCES.sql("""SELECT CASE WHEN coalesce(t >= 2.0, false) THEN 'own' ELSE 'all' END AS inputs,
        round(ic, 6) + 0.0 AS own_minus_all, round(t, 6) + 0.0 AS t FROM summary_day"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    daily_all, daily_own = exp.source_dailies(lab, 2, "best_feature")
    return decisions.choose_inputs(scoring.pooled_ic_difference(daily_own, daily_all, [], S))


def retraining() -> o.Query:
    q = FEATURES
    parts = {}
    for p in POLICIES:
        q = momentum(policy=p, horizons=(2,), tag=f"_{p}", base=q)
        parts[f"predictions_{p}"] = f"'{p}' AS policy"
    q = stacked(q, "frames", parts).extend(o.daily_ic("frames", "coin, policy"))
    return q.extend(
        {
            **o.summary("daily", "coin, policy", "ic", S),
            "by_month": """SELECT coin, policy, strftime(day, '%Y-%m') AS month, avg(ic) AS ic
                FROM daily GROUP BY ALL""",
            "gains": """SELECT a.policy, day, avg(a.ic - b.ic) AS ic FROM daily a JOIN daily b USING (coin, day)
                WHERE a.policy <> 'expanding' AND b.policy = 'expanding' GROUP BY ALL""",
            **o.summary("gains", "policy", "ic", S, "_gain"),
        }
    )


RETRAINING = retraining()


@query("retraining_table", RETRAINING.select(f"coin, policy, {SUMMARY}", "summary"))
def _(spark, folder):
    daily = exp.retraining_daily(lines_lab(spark, folder), 2, "momentum")
    return scoring.ic_summary(daily, ["coin", "policy"], S)


MONTH_PLACE = f"list_position([{', '.join(repr(m) for m in S.research_months)}], month)::INT"


def monthly_retraining(lab):
    daily = exp.retraining_daily(lab, 2, "momentum")
    return decisions.retraining_by_month(scoring.ic_by_month(daily, ["coin", "policy"]), S)


@query(
    "retraining_by_month",
    RETRAINING.sql(f"""SELECT coin, policy, month, {MONTH_PLACE} AS research_month, round(ic, 6) + 0.0 AS ic
        FROM by_month"""),
)
def _(spark, folder):
    return monthly_retraining(lines_lab(spark, folder))


@query(
    "decay_table",
    RETRAINING.sql(
        f"SELECT {MONTH_PLACE} AS research_month, "
        + ", ".join(
            f"round(max(ic) FILTER (coin = '{c}' AND policy = 'fixed'), 6) + 0.0 AS {c}" for c in COINS
        )
        + """, round(avg(ic) FILTER (policy = 'expanding'), 6) + 0.0 AS expanding_mean
        FROM by_month GROUP BY month"""
    ),
)
def _(spark, folder):
    return scoring.decay_table(monthly_retraining(lines_lab(spark, folder)), COINS)


@query("retraining_challengers", RETRAINING.select(f"policy, {SUMMARY}", "summary_gain"))
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.retraining_challengers(lab, exp.retraining_daily(lab, 2, "momentum"))


@query(
    "choose_policy",
    RETRAINING.sql("""SELECT coalesce(arg_max(policy, t) FILTER (t >= 2.0), 'expanding') AS policy
        FROM summary_gain"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.choose_policy(
        exp.retraining_challengers(lab, exp.retraining_daily(lab, 2, "momentum"))
    )


def two_periods() -> o.Query:
    q = FEATURES
    for p in ("research", "forward"):
        q = momentum(p, horizons=(2,), tag=f"_{p}", base=q).extend(
            o.daily_ic(f"predictions_{p}", "coin", f"_{p}")
        )
        q = q.add(
            f"both_{p}",
            f"""SELECT coin, day, ic FROM daily_{p} UNION ALL SELECT 'pooled', day, avg(ic)
            FROM daily_{p} GROUP BY day""",
        ).extend(o.summary(f"both_{p}", "coin", "ic", S, f"_{p}"))
    return q


TWO = two_periods()


@query(
    "forward_table",
    TWO.sql("""SELECT coin, round(r.ic, 6) + 0.0 AS research_ic, round(r.se, 6) + 0.0 AS research_se,
        round(f.ic, 6) + 0.0 AS forward_ic, round(f.se, 6) + 0.0 AS forward_se, round(f.t, 6) + 0.0 AS forward_t,
        sign(r.ic) = sign(f.ic) AND abs(f.ic - r.ic) < 1.96 * sqrt(r.se ** 2 + f.se ** 2) AS consistent
        FROM summary_research r LEFT JOIN summary_forward f USING (coin)"""),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.forward_table(
        exp.forward_daily(lab, 2, "momentum", "research"),
        exp.forward_daily(lab, 2, "momentum", "forward"),
        S,
    )


FORWARD_SWEEP = both_families("forward").extend(o.daily_ic("frames", CONFIG))


@query(
    "context_table",
    FORWARD_SWEEP.extend(o.summary("daily", CONFIG, "ic", S)).select(f"{CONFIG}, {SUMMARY}", "summary"),
)
def _(spark, folder):
    daily = exp.sweep_daily(lines_lab(spark, folder), SWEEP_FAMILIES, "forward")
    return scoring.ic_summary(daily, list(exp.CONFIGURATION), S)


def shrinkage_sql() -> str:
    q = CONFIGURATIONS.add("best_rows", PER_COIN_BEST)
    later = FORWARD_SWEEP.parts
    renamed = {}
    own = [n for n in later if n not in FEATURES.parts]
    for name in own:
        body = later[name]
        for other in own:
            body = re.sub(rf"(?<![\w.']){re.escape(other)}(?![\w'])", f"{other}_later", body)
        renamed[f"{name}_later"] = body
    return q.extend(renamed).sql(
        """SELECT coin, horizon, family, round(r.ic, 6) + 0.0 AS research_ic,
        round(f.ic, 6) + 0.0 AS forward_ic FROM best_rows
        LEFT JOIN (SELECT coin, horizon, family, avg(ic) AS ic FROM daily GROUP BY ALL) r
        USING (coin, horizon, family) LEFT JOIN (SELECT coin, horizon, family, avg(ic) AS ic
        FROM daily_later GROUP BY ALL) f USING (coin, horizon, family)"""
    )


@query("shrinkage_table", shrinkage_sql())
def _(spark, folder):
    lab = lines_lab(spark, folder)
    daily = exp.union(
        [
            exp.sweep_daily(lab, SWEEP_FAMILIES, p).withColumn("period", F.lit(p))
            for p in ("research", "forward")
        ]
    )
    best_rows = decisions.best_per_coin(exp.sweep_configurations(lab, SWEEP_FAMILIES), S)
    return decisions.shrinkage_table(best_rows, daily)


GAINS = PAIRED.extend(SIGMA_PARTS).extend(
    {
        "gap_both": """SELECT coin, horizon, day, ic FROM gap UNION ALL SELECT 'pooled', horizon, day, avg(ic)
            FROM gap GROUP BY horizon, day""",
        **o.summary("gap_both", KEYS, "ic", S),
        "gains": """SELECT coin, horizon, ic AS gain, se, t, sigma * 1e4 AS sigma_bps FROM summary
            LEFT JOIN sigma USING (coin, horizon)""",
    }
)


def family_gains(spark, folder):
    lab = lines_lab(spark, folder)
    return decisions.gain_table(*family_pair(spark, folder), lab.sigma, ["horizon"], S)


@query("gain_table", GAINS.select("coin, horizon, ~gain, ~se, ~t, ~sigma_bps", "gains"))
def _(spark, folder):
    return family_gains(spark, folder)


@query(
    "choose_models",
    GAINS.sql("""SELECT horizon, CASE WHEN coalesce(t >= 2.0, false) THEN 'best_feature' ELSE 'momentum' END
        AS model, round(gain, 6) + 0.0 AS gain, round(t, 6) + 0.0 AS t FROM gains WHERE coin = 'pooled'"""),
)
def _(spark, folder):
    gains = family_gains(spark, folder).withColumn("period", F.lit("research"))
    return decisions.choose_models(gains, "best_feature", "momentum")


@query(
    "comparison_table",
    GAINS.add(
        "all_days",
        """SELECT coin, horizon, family, day, ic FROM daily UNION ALL SELECT 'pooled', horizon, family, day,
        avg(ic) FROM daily GROUP BY horizon, family, day""",
    ).sql("""SELECT coin, horizon, round(avg(d.ic) FILTER (family = 'best_feature'), 6) + 0.0 AS pooled_model_ic,
        round(avg(d.ic) FILTER (family = 'momentum'), 6) + 0.0 AS per_coin_ic,
        round(any_value(gain), 6) + 0.0 AS diff, round(any_value(se), 6) + 0.0 AS se,
        round(any_value(t), 6) + 0.0 AS t, round(any_value(sigma_bps), 6) + 0.0 AS sigma_bps
        FROM all_days d JOIN gains USING (coin, horizon) GROUP BY coin, horizon"""),
)
def _(spark, folder):
    """The one-model comparison, with one-input families in both places."""
    lab = lines_lab(spark, folder)
    return decisions.comparison_table(*family_pair(spark, folder), lab.sigma, ["horizon"], S)


# A record as a user would freeze it after the research period.
FROZEN_RECORD = {"horizon": 2, "family": "momentum", "inputs": "all", "policy": "expanding", "rule": "outer10"}
CHOICES = {
    "recipe": RECIPES.sql(
        f"""SELECT horizon, family FROM recipes ORDER BY detected DESC,
        round(CASE WHEN detected THEN breakeven_bps ELSE t END, 9) DESC NULLS LAST,
        {HORIZON_ORDER}, {FAMILY_ORDER} LIMIT 1"""
    ),
    "inputs": ORACLES["choose_inputs"],
    "policy": ORACLES["choose_policy"],
    "rule": ORACLES["choose_rule"],
}


def frozen_sql() -> str:
    same = " AND ".join(
        f"{c} = {v}" if isinstance(v, int) else f"{c} = '{v}'" for c, v in FROZEN_RECORD.items()
    )
    sources = ", ".join(f"({text}) AS {name}" for name, text in CHOICES.items())
    return f"""SELECT horizon, family, inputs, policy, rule,
        CASE WHEN family IN ('momentum', 'best_feature') THEN 'ridge' ELSE family END AS fitted_family,
        coalesce({same}, false) AS as_frozen FROM {sources}"""


@query("chosen_configuration", frozen_sql())
def _(spark, folder):
    """The choices of all steps, the family inputs are compared with, and the frozen-record check."""
    lab = lines_lab(spark, folder)
    recipe = decisions.choose_recipe(exp.sweep_pooled(lab, SWEEP_FAMILIES), S)
    daily_all, daily_own = exp.source_dailies(lab, 2, "best_feature")
    inputs = decisions.choose_inputs(scoring.pooled_ic_difference(daily_own, daily_all, [], S))
    policy = decisions.choose_policy(
        exp.retraining_challengers(lab, exp.retraining_daily(lab, 2, "momentum"))
    )
    rule = decisions.choose_rule(exp.portfolio_table(lab, research_daily(lab)), RULE_NAMES)
    chosen = settle(decisions.chosen_configuration(recipe, inputs, policy, rule))
    same = decisions.differences_from_frozen(chosen, FROZEN_RECORD).isEmpty()
    return chosen.select(
        "horizon",
        "family",
        "inputs",
        "policy",
        "rule",
        decisions.fitted_family(F.col("family")).alias("fitted_family"),
        F.lit(same).alias("as_frozen"),
    )


@query(
    "forward_audit",
    BARS.extend(o.extreme(S))
    .extend(o.AUDIT)
    .sql(f"SELECT * FROM audit WHERE month >= '{S.forward_months[0]}'"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return gridding.forward_audit(lab.raw, S)


# ---------------------------------------------------------------- K: volatility and forward tables

VOL_ALL = stacked(
    har("forward", tag="_f", base=har(tag="_r")),
    "vol_frames",
    {
        "volatilities_r": "'har' AS model, 'research' AS period",
        "volatilities_f": "'har' AS model, 'forward' AS period",
    },
)
VOL_KEYS = "coin, horizon, model, period"
VOL_DAILY = VOL_ALL.extend(o.daily_ic("vol_frames", VOL_KEYS))


@query(
    "volatility_table",
    VOL_DAILY.extend(
        {
            **o.summary("daily", VOL_KEYS, "ic", S),
            "errors": f"""SELECT {VOL_KEYS}, 1 - sum((y - pred) ** 2) / sum((y - train_mean) ** 2) AS oos_r2
                FROM vol_frames GROUP BY ALL""",
            "table_rows": f"SELECT * FROM summary JOIN errors USING ({VOL_KEYS})",
        }
    ).select(f"{VOL_KEYS}, {SUMMARY}, ~oos_r2", "table_rows"),
)
def _(spark, folder):
    return exp.volatility_table(lines_lab(spark, folder))


@query(
    "volatility_pooled",
    pooled_summary(VOL_DAILY, "horizon, model, period").select(
        f"horizon, model, period, {SUMMARY}", "summary_pooled"
    ),
)
def _(spark, folder):
    daily = exp.volatility_daily(lines_lab(spark, folder))
    return scoring.pooled_ic_summary(daily, ["horizon", "model", "period"], S)


@query(
    "volatility_ic_by_month",
    VOL_DAILY.sql(f"""SELECT {VOL_KEYS}, strftime(day, '%Y-%m') AS month, round(avg(ic), 6) + 0.0 AS ic
        FROM daily GROUP BY ALL"""),
)
def _(spark, folder):
    return scoring.ic_by_month(exp.volatility_daily(lines_lab(spark, folder)), exp.VOLATILITY)


FORWARD_PNL = momentum("forward", horizons=(2,))
FORWARD_PNL = FORWARD_PNL.extend(
    {
        k: v
        for k, v in BARS.extend(o.period_bars(S, "forward", FUNDING)).parts.items()
        if k not in FORWARD_PNL.parts
    }
)
FORWARD_PNL = FORWARD_PNL.extend(
    o.strategy("predictions", S, "forward", ("outer30",), (0,), KEYS, (2,))
).add("fee_flows", o.with_fees("flows", S))


def forward_strategy(lab):
    return exp.strategy_daily(lab, 2, "momentum", "forward", ("outer30",), (0,))


@query(
    "forward_equity",
    pivot_curves(
        FORWARD_PNL.add(
            "curves",
            """SELECT 'portfolio_' || fee AS curve, day, avg(net) AS v FROM fee_flows GROUP BY fee, day
            UNION ALL SELECT coin || '_taker', day, net FROM fee_flows WHERE fee = 'taker'""",
        ),
        ["portfolio_taker", "portfolio_maker", *[f"{c}_taker" for c in COINS]],
        "curves",
    ),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.forward_equity(lab, forward_strategy(lab), "outer30")


@query(
    "forward_economics",
    FORWARD_PNL.extend(
        {**o.stats("fee_flows", CELLS, S), **o.exposure("fee_flows", "hold_forward", CELLS)}
    )
    .add("full_stats", f"SELECT * FROM stats JOIN exposure USING ({CELLS})")
    .select(f"{CELLS}, {o.STATS}, {o.EXPOSURE}", "full_stats"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.strategy_table(lab, forward_strategy(lab), "forward")


@query(
    "forward_verdict",
    FORWARD_PNL.add(
        "portfolio", f"SELECT rule, delay, fee, day, {PORTFOLIO_MEANS} FROM fee_flows GROUP BY ALL"
    )
    .extend(o.stats("portfolio", "rule, delay, fee", S))
    .select(f"rule, delay, fee, {o.STATS}", "stats"),
)
def _(spark, folder):
    lab = lines_lab(spark, folder)
    return exp.portfolio_table(lab, forward_strategy(lab))


@query("pooled_model_comparison", None)
def _(spark, folder):
    """One ridge for all coins against one ridge each."""
    lab = lines_lab(spark, folder)
    pooled, single = exp.pooling_dailies(lab)
    return decisions.comparison_table(pooled, single, lab.sigma, ["horizon", "period"], S)


@query("pooled_settings", None)
def _(spark, folder):
    frame = lines_lab(spark, folder).pooled_predictions()
    return decisions.settings_table(frame.where(F.col("coin") == COINS[0]), ["horizon", "period"])
