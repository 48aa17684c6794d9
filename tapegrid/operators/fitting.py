"""Model fits as aggregations.

A fitted model is a row of a parameter table keyed by ``coin, horizon, window, role``, where role
``inner`` is fitted on the training rows and ``refit`` on training and validation rows. Least
squares is additive: sums are taken once per calendar month and windows add months, so an
expanding window repeats no row. Ridge and the best feature need scales and ranks per window: rows
carry a bit set of their windows instead of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapegrid.config import RIDGE_ALPHAS, RIDGE_CLIP, Study
from tapegrid.functions.columns import all_known, bar_position, moment, month_of, pick_column
from tapegrid.operators.blocks import masked_ranks
from tapegrid.operators.folds import (
    ROLES,
    Fold,
    distinct_windows,
    has_bit,
    role_mask,
    window_groups,
    window_rows,
)
from tapegrid.session import settle

MODEL_KEYS = ["coin", "horizon", "window"]
# Groups in which the vectors of one window are added first.
SALTS = 64


# ---------------------------------------------------------------- additive sums


def monthly_sums(
    rows: DataFrame, inputs: Sequence[str], study: Study, terms: dict[str, Column]
) -> DataFrame:
    """Sums of ``terms`` per coin, horizon and month over rows with every input and a label.

    ``tail`` rows are those whose label is still unknown when the month ends, and ``started``
    marks rows after the study's training start, which may fall inside a month.
    """
    return monthly_records(rows, inputs, study).agg(*[F.sum(c).alias(n) for n, c in terms.items()])


def monthly_records(rows: DataFrame, inputs: Sequence[str], study: Study) -> GroupedData:
    month_end = F.add_months(F.trunc("open_time", "month"), 1).cast("timestamp")
    tail = F.col("pos") + F.col("horizon") + 1 > bar_position(month_end, study.bar_seconds)
    return rows.where(all_known([*inputs, "y"])).groupBy(
        "coin",
        "horizon",
        month_of("open_time").alias("month"),
        (F.col("open_time") >= moment(study.train_start)).alias("started"),
        tail.alias("tail"),
    )


def window_sums(
    monthly: DataFrame, folds: Sequence[Fold], study: Study, terms: Sequence[str]
) -> DataFrame:
    """Monthly sums added up per window and role: ``coin, horizon, window, role, terms``."""
    return in_windows(monthly, folds, study).groupBy(*MODEL_KEYS, "role").agg(*[F.sum(t).alias(t) for t in terms])


def in_windows(monthly: DataFrame, folds: Sequence[Fold], study: Study) -> DataFrame:
    """The monthly records of each window and role."""
    entries = []
    for f in distinct_windows(folds):
        from_start = f.train_start == study.train_start
        last = F.add_months(F.to_date(moment(f.valid_start)), -1)
        entries.append(
            F.struct(
                F.lit(f.window).alias("window"),
                F.lit(f.train_start[:7]).alias("first_month"),
                F.lit(from_start).alias("from_start"),
                F.date_format(last, "yyyy-MM").alias("last_month"),
                F.lit(f.valid_start[:7]).alias("valid_month"),
            )
        )
    month, tail, started = F.col("month"), F.col("tail"), F.col("started")

    def in_train(w: Column) -> Column:
        opened = F.when(w.from_start, started).otherwise(month >= w.first_month)
        return opened & (month <= w.last_month) & ~(tail & (month == w.last_month))

    def in_valid(w: Column) -> Column:
        opened = F.when(w.from_start, started).otherwise(F.lit(True))
        return opened & (month == w.valid_month) & ~tail

    uses = F.array(*entries)
    inner = monthly.withColumn("role", F.lit("inner")).withColumn(
        "_w", F.explode(F.filter(uses, in_train))
    )
    refit = monthly.withColumn("role", F.lit("refit")).withColumn(
        "_w", F.explode(F.filter(uses, lambda w: in_train(w) | in_valid(w)))
    )
    return inner.unionByName(refit).withColumn("window", F.col("_w.window")).drop("_w")


def line_terms(x: Column, y: Column) -> dict[str, Column]:
    return {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}


def line_from_sums(sums: DataFrame) -> DataFrame:
    """Least-squares slope and intercept from five sums."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    slope = F.try_divide(n * F.col("sxy") - sx * sy, n * F.col("sxx") - sx * sx)
    return sums.withColumn("slope", slope).withColumn(
        "intercept", (sy - F.col("slope") * sx) / n
    )


def fit_line(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line per key with the built-in regression aggregates."""
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


# ---------------------------------------------------------------- one-input rules


@F.pandas_udf(T.StringType())
def slope_text(slope: pd.Series) -> pd.Series:
    return slope.map(lambda v: f"slope={v:+.3g}", na_action="ignore")


def fit_momentum(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Line on the asset's own trailing return over the horizon."""
    names = [f"x_trail_ret_{h}" for h in study.horizons]
    column = F.concat(F.lit("x_trail_ret_"), F.col("horizon"))
    x = pick_column(column, names)
    terms = line_terms(x, F.col("y"))
    monthly = monthly_sums(rows, [*inputs, *names], study, terms)
    lines = line_from_sums(window_sums(monthly, folds, study, list(terms)))
    return lines.select(
        *MODEL_KEYS,
        "role",
        column.alias("input"),
        "intercept",
        "slope",
        slope_text("slope").alias("setting"),
    )


def input_rank_correlations(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Spearman correlation of each input with the label, per window and role.

    A row carries the bit set of its windows and roles and stands in the sort of an input once: label
    ranks of all windows are found in one sort, joined back as an array, and summed per distinct value
    of the input, whose running counts per window give the ranks of the other side.
    """
    tables = [_rank_correlations(rows, group, inputs, study) for group in window_groups(folds)]
    return reduce(DataFrame.unionByName, tables)


def _rank_correlations(
    rows: DataFrame, windows: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    keys = ["coin", "horizon"]
    fits = [(f.window, role) for f in windows for role in ROLES]
    members = [has_bit(k) for k in range(len(fits))]
    fitting = rows.withColumn("_mask", role_mask(windows, inputs, study)).where("_mask <> 0")
    fitting = settle(fitting.select(*keys, "y", "_mask", *inputs))
    labels = masked_ranks(fitting.select(*keys, "y", "_mask"), keys, "y", members)
    ranked = fitting.join(labels.select(*keys, "y", F.col("z").alias("_zy")), [*keys, "y"])
    long = ranked.select(*keys, "_mask", "_zy", F.posexplode(F.array(*inputs)).alias("place", "x"))
    line = masked_ranks(long, [*keys, "place"], "x", members, [F.col("_zy")[k] for k in range(len(fits))])
    products = [
        (F.sum(F.col("z")[k] * F.col("sums")[k]) / F.max(F.col("n")[k])).alias(f"_p{k}") for k in range(len(fits))
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(window).alias("window"),
                F.lit(role).alias("role"),
                F.col(f"_p{k}").alias("spearman"),
                F.col(f"_n{k}").alias("n"),
            )
            for k, (window, role) in enumerate(fits)
        ]
    )
    sizes = [F.max(F.col("n")[k]).alias(f"_n{k}") for k in range(len(fits))]
    wide = line.groupBy(*keys, "place").agg(*products, *sizes)
    return wide.select(*keys, "place", F.explode(entries).alias("_e")).where("_e.n > 0").select(
        *keys,
        "_e.window",
        "_e.role",
        "place",
        F.array(*[F.lit(n) for n in inputs])[F.col("place")].alias("input"),
        "_e.spearman",
    )


def most_correlated_input(correlations: DataFrame) -> DataFrame:
    """Largest absolute correlation; ties go to the input listed first."""
    strength = F.round(F.abs("spearman"), 12)
    order = F.when(strength.isNotNull(), F.struct(strength, -F.col("place")))
    return correlations.groupBy(*MODEL_KEYS, "role").agg(F.max_by("input", order).alias("input"))


def fit_best_feature(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Line on the input that ranks the label best, chosen apart for each role."""
    chosen = most_correlated_input(input_rank_correlations(rows, folds, inputs, study))
    y = F.col("y")
    terms = {"n": F.lit(1.0), "sy": y}
    for i, name in enumerate(inputs):
        x = F.col(name)
        terms |= {f"sx_{i}": x, f"sxx_{i}": x * x, f"sxy_{i}": x * y}
    monthly = monthly_sums(rows, inputs, study, terms)
    wide = window_sums(monthly, folds, study, list(terms))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("input"),
                F.col(f"sx_{i}").alias("sx"),
                F.col(f"sxx_{i}").alias("sxx"),
                F.col(f"sxy_{i}").alias("sxy"),
            )
            for i, name in enumerate(inputs)
        ]
    )
    long = wide.select(*MODEL_KEYS, "role", "n", "sy", F.explode(entries).alias("_e")).select(
        *MODEL_KEYS, "role", "n", "sy", "_e.*"
    )
    lines = line_from_sums(long.join(chosen, [*MODEL_KEYS, "role", "input"]))
    return lines.select(
        *MODEL_KEYS, "role", "input", "intercept", "slope", F.col("input").alias("setting")
    )


def predict_line(inputs: Sequence[str]) -> Column:
    return F.col("intercept") + F.col("slope") * pick_column(F.col("input"), inputs)


# ---------------------------------------------------------------- least squares


def gram_terms(inputs: Sequence[str]) -> dict[str, Column]:
    """Products of ``1, inputs, y``: the upper triangle of the cross-product matrix."""
    columns = [F.lit(1.0), *[F.col(n) for n in inputs], F.col("y")]
    size = len(columns)
    return {
        f"g_{i}_{j}": columns[i] * columns[j] for i in range(size) for j in range(i, size)
    }


def unpack(cells: np.ndarray) -> np.ndarray:
    """Symmetric matrix from its upper triangle."""
    size = int((np.sqrt(8 * len(cells) + 1) - 1) / 2)
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = cells
    return matrix + np.triu(matrix, 1).T


def solve_centred(gram: np.ndarray, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and weights from the products of ``1, x, y``; ``alpha`` shrinks the weights."""
    n = gram[0, 0]
    means = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(means, means)
    square, cross = centred[:-1, :-1], centred[:-1, -1]
    if alpha:
        weights = np.linalg.solve(square + alpha * np.eye(len(square)), cross)
    else:
        weights = np.linalg.lstsq(square, cross, rcond=None)[0]
    return float(means[-1] - means[:-1] @ weights), weights


LINEAR = T.StructType(
    [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("setting", T.StringType()),
    ]
)


@F.pandas_udf(LINEAR)
def solve_least_squares(cells: pd.Series) -> pd.DataFrame:
    solved = [solve_centred(unpack(np.asarray(c, dtype=float))) for c in cells]
    return pd.DataFrame(
        {
            "intercept": [a for a, _ in solved],
            "weights": [w for _, w in solved],
            "setting": ["slopes=" + ",".join(f"{v:.2f}" for v in w) for _, w in solved],
        }
    )


def fit_least_squares(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Linear model with intercept from monthly sums."""
    terms = gram_terms(inputs)
    sums = window_sums(monthly_sums(rows, inputs, study, terms), folds, study, list(terms))
    model = solve_least_squares(F.array(*[F.col(t) for t in terms]))
    return sums.select(*MODEL_KEYS, "role", model.alias("_m")).select(*MODEL_KEYS, "role", "_m.*")


def predict_linear(inputs: Sequence[str]) -> Column:
    total = F.col("intercept")
    for i, name in enumerate(inputs):
        total = total + F.col("weights")[i] * F.col(name)
    return total


def training_means(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Mean label of the refit rows per window."""
    terms = {"n": F.lit(1.0), "sy": F.col("y")}
    sums = window_sums(monthly_sums(rows, inputs, study, terms), folds, study, list(terms))
    return sums.where(F.col("role") == "refit").select(
        *MODEL_KEYS, (F.col("sy") / F.col("n")).alias("train_mean")
    )


# ---------------------------------------------------------------- ridge


def monthly_moments(rows: DataFrame, inputs: Sequence[str], study: Study) -> DataFrame:
    """Mergeable records per coin, horizon and month: row count, means and squared deviations."""
    return monthly_records(rows, inputs, study).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.avg(c) for c in inputs]).alias("means"),
        F.array(*[F.var_pop(c) for c in inputs]).alias("variances"),
    )


MOMENTS = T.StructType(
    [T.StructField("centres", T.ArrayType(T.DoubleType())), T.StructField("spreads", T.ArrayType(T.DoubleType()))]
)


@F.pandas_udf(MOMENTS)
def merged_moments(n: pd.Series, means: pd.Series, variances: pd.Series) -> pd.DataFrame:
    """Mean and population spread from the records of several months."""
    found = []
    for sizes, m, v in zip(n, means, variances, strict=True):
        weight = np.asarray(sizes, dtype=float)[:, None] / np.sum(sizes)
        m, v = np.vstack(m), np.vstack(v)
        centre = (weight * m).sum(axis=0)
        found.append((centre, np.sqrt((weight * (v + (m - centre) ** 2)).sum(axis=0))))
    return pd.DataFrame(found, columns=MOMENTS.names)


def window_moments(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """``coin, horizon, window, role, rows, centres, spreads`` of the inputs; no row is copied per window."""
    monthly = monthly_moments(rows, inputs, study)
    grouped = in_windows(monthly, folds, study).groupBy(*MODEL_KEYS, "role")
    lists = grouped.agg(
        F.sum("n").alias("rows"), *[F.collect_list(c).alias(c) for c in ("n", "means", "variances")]
    )
    merged = merged_moments("n", "means", "variances").alias("_m")
    return lists.select(*MODEL_KEYS, "role", "rows", merged).select(*MODEL_KEYS, "role", "rows", "_m.*")


def pooled_spreads(moments: DataFrame, size: int) -> DataFrame:
    """``horizon, window, role, centres, spreads`` of inputs that every coin has on its own scale.

    Each coin's scaled input has mean 0 and variance 1, or 0 where it is constant, on the rows of its
    role; so the pooled scale follows from the coins' row counts, and no row is read again.
    """
    varies = [F.sum(F.when(F.col("spreads")[i] > 0, F.col("rows")).otherwise(0)) for i in range(size)]
    pooled = moments.groupBy("horizon", "window", "role").agg(
        F.array(*[F.lit(0.0)] * size).alias("centres"),
        F.array(*[F.sqrt(v / F.sum("rows")) for v in varies]).alias("spreads"),
    )
    return with_unit_spread(pooled)


def window_products(
    rows: DataFrame,
    folds: Sequence[Fold],
    inputs: Sequence[str],
    study: Study,
    moments: DataFrame,
    keys: Sequence[str] = MODEL_KEYS,
) -> DataFrame:
    """Cross products of ``1, clipped scores, y`` per window: arrays ``train``, ``valid``, ``refit``.
    Without the coin among ``keys`` they are added over coins.

    Rows are dealt by blocks of the time line, once, with the bit set of their windows; a task has the
    rows of one block and the scales of its coin's windows, and gives one vector per window and part.
    Vectors of a window are added over blocks, first in salted groups.
    """
    tables = [_products(rows, group, inputs, study, moments, keys) for group in window_groups(folds)]
    return reduce(DataFrame.unionByName, tables)


PARTS = ("train", "valid", "refit")


def _products(
    rows: DataFrame,
    windows: Sequence[Fold],
    inputs: Sequence[str],
    study: Study,
    moments: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    names, size = [f.window for f in windows], len(inputs)
    block = F.floor(F.col("pos") / F.lit(study.block_rows)).alias("_block")
    fitting = rows.withColumn("_mask", role_mask(windows, inputs, study)).where("_mask <> 0")
    fitting = settle(fitting.select("coin", "horizon", block, "_mask", "y", *inputs))
    held = fitting.select("coin", "horizon", "_block").distinct().withColumnRenamed("_block", "_of")
    scales = held.join(moments.where(F.col("window").isin(names)), ["coin", "horizon"]).select(
        F.col("coin").alias("_coin"), F.col("horizon").alias("_horizon"), "_of", "window", "role", "centres", "spreads"
    )
    upper = np.triu_indices(size + 2)
    kind = T.StructType(
        [
            rows.schema["coin"],
            rows.schema["horizon"],
            T.StructField("window", T.StringType()),
            T.StructField("_salt", T.LongType()),
            T.StructField("part", T.StringType()),
            T.StructField("cells", T.ArrayType(T.DoubleType())),
        ]
    )

    def products(data: pa.Table, scale: pa.Table) -> pa.Table:
        mask = data["_mask"].to_numpy()
        x = np.column_stack([data[n].to_numpy() for n in inputs]) if len(data) else np.empty((0, size))
        y, out = data["y"].to_numpy(), []
        for s in scale.to_pylist():
            bit = 2 * names.index(s["window"])
            train, valid = (mask >> bit & 1) == 1, (mask >> bit & 3) == 2
            wanted = {"refit": train | valid} if s["role"] == "refit" else {"train": train, "valid": valid}
            for part, used in wanted.items():
                if not used.any():
                    continue
                z = (x[used] - np.array(s["centres"])) / np.array(s["spreads"])
                u = np.column_stack([np.ones(len(z)), np.clip(z, -RIDGE_CLIP, RIDGE_CLIP), y[used]])
                out.append((s["_coin"], s["_horizon"], s["window"], s["_of"] % SALTS, part, (u.T @ u)[upper].tolist()))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in kind]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind), strict=True)], names=kind.names)

    def added(group: pa.Table) -> pa.Table:
        total = np.vstack(group["cells"].to_pylist()).sum(axis=0)
        return group.slice(0, 1).set_column(
            group.schema.get_field_index("cells"), "cells", pa.array([total.tolist()], pa.list_(pa.float64()))
        )

    vectors = fitting.groupBy("coin", "horizon", "_block").cogroup(
        scales.groupBy("_coin", "_horizon", "_of")
    ).applyInArrow(products, kind)
    once = vectors.groupBy(*keys, "part", "_salt").applyInArrow(added, kind)
    total = once.groupBy(*keys, "part").applyInArrow(added, kind)
    return total.groupBy(*keys).agg(
        *[F.max(F.when(F.col("part") == p, F.col("cells"))).alias(p) for p in PARTS]
    )


def with_unit_spread(moments: DataFrame) -> DataFrame:
    """A constant input keeps its scale instead of dividing by zero."""
    fixed = F.transform("spreads", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))
    return moments.withColumn("spreads", fixed)


def standard_scores(x: Column) -> Column:
    """Inputs on the scale of the joined moments. Array functions keep the generated code small."""
    moved = F.zip_with(x, F.col("centres"), lambda value, centre: value - centre)
    return F.zip_with(moved, F.col("spreads"), lambda value, spread: value / spread)


def clipped_scores(x: Column) -> Column:
    top, bottom = F.lit(RIDGE_CLIP), F.lit(-RIDGE_CLIP)
    return F.transform(standard_scores(x), lambda z: F.greatest(F.least(z, top), bottom))


RIDGE = T.StructType(
    [
        T.StructField("alpha", T.DoubleType()),
        T.StructField("inner_intercept", T.DoubleType()),
        T.StructField("inner_weights", T.ArrayType(T.DoubleType())),
        T.StructField("refit_intercept", T.DoubleType()),
        T.StructField("refit_weights", T.ArrayType(T.DoubleType())),
        T.StructField("setting", T.StringType()),
    ]
)


def choose_ridge(
    train: np.ndarray, valid: np.ndarray, refit: np.ndarray, alphas: Sequence[float]
) -> dict:
    """Penalty with the least validation error (the smallest on a tie) and both fits with it."""

    def error(model: tuple[float, np.ndarray]) -> float:
        residual = np.concatenate([[-model[0]], -model[1], [1.0]])
        return float(residual @ valid @ residual)

    fits = [(solve_centred(train, a), a) for a in alphas]
    inner, alpha = min(fits, key=lambda fit: error(fit[0]))
    final = solve_centred(refit, alpha)
    return {
        "alpha": alpha,
        "inner_intercept": inner[0],
        "inner_weights": inner[1],
        "refit_intercept": final[0],
        "refit_weights": final[1],
        "setting": f"alpha={alpha:.0e}",
    }


def ridge_models(products: DataFrame, keys: Sequence[str], penalties: Sequence[float]) -> DataFrame:
    """``keys, setting, role, intercept, weights`` from the cross products of the three parts."""
    penalties = tuple(penalties)

    @F.pandas_udf(RIDGE)
    def solve(train: pd.Series, valid: pd.Series, refit: pd.Series) -> pd.DataFrame:
        solved = [
            choose_ridge(*[unpack(np.asarray(c, dtype=float)) for c in cells], penalties)
            for cells in zip(train, valid, refit, strict=True)
        ]
        return pd.DataFrame(solved, columns=RIDGE.names)

    complete = products.dropna(subset=["train", "valid", "refit"])
    chosen = complete.select(*keys, solve("train", "valid", "refit").alias("_m"))
    models = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"_m.{role}_intercept").alias("intercept"),
                F.col(f"_m.{role}_weights").alias("weights"),
            )
            for role in ROLES
        ]
    )
    return chosen.select(
        *keys, F.col("_m.setting").alias("setting"), F.explode(models).alias("_f")
    ).select(*keys, "setting", "_f.*")


def fit_ridge(
    rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
) -> DataFrame:
    """Ridge on clipped standard scores for every coin, horizon and window."""
    moments = settle(with_unit_spread(window_moments(rows, folds, inputs, study)))
    products = window_products(rows, folds, inputs, study, moments)
    models = ridge_models(products, MODEL_KEYS, RIDGE_ALPHAS)
    return models.join(moments.drop("rows"), [*MODEL_KEYS, "role"])


def predict_scores(x: Column) -> Column:
    terms = F.zip_with(F.col("weights"), clipped_scores(x), lambda w, z: w * z)
    return F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def predict_ridge(inputs: Sequence[str]) -> Column:
    return predict_scores(F.array(*inputs))


# ---------------------------------------------------------------- registry

FitFunction = Callable[[DataFrame, Sequence[Fold], Sequence[str], Study], DataFrame]


@dataclass(frozen=True)
class Family:
    """How a model family is fitted and how its parameter columns predict.

    Users add their own: ``fit`` returns one row per ``coin, horizon, window, role`` with a
    ``setting`` column, and ``predict`` turns the parameter and input columns into a prediction.
    """

    fit: FitFunction
    predict: Callable[[Sequence[str]], Column]


FAMILIES: dict[str, Family] = {
    "momentum": Family(fit_momentum, predict_line),
    "best_feature": Family(fit_best_feature, predict_line),
    "ridge": Family(fit_ridge, predict_ridge),
    "har": Family(fit_least_squares, predict_linear),
}


def register_family(name: str, family: Family) -> None:
    FAMILIES[name] = family


def rows_family(
    fit: Callable[[pd.DataFrame, pd.DataFrame, Sequence[str], int], tuple[dict, dict, str]],
    predict: Callable[[dict, pd.DataFrame], np.ndarray],
    parameters: str,
    rows_limit: int = 1_000_000,
) -> Family:
    """A family from plain functions on pandas rows.

    ``fit(train, valid, inputs, horizon)`` gets the rows of one window with the label ``y`` in order of
    time; it returns the parameters of the model of the training rows, those of the model of both, and a
    text for ``setting``. ``parameters`` is their schema. ``predict(parameters, rows)`` returns an array.
    The rows of a window meet in one task, so a window of more than ``rows_limit`` rows is an error,
    found by counting before any row is moved.
    """

    def fit_rows(
        rows: DataFrame, folds: Sequence[Fold], inputs: Sequence[str], study: Study
    ) -> DataFrame:
        used = window_rows(rows, folds, inputs, study).where("refit")
        largest = used.groupBy(*MODEL_KEYS).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if largest > rows_limit:
            raise ValueError(f"a window has {largest:,} rows, more than the limit of {rows_limit:,}")

        def models(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
            table = table.sort_values("pos", kind="stable")
            train, valid = table[table["train"]], table[table["valid"]]
            inner, refit, setting = fit(train, valid, list(inputs), int(key[1]))
            found = [
                (*key, role, setting, "|".join(map(str, (*key, role))), known)
                for role, known in zip(ROLES, (inner, refit), strict=True)
            ]
            return pd.DataFrame(found, columns=[*MODEL_KEYS, "role", "setting", "_model", "_p"])

        kept = used.select(*MODEL_KEYS, "pos", "open_time", "train", "valid", *inputs, "y")
        schema = (
            "coin string, horizon int, window string, role string, setting string, _model string,"
            f" _p struct<{parameters}>"
        )
        return kept.groupBy(*MODEL_KEYS).applyInPandas(models, schema)

    def predict_rows(inputs: Sequence[str]) -> Column:
        @F.pandas_udf("double")
        def run(model: pd.Series, known: pd.DataFrame, x: pd.DataFrame) -> pd.Series:
            found = pd.Series(np.nan, index=model.index)
            for _, part in model.groupby(model):
                first = known.loc[part.index[0]].to_dict()
                found.loc[part.index] = np.asarray(predict(first, x.loc[part.index]), dtype=float)
            return found

        return run(F.col("_model"), F.col("_p"), F.struct(*inputs))

    return Family(fit_rows, predict_rows)
