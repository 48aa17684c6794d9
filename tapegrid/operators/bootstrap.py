"""Stationary block bootstrap over daily series.

The draws depend only on the length of a series, so their day counts are made once per length and
session, as small matrices (draws x days). Uniforms are digests of ``seed|draw|position``, so any
engine and any partitioning gives the same draws. A series is folded to arrays, which the calendar
bounds, and meets the matrices chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.config import DAYS_PER_YEAR, Study
from tapegrid.functions.columns import uniform
from tapegrid.session import settle

# An error this small is what is left of summing equal numbers in another order.
NO_ERROR = 1e-12
CHUNK_DRAWS = 500
_WEIGHTS: dict[tuple, DataFrame] = {}


def bootstrap_indices(sizes: DataFrame, study: Study) -> DataFrame:
    """``days, draw, position, at``: circular blocks of geometric length for each series length."""
    draws = sizes.select("days", F.explode(F.sequence(F.lit(0), F.lit(study.draws - 1))).alias("draw"))
    places = draws.repartition("days", "draw").select(
        "days", "draw", F.explode(F.sequence(F.lit(0), F.col("days") - 1)).alias("position")
    )
    seed, draw, position = F.lit(study.seed), F.col("draw"), F.col("position")
    opens = (uniform(seed, draw, position) < 1 / study.mean_block) | (position == 0)
    first = F.floor(uniform(seed, draw, position, F.lit("first")) * F.col("days"))
    line = (
        Window.partitionBy("days", "draw")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = places.withColumn("_open", opens)
    rows = rows.withColumn(
        "_block",
        F.last(F.when(F.col("_open"), F.struct(position.alias("start"), first.alias("first"))), True).over(line),
    )
    at = (F.col("_block.first") + position - F.col("_block.start")) % F.col("days")
    return rows.select("days", "draw", "position", at.cast("int").alias("at"))


def draw_weights(sizes: DataFrame, study: Study) -> DataFrame:
    """How often each draw takes each day."""
    return (
        bootstrap_indices(sizes, study)
        .groupBy("days", "draw", "at")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def numbered_days(daily: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, at, days, value`` with the days of each series numbered from zero."""
    whole = Window.partitionBy(*keys)
    return daily.select(
        *keys,
        (F.row_number().over(whole.orderBy("day")) - 1).alias("at"),
        F.count(F.lit(1)).over(whole).cast("int").alias("days"),
        F.col(value).alias("_v"),
    )


def forget_weights() -> None:
    """Drop the held day counts."""
    _WEIGHTS.clear()


def weight_chunks(sizes: DataFrame, study: Study) -> DataFrame:
    """``days, chunk, counts``: the day counts of 500 draws as a row of 16-bit numbers.

    ``sizes`` has the lengths in ``days``; what a session has made for a length is used again.
    """
    spark = sizes.sparkSession
    of = (spark.sparkContext.applicationId, study.seed, study.draws, study.mean_block)
    lengths = sorted(r["days"] for r in sizes.select("days").distinct().collect())
    fresh = [n for n in lengths if (*of, n) not in _WEIGHTS]
    if fresh:
        table = spark.createDataFrame([(n,) for n in fresh], "days int")
        chunk = F.floor(F.col("draw") / CHUNK_DRAWS).cast("int")
        places = bootstrap_indices(table, study).select("days", chunk.alias("chunk"), "draw", "at")

        def counted(rows: pd.DataFrame) -> pd.DataFrame:
            days, chunk = int(rows["days"].iloc[0]), int(rows["chunk"].iloc[0])
            cells = (rows["draw"].to_numpy() - chunk * CHUNK_DRAWS) * days + rows["at"].to_numpy()
            draws = int(rows["draw"].max()) - chunk * CHUNK_DRAWS + 1
            counts = np.bincount(cells, minlength=draws * days).astype("<u2").tobytes()
            return pd.DataFrame({"days": [days], "chunk": [chunk], "counts": [counts]})

        made = settle(
            places.groupBy("days", "chunk").applyInPandas(counted, "days int, chunk int, counts binary")
        )
        for n in fresh:
            _WEIGHTS[(*of, n)] = made
    tables = list({id(t): t for t in (_WEIGHTS[(*of, n)] for n in lengths)}.values())
    out = tables[0] if tables else spark.createDataFrame([], "days int, chunk int, counts binary")
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def draw_moments(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample spread of each draw; unknown days count as the series mean."""
    known = ~np.isnan(values)
    days = len(values)
    centre = values[known].mean() if known.any() else np.nan
    moved = np.where(known, values - centre, 0.0)
    sums, squares = counts @ moved, counts @ (moved * moved)
    taken = (counts > 0) & known
    low = np.where(taken, values, np.inf).min(axis=1)
    high = np.where(taken, values, -np.inf).max(axis=1)
    flat = low == high
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt(np.maximum((squares - sums * sums / days) / (days - 1), 0.0))
    if days == 1:
        spread[:] = np.nan
    return np.where(flat, low, centre + sums / days), np.where(flat, 0.0, spread)


def resampled(
    daily: DataFrame, keys: Sequence[str], values: str | Sequence[str], study: Study
) -> DataFrame:
    """Mean and sample spread of every draw.

    ``keys, draw, days, mean, std`` for one value column; for several, which share the draws and
    one pass, ``mean_<value>, std_<value>``.
    """
    names = [values] if isinstance(values, str) else list(values)
    row = F.struct("day", *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(names)])
    folded = daily.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    series = settle(
        folded.select(
            *keys,
            F.size("_rows").alias("days"),
            *[F.col(f"_rows.v{i}").alias(f"_v{i}") for i in range(len(names))],
        )
    )
    weights = weight_chunks(series, study)
    chunks = F.sequence(F.lit(0), F.lit((study.draws - 1) // CHUNK_DRAWS))
    cells = series.withColumn("chunk", F.explode(chunks)).join(weights, ["days", "chunk"])
    parts = [f"_{kind}{i}" for i in range(len(names)) for kind in ("m", "s")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[str, list[np.ndarray]] = {p: [] for p in parts}
            for r in frame.to_dict("records"):
                counts = np.frombuffer(r["counts"], dtype="<u2").reshape(-1, r["days"]).astype(float)
                for i in range(len(names)):
                    mean, spread = draw_moments(np.array(r[f"_v{i}"], dtype=float), counts)
                    found[f"_m{i}"].append(mean)
                    found[f"_s{i}"].append(spread)
            yield frame[[*keys, "days", "chunk"]].assign(**found)

    columns = cells.select(*keys, "days", "chunk", "counts", *[f"_v{i}" for i in range(len(names))])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.select(*keys, "days", "chunk").schema)
    moments = columns.mapInPandas(run, schema + "".join(f", {p} array<double>" for p in parts))
    each = moments.withColumn("_d", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(parts[0]) - 1).alias("at"), *parts)))
    draw = (F.col("chunk") * CHUNK_DRAWS + F.col("_d.at")).cast("int").alias("draw")
    tags = [""] if isinstance(values, str) else [f"_{v}" for v in names]
    return each.select(
        *keys,
        draw,
        "days",
        *[
            F.nanvl(F.col(f"_d._{letter}{i}"), F.lit(None).cast("double")).alias(f"{kind}{tag}")
            for i, tag in enumerate(tags)
            for letter, kind in (("m", "mean"), ("s", "std"))
        ],
    )


def spread_of_means(mean: str) -> Column:
    """Population spread of the draw means of a key, exactly zero where they are all equal."""
    return F.when(F.min(mean) == F.max(mean), F.lit(0.0)).otherwise(F.stddev_pop(mean))


def bootstrap_se(daily: DataFrame, keys: Sequence[str], value: str, study: Study) -> DataFrame:
    """Population spread of the draw means."""
    draws = resampled(daily, keys, value, study)
    return draws.groupBy(*keys).agg(spread_of_means("mean").alias("se"))


def mean_summary(
    daily: DataFrame, keys: Sequence[str], value: str, study: Study, name: str = "ic"
) -> DataFrame:
    """Mean, bootstrap error, t and number of days of each series; t is null without an error."""
    if not keys:
        single = daily.withColumn("_all", F.lit(0))
        return mean_summary(single, ["_all"], value, study, name).drop("_all")
    totals = daily.groupBy(*keys).agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("days"))
    joined = totals.join(bootstrap_se(daily, keys, value, study), list(keys))
    t = F.when(F.col("se") > NO_ERROR, F.col(name) / F.col("se"))
    return joined.select(*keys, name, "se", t.alias("t"), "days")


def sharpe(value: str) -> Column:
    spread = F.stddev_samp(value)
    return F.when(spread > 0, F.lit(DAYS_PER_YEAR) ** 0.5 * F.avg(value) / spread)


def draw_sharpe(mean: str, spread: str) -> Column:
    """Sharpe ratio of one draw: infinite without spread, left out for a draw of zeros."""
    infinite = F.lit("Infinity").cast("double")
    return (
        F.when(F.col(spread) > 0, F.lit(DAYS_PER_YEAR) ** 0.5 * F.col(mean) / F.col(spread))
        .when(F.col(mean) > 0, infinite)
        .when(F.col(mean) < 0, -infinite)
    )


def interval_ends(ratio: str, level: float = 0.9) -> Column:
    tail = (1 - level) / 2
    return F.percentile(ratio, F.array(F.lit(tail), F.lit(1 - tail)))


def sharpe_interval(
    daily: DataFrame, keys: Sequence[str], value: str, study: Study, level: float = 0.9
) -> DataFrame:
    """Bootstrap interval of the Sharpe ratio."""
    draws = resampled(daily, keys, value, study).withColumn("_ratio", draw_sharpe("mean", "std"))
    ends = draws.groupBy(*keys).agg(interval_ends("_ratio", level).alias("_ends"))
    return ends.select(
        *keys,
        F.col("_ends")[0].alias("sharpe_low"),
        F.col("_ends")[1].alias("sharpe_high"),
    )


def gross_and_net(daily: DataFrame, keys: Sequence[str], study: Study, level: float = 0.9) -> DataFrame:
    """``gross_t, sharpe_low, sharpe_high`` of each series from one pass over shared draws."""
    draws = resampled(daily, keys, ["gross", "net"], study).withColumn(
        "_ratio", draw_sharpe("mean_net", "std_net")
    )
    found = draws.groupBy(*keys).agg(
        spread_of_means("mean_gross").alias("_se"), interval_ends("_ratio", level).alias("_ends")
    )
    means = daily.groupBy(*keys).agg(F.avg("gross").alias("_mean"))
    return means.join(found, list(keys)).select(
        *keys,
        F.when(F.col("_se") > NO_ERROR, F.col("_mean") / F.col("_se")).alias("gross_t"),
        F.col("_ends")[0].alias("sharpe_low"),
        F.col("_ends")[1].alias("sharpe_high"),
    )
