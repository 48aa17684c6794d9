"""Complete time grid, gaps and the data-quality audit.

Raw bars are long: ``asset, pos, open_time`` and the nine bar fields. ``pos`` is the bar number
since the epoch, so a time lag is a difference of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import bar_position, bar_time, moment, month_of
from tapegrid.operators.blocks import (
    blocked,
    in_block,
    owned,
    sequenced,
    with_previous,
)
from tapegrid.operators.rolling import Trailing, add_running_sums
from tapegrid.schema import BAR_FIELDS
from tapegrid.session import settle

GRID_CHUNK = 10_000


def drop_halts(raw: DataFrame) -> DataFrame:
    """Bars that traded."""
    return raw.where(F.col("count") > 0)


def complete_grid(raw: DataFrame, study: Study) -> DataFrame:
    """Every (asset, pos) from the grid start to the earliest last raw bar, halts included."""
    everyone = Window.partitionBy(F.lit(0))
    bounds = (
        raw.groupBy("asset")
        .agg(F.max("pos").alias("_last"))
        .select("asset", F.min("_last").over(everyone).alias("_end"))
        .withColumn("_start", bar_position(moment(study.grid_start), study.bar_seconds))
        .where(F.col("_start") <= F.col("_end"))
    )
    chunk = F.sequence(
        F.floor(F.col("_start") / GRID_CHUNK), F.floor(F.col("_end") / GRID_CHUNK)
    )
    chunks = bounds.withColumn("_chunk", F.explode(chunk)).repartition("asset", "_chunk")
    first = F.greatest(F.col("_start"), F.col("_chunk") * GRID_CHUNK)
    last = F.least(F.col("_end"), (F.col("_chunk") + 1) * GRID_CHUNK - 1)
    return chunks.select("asset", F.explode(F.sequence(first, last)).alias("pos"))


def align_on_grid(raw: DataFrame, study: Study, keep_raw_count: bool = False) -> DataFrame:
    """Bars on the complete grid; a missing or zero-trade bar is null in every field."""
    traded = F.col("_trades") > 0
    joined = complete_grid(raw, study).join(
        raw.select("asset", "pos", *BAR_FIELDS).withColumn("_trades", F.col("count")),
        ["asset", "pos"],
        "left",
    )
    fields = [F.when(traded, F.col(f)).alias(f) for f in BAR_FIELDS]
    extra = [F.col("_trades").alias("raw_count")] if keep_raw_count else []
    return joined.select(
        "asset", "pos", bar_time("pos", study.bar_seconds).alias("open_time"), *fields, *extra
    )


def log_returns(grid: DataFrame, study: Study) -> DataFrame:
    """One-bar log return on the grid, null next to a gap."""
    rows = blocked(grid, "pos", before=1, block_rows=study.block_rows)
    previous = F.lag("close").over(in_block(["asset"], "pos"))
    return owned(rows.withColumn("log_return", F.ln("close") - F.ln(previous)))


def find_seams(raw: DataFrame, study: Study) -> DataFrame:
    """Price jumps across missing or halted bars."""
    rows = with_previous(
        drop_halts(raw).select("asset", "pos", "open_time", "close"),
        ["asset"],
        "pos",
        ["pos", "open_time", "close"],
        study.block_rows,
    )
    between = (F.col("pos") - F.col("prev_pos") - 1).alias("bars_between")
    jump = F.col("close") / F.col("prev_close")
    return rows.select(
        "asset",
        F.col("prev_open_time").alias("last_bar_before"),
        F.col("open_time").alias("first_bar_after"),
        between,
        jump.alias("price_ratio"),
    ).where(
        (F.col("bars_between") > 0)
        & (
            (F.col("price_ratio") > study.seam_ratio)
            | (F.col("price_ratio") < 1 / study.seam_ratio)
        )
    )


def extreme_returns(returns: DataFrame, study: Study) -> DataFrame:
    """Rows whose move exceeds a multiple of the sample spread of the preceding observed moves.

    The window counts observed returns, so rows are numbered after gaps are dropped.
    """
    observed = sequenced(
        returns.where(F.col("log_return").isNotNull()).select(
            "asset", "pos", "open_time", "log_return"
        ),
        ["asset"],
        "pos",
        "seq",
        study.block_rows,
    )
    size = study.extreme_window
    rows = blocked(observed, "seq", before=size + 1, block_rows=study.block_rows)
    line = in_block(["asset"], "seq")
    rows = add_running_sums(rows, line, {"r": F.col("log_return")})
    spread = Trailing("r", size, line, shift=1).sample_std
    rows = owned(rows.withColumn("trailing_sd", spread))
    return rows.where(
        F.abs("log_return") > study.extreme_sigmas * F.col("trailing_sd")
    ).select("asset", "pos", "open_time", "log_return")


def audit_bars(raw: DataFrame, study: Study) -> DataFrame:
    """Bars per asset and month: expected, present, missing, zero-trade and extreme.

    The narrow return table is settled, so the raw bars are scanned and aligned once for both the
    counts and the trailing spread.
    """
    returns = settle(
        log_returns(align_on_grid(raw, study, keep_raw_count=True), study).select(
            "asset", "pos", "open_time", "raw_count", "log_return"
        )
    )
    trades = F.col("raw_count")
    month = month_of("open_time").alias("month")
    counts = returns.groupBy("asset", month).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count(trades).alias("present"),
        F.count_if(trades.isNull()).alias("missing"),
        F.count_if(trades == 0).alias("zero_trade"),
    )
    extreme = (
        extreme_returns(returns, study)
        .groupBy("asset", month)
        .agg(F.count(F.lit(1)).alias("extreme"))
    )
    return counts.join(extreme, ["asset", "month"], "left").withColumn(
        "extreme", F.coalesce("extreme", F.lit(0).cast("long"))
    )


def audit_totals(audit: DataFrame, seams: DataFrame) -> DataFrame:
    """Totals per asset with the number of seams."""
    totals = audit.groupBy("asset").agg(
        *[F.sum(c).alias(c) for c in ("missing", "zero_trade", "extreme")]
    )
    found = seams.groupBy("asset").agg(F.count(F.lit(1)).alias("seams"))
    return totals.join(found, "asset", "left").withColumn(
        "seams", F.coalesce("seams", F.lit(0).cast("long"))
    )


def late_seams(seams: DataFrame, study: Study) -> DataFrame:
    """Seams inside the study window."""
    return seams.where(F.col("first_bar_after") >= moment(study.train_start))


def require_no_late_seams(seams: DataFrame, study: Study) -> None:
    found = late_seams(seams, study)
    if not found.isEmpty():
        raise ValueError(f"price seams inside the study window, first: {found.first()}")


def forward_audit(raw: DataFrame, study: Study) -> DataFrame:
    """The audit of the forward months; trailing windows still read the months before them."""
    return audit_bars(raw, study).where(F.col("month") >= study.forward_months[0])
