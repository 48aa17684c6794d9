"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bar_position(time: Column | str, bar_seconds: int) -> Column:
    """Number of the bar that holds ``time``, counted from the epoch."""
    return F.floor(F.unix_micros(_col(time)) / F.lit(bar_seconds * 1_000_000)).cast("long")


def bar_time(position: Column | str, bar_seconds: int) -> Column:
    return F.timestamp_seconds(_col(position) * F.lit(bar_seconds))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def between(time: Column | str, start: str | None, end: str | None) -> Column:
    """Half-open time filter."""
    time = _col(time)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (time >= moment(start))
    if end is not None:
        inside = inside & (time < moment(end))
    return inside


def pair_order(first: Column | str, second: Column | str, first_bits: int = 64, second_bits: int = 32) -> Column:
    """One whole number that sorts like ``struct(first, second)``, nulls first.

    Both are signed integers of so many bits, 120 together at most. A number has a fixed width in the
    buffer of an aggregate, so ``min_by`` over it is a hash aggregate; over a struct all rows are sorted.
    """

    def whole(value: Column | str, bits: int) -> Column:
        below = -(1 << bits - 1) - 1
        kind = f"decimal({len(str(-below))},0)"
        return F.coalesce(_col(value).cast(kind), F.lit(str(below)).cast(kind))

    span = F.lit(str(1 << second_bits + 1))
    span = span.cast(f"decimal({len(str(1 << second_bits + 1))},0)")
    return whole(first, first_bits) * span + whole(second, second_bits)


def month_of(time: Column | str) -> Column:
    return F.date_format(_col(time), "yyyy-MM")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that is null, not an error, for a zero denominator."""
    return F.try_divide(_col(top), _col(bottom))


def both(a: Column, b: Column, value: Column) -> Column:
    """``value`` where both arguments are known; greatest/least alone would skip a null."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for name in columns:
        known = known & F.col(name).isNotNull()
    return known


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the digest of the joined parts: the same in every engine and plan."""
    text = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stack_columns(
    df: DataFrame, keep: Sequence[str], columns: dict[str, Column] | Sequence[str], name: str, value: str
) -> DataFrame:
    """Columns to rows: one row per (row, listed column)."""
    if not isinstance(columns, dict):
        columns = {c: F.col(c) for c in columns}
    entries = F.array(
        *[F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in columns.items()]
    )
    exploded = df.select(*keep, F.explode(entries).alias("_entry"))
    return exploded.select(*keep, F.col(f"_entry.{name}"), F.col(f"_entry.{value}"))


def pick_column(name: Column, columns: Sequence[str]) -> Column:
    """Value of the column whose name the row carries."""
    chain = F.when(name == F.lit(columns[0]), F.col(columns[0]))
    for candidate in columns[1:]:
        chain = chain.when(name == F.lit(candidate), F.col(candidate))
    return chain


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
