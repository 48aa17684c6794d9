"""Order-dependent operators that never put one key into one task.

An asset may hold a third of all rows, so ``Window.partitionBy(asset)`` would be one task with a
third of the data. The helpers below split a key's time line instead:

* ``blocked``        cuts the line into blocks and copies only the few border rows a trailing or
                     leading frame needs, without a join;
* ``carried_last``   hands the last known value from block to block (unbounded look-back);
* ``sequenced``      gives dense row numbers from per-block counts;
* ``order_counts``   sorts distinct values by range partitions and counts the rows below each
                     value, which yields ranks, quantiles and top shares of any size of group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapegrid.session import settle

BLOCK, OWN = "_block", "_own"


def _block_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def blocked(
    df: DataFrame, position: str, before: int = 0, after: int = 0, block_rows: int = 100_000
) -> DataFrame:
    """Assign rows to time blocks, copying rows within ``before``/``after`` of a border.

    A block is never shorter than its borders, so a row has at most three copies.
    """
    size = max(block_rows, before + after, 1)
    place = F.col(position)
    reach = F.sequence(_block_of(place - after, size), _block_of(place + before, size))
    return df.withColumn(BLOCK, F.explode(reach)).withColumn(
        OWN, F.col(BLOCK) == _block_of(place, size)
    )


def in_block(keys: Sequence[str], position: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(position)


def owned(df: DataFrame) -> DataFrame:
    """Drop the border copies again."""
    return df.where(F.col(OWN)).drop(BLOCK, OWN)


def with_carry(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block_rows: int
) -> DataFrame:
    """Add the last known ``value`` of all earlier blocks; the block column stays for the caller.

    The summary has one row per block, so its window holds 1/block_rows of a key.
    """
    rows = df.withColumn(BLOCK, _block_of(F.col(position), block_rows))
    last = F.max_by(value, F.when(value.isNotNull(), F.col(position)))
    line = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, BLOCK)
        .agg(last.alias("_last"))
        .select(*keys, BLOCK, F.last("_last", ignorenulls=True).over(line).alias(name))
    )
    return rows.join(carry, [*keys, BLOCK], "left")


def carried_last(
    df: DataFrame, keys: Sequence[str], position: str, column: str, name: str, block_rows: int
) -> DataFrame:
    """Forward fill: the last non-null value at or before each row."""
    rows = with_carry(df, keys, position, F.col(column), "_carry", block_rows)
    line = in_block(keys, position).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(column, ignorenulls=True).over(line), F.col("_carry"))
    return rows.withColumn(name, filled).drop("_carry", BLOCK)


def with_previous(
    df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], block_rows: int
) -> DataFrame:
    """Add ``prev_*`` columns from the preceding row of the key, however far away it is."""
    row = F.struct(*[F.col(c) for c in columns])
    rows = with_carry(df, keys, position, row, "_carry", block_rows)
    previous = F.coalesce(F.lag(row).over(in_block(keys, position)), F.col("_carry"))
    rows = rows.withColumn("_previous", previous)
    for column in columns:
        rows = rows.withColumn(f"prev_{column}", F.col("_previous")[column])
    return rows.drop("_previous", "_carry", BLOCK)


def sequenced(
    df: DataFrame, keys: Sequence[str], position: str, name: str, block_rows: int
) -> DataFrame:
    """Dense 1-based row numbers per key in the order of ``position``."""
    rows = df.withColumn(BLOCK, _block_of(F.col(position), block_rows))
    line = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_offset"))
    )
    rows = rows.join(offsets, [*keys, BLOCK])
    number = F.row_number().over(in_block(keys, position)) + F.col("_offset")
    return rows.withColumn(name, number.cast("long")).drop("_offset", BLOCK)


def order_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows below each distinct value: ``keys, value, ties, below, n, rank_sd``.

    ``sums`` adds totals over the rows that share the value, for statistics that need no join back.

    Distinct values are counted first (a hot value shrinks to one row on the map side), then range
    partitioned, so a hot key spreads over many tasks. The slices are settled because the partition
    number must mean the same in the totals and in the rows. ``rank_sd`` is the population standard
    deviation of the average-tie ranks, null where all rows tie.
    """
    sums = sums or {}
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .repartitionByRange(*[F.col(k) for k in keys], F.col(value))
        .withColumn("_slice", F.spark_partition_id())
    )
    sliced = settle(counts)
    ties = F.col("ties").cast("double")
    line = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n = F.col("n").cast("double")
    spread = (n * n - 1) / 12 - F.col("_tied") / (12 * n)
    totals = (
        sliced.groupBy(*keys, "_slice")
        .agg(
            F.sum("ties").alias("_rows"),
            F.sum(ties * ties * ties - ties).alias("_tied"),
            F.count(F.lit(1)).alias("_values"),
        )
        .select(
            *keys,
            "_slice",
            F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(whole).alias("n"),
            F.sum("_tied").over(whole).alias("_tied"),
            F.sum("_values").over(whole).alias("_values"),
        )
        .withColumn("rank_sd", F.when(F.col("_values") > 1, F.sqrt(spread)))
        .drop("_tied", "_values")
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    below = F.col("_offset") + F.coalesce(F.sum("ties").over(inside), F.lit(0))
    return (
        sliced.join(totals, [*keys, "_slice"])
        .withColumn("below", below)
        .select(*keys, value, "ties", "below", "n", "rank_sd", *sums)
    )


def masked_ranks(
    df: DataFrame, keys: Sequence[str], value: str, members: Sequence[Column], sums: Sequence[Column] = ()
) -> DataFrame:
    """Standardised ranks of each distinct value within many overlapping sets of rows, from one sort.

    ``members`` tells the sets a row belongs to. Returns ``keys, value, z, n, sums``: arrays over the
    sets with the standardised rank (null where the set has no such value or all its rows tie), the
    number of rows, and the totals of ``sums`` (one column per set) over the rows that share the value.
    The sort is that of ``order_counts``, with one running count per set instead of a copy of the row.
    """
    sets = range(len(members))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(
            *[F.count(F.when(m, 1)).alias(f"_t{k}") for k, m in enumerate(members)],
            *[F.sum(F.when(members[k], c)).alias(f"_s{k}") for k, c in enumerate(sums)],
        )
        .repartitionByRange(*[F.col(k) for k in keys], F.col(value))
        .withColumn("_slice", F.spark_partition_id())
    )
    sliced = settle(counts)
    line = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts, totals = [], []
    for k in sets:
        ties = F.col(f"_t{k}").cast("double")
        parts += [
            F.sum(f"_t{k}").alias(f"_r{k}"),
            F.sum(ties * ties * ties - ties).alias(f"_d{k}"),
            F.count(F.when(ties > 0, 1)).alias(f"_v{k}"),
        ]
        n = F.sum(f"_r{k}").over(whole)
        spread = (n * n - 1) / 12 - F.sum(f"_d{k}").over(whole) / (12 * n)
        totals += [
            F.coalesce(F.sum(f"_r{k}").over(line), F.lit(0)).alias(f"_o{k}"),
            n.alias(f"_n{k}"),
            F.when(F.sum(f"_v{k}").over(whole) > 1, F.sqrt(spread)).alias(f"_sd{k}"),
        ]
    offsets = sliced.groupBy(*keys, "_slice").agg(*parts).select(*keys, "_slice", *totals)
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    below = [F.coalesce(F.sum(f"_t{k}").over(inside), F.lit(0)).alias(f"_b{k}") for k in sets]
    rows = sliced.select("*", *below).join(offsets, [*keys, "_slice"])

    def rank(k: int) -> Column:
        ties = F.col(f"_t{k}")
        place = F.col(f"_o{k}") + F.col(f"_b{k}") + (ties + 1) / 2
        return F.when(ties > 0, (place - (F.col(f"_n{k}") + 1) / 2) / F.col(f"_sd{k}"))

    return rows.select(
        *keys,
        value,
        F.array(*[rank(k) for k in sets]).alias("z"),
        F.array(*[F.col(f"_n{k}") for k in sets]).alias("n"),
        F.array(*[F.col(f"_s{k}") for k in range(len(sums))]).alias("sums"),
    )


def average_rank() -> Column:
    return F.col("below") + (F.col("ties") + 1) / 2


def standard_rank() -> Column:
    return (average_rank() - (F.col("n") + 1) / 2) / F.col("rank_sd")


def _with_ranks(
    df: DataFrame, ranks: DataFrame, keys: Sequence[str], column: str
) -> DataFrame:
    """Join ranks back on the value. Rows without a value have no rank; a digest of the row as part
    of their key spreads them, where null alone would put all of them in one task."""
    own = F.when(F.col(column).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long"))
    known = ranks.withColumn("_spread", F.lit(0).cast("long"))
    return df.withColumn("_spread", own).join(known, [*keys, column, "_spread"], "left").drop("_spread")


def standardised_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average-tie ranks per key, centred and scaled by their population standard deviation."""
    ranks = order_counts(df, keys, value).select(*keys, value, standard_rank().alias(name))
    return _with_ranks(df, ranks, keys, value)


def rank_columns(df: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Standardised ranks of several columns from one sort; ``names`` maps column to rank name."""
    sides = F.array(
        *[
            F.struct(F.lit(i).alias("side"), F.col(c).cast("double").alias("value"))
            for i, c in enumerate(names)
        ]
    )
    stacked = df.select(*keys, F.explode(sides).alias("_s")).select(
        *keys, F.col("_s.side").alias("_side"), F.col("_s.value").alias("_value")
    )
    return join_ranks(df, order_counts(stacked, [*keys, "_side"], "_value"), keys, names)


def join_ranks(
    df: DataFrame, ordered: DataFrame, keys: Sequence[str], names: Mapping[str, str]
) -> DataFrame:
    """Join the ranks of ``_side, _value`` back, one numbered side per column."""
    for i, (column, name) in enumerate(names.items()):
        ranks = ordered.where(F.col("_side") == i).select(
            *keys, F.col("_value").alias(column), standard_rank().alias(name)
        )
        df = _with_ranks(df, ranks, keys, column)
    return df


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str) -> DataFrame:
    """Rank correlation per key over the rows where both columns are known."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = rank_columns(known, keys, {a: "_za", b: "_zb"})
    return ranked.groupBy(*keys).agg(F.avg(F.col("_za") * F.col("_zb")).alias(name))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per key."""
    return quantiles_of(order_counts(df, keys, value), keys, value, levels)


def quantiles_of(
    ordered: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, float]
) -> DataFrame:
    picks, finals = [], []
    for name, level in levels.items():
        place = F.lit(float(level)) * (F.col("n") - 1)
        low = F.floor(place)
        high = F.least(low + 1, F.col("n") - 1)
        for end, rank in (("lo", low), ("hi", high)):
            holds = (F.col("below") <= rank) & (rank < F.col("below") + F.col("ties"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{end}"))
        picks.append(F.max(place - low).alias(f"_{name}_share"))
        lower = F.col(f"_{name}_lo")
        gap = F.col(f"_{name}_hi") - lower
        finals.append((lower + F.col(f"_{name}_share") * gap).alias(name))
    return ordered.groupBy(*keys).agg(*picks).select(*keys, *finals)
