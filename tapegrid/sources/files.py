"""Monthly raw files: layout, reading, coverage and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import bar_position, bar_time, moment
from tapegrid.schema import BAR_FIELDS, FUNDING_TEXT, KLINE_TEXT


def month_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every ``YYYY-MM`` from start to end; a reversed range is an error."""
    if start > end:
        raise ValueError(f"no month from {start} to {end}")
    first, last = (F.to_date(F.lit(f"{m}-01")) for m in (start, end))
    step = F.expr("INTERVAL 1 MONTH")
    months = spark.range(1).select(F.explode(F.sequence(first, last, step)).alias("_m"))
    return months.select(F.date_format("_m", "yyyy-MM").alias("month"))


def months_for(months: DataFrame, universe: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Expected ``asset, pair, month``: months not before the asset's first bar."""
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("asset"),
                F.lit(p).alias("pair"),
                F.lit(f[:7] if f else "").alias("first_month"),
            )
            for a, p, f in universe
        ]
    )
    rows = months.withColumn("_a", F.explode(entries)).select("month", "_a.*")
    return rows.where(F.col("month") >= F.col("first_month")).select("asset", "pair", "month")


def kline_path(root: str, pair: str, month: str, interval: str = "5m") -> str:
    return f"{root}/raw/klines/{pair}/{pair}-{interval}-{month}.csv"


def funding_path(root: str, pair: str, month: str) -> str:
    return f"{root}/raw/funding/{pair}/{pair}-fundingRate-{month}.csv"


def pair_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]+)/[^/]+\.csv$", 1)


def month_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4}-\d{2})\.csv$", 1)


def present_months(spark: SparkSession, pattern: str) -> DataFrame:
    """Pairs and months on disk; only paths are read, not contents."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(
        pair_of_path(F.col("path")).alias("pair"), month_of_path(F.col("path")).alias("month")
    ).distinct()


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected pair-months with a flag for those that are there."""
    marked = present.withColumn("present", F.lit(True))
    return expected.join(marked, ["pair", "month"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def expected_digest(text: Column) -> Column:
    """First token of a checksum text."""
    return F.split(F.trim(text), r"\s+")[0]


def digest_mismatches(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose SHA-256 differs from the manifest, or that it does not list.

    ``contents`` has ``path, content``; ``manifest`` has ``path, checksum``.
    """
    wanted = manifest.select("path", expected_digest(F.col("checksum")).alias("expected"))
    found = contents.select("path", F.sha2("content", 256).alias("digest"))
    return found.join(wanted, "path", "left").where(~F.col("digest").eqNullSafe(F.col("expected")))


def _ordered_text(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """Text rows with their place: file, block within the file, line within the block."""
    rows = spark.read.schema(schema).csv(pattern, header=False)
    meta = F.col("_metadata")
    return rows.select(
        "*",
        pair_of_path(meta.file_path).alias("pair"),
        F.struct(
            meta.file_name.alias("file"),
            meta.file_block_start.alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_place"),
    )


def asset_of_pair(universe: Sequence[tuple[str, str, str | None]]) -> Column:
    return F.create_map(*[F.lit(x) for a, p, _ in universe for x in (p, a)])[F.col("pair")]


def first_bar_of(universe: Sequence[tuple[str, str, str | None]]) -> Column:
    earliest = F.lit("1970-01-01 00:00:00")
    known = [(a, f) for a, _, f in universe if f]
    if not known:
        return earliest.cast("timestamp")
    table = F.create_map(*[F.lit(x) for pair in known for x in pair])
    return F.coalesce(table[F.col("asset")], earliest).cast("timestamp")


def clean_klines(
    text: DataFrame, universe: Sequence[tuple[str, str, str | None]], study: Study
) -> DataFrame:
    """Typed bars: header lines dropped, first row per open time, nothing before the first bar.

    The first row wins through a hash aggregate, which combines on the map side.
    """
    rows = text.where(F.col("open_time").rlike(r"^[0-9]+$")).select(
        asset_of_pair(universe).alias("asset"),
        F.timestamp_millis(F.col("open_time").cast("long")).alias("open_time"),
        *[F.col(f).cast("double").alias(f) for f in BAR_FIELDS],
        "_place",
    )
    kept = rows.groupBy("asset", "open_time").agg(
        F.min_by(F.struct(*BAR_FIELDS), "_place").alias("_bar")
    )
    return (
        kept.where(F.col("open_time") >= first_bar_of(universe))
        .withColumn("pos", bar_position("open_time", study.bar_seconds))
        .select("asset", "pos", "open_time", "_bar.*")
    )


def read_klines(
    spark: SparkSession,
    root: str,
    universe: Sequence[tuple[str, str, str | None]],
    study: Study,
    interval: str = "5m",
) -> DataFrame:
    pattern = kline_path(root, "*", "*", interval)
    return clean_klines(_ordered_text(spark, pattern, KLINE_TEXT), universe, study)


def clean_funding(text: DataFrame, asset: Column, study: Study) -> DataFrame:
    """Settlements floored to their bar, the first one per bar."""
    rows = text.where(F.col("calc_time").cast("string").rlike(r"^[0-9]+$")).select(
        asset.alias("asset"),
        bar_position(F.timestamp_millis(F.col("calc_time").cast("long")), study.bar_seconds).alias(
            "pos"
        ),
        F.col("last_funding_rate").cast("double").alias("rate"),
        "_place",
    )
    return (
        rows.groupBy("asset", "pos")
        .agg(F.min_by(F.struct("rate"), "_place").alias("_r"))
        .select("asset", "pos", bar_time("pos", study.bar_seconds).alias("open_time"), "_r.rate")
    )


def read_funding(
    spark: SparkSession, root: str, universe: Sequence[tuple[str, str, str | None]], study: Study
) -> DataFrame:
    text = _ordered_text(spark, funding_path(root, "*", "*"), FUNDING_TEXT)
    return clean_funding(text, asset_of_pair(universe), study)


def write_kline_files(bars: DataFrame, root: str, pairs: Sequence[tuple[str, str]]) -> str:
    """Bars as headerless text partitioned by pair, in the kline column order."""
    pair = F.create_map(*[F.lit(x) for a, p in pairs for x in (a, p)])[F.col("asset")]
    millis = F.unix_millis("open_time")
    path = f"{root}/raw/klines"
    (
        bars.select(
            pair.alias("pair"),
            millis.alias("open_time"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            millis.alias("close_time"),
            "quote_volume",
            "count",
            "taker_buy_volume",
            "taker_buy_quote_volume",
            F.lit(0).alias("ignore"),
        )
        .write.mode("errorifexists")
        .partitionBy("pair")
        .csv(path)
    )
    return path


def read_partitioned_klines(
    spark: SparkSession, path: str, universe: Sequence[tuple[str, str, str | None]], study: Study
) -> DataFrame:
    """Files whose folder, not name, carries the pair (``pair=...``)."""
    rows = spark.read.schema(KLINE_TEXT).option("recursiveFileLookup", "true").csv(path)
    meta = F.col("_metadata")
    place = F.struct(
        meta.file_name.alias("file"),
        meta.file_block_start.alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    pair = F.regexp_extract(meta.file_path, r"/pair=([^/]+)/", 1)
    text = rows.select("*", pair.alias("pair"), place.alias("_place"))
    return clean_klines(text, universe, study)


def bars_before(spark: SparkSession, path: str, end: str) -> DataFrame:
    """Stored bars before a moment; the filter reaches the Parquet reader."""
    return spark.read.parquet(path).where(F.col("open_time") < moment(end))
