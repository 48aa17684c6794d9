"""Monthly files that were not ingested before, as a file stream.

The stream's checkpoint is the list of files already taken, so a run picks up only new ones. Each
batch owns one folder and overwrites it when it is retried, so a lost executor repeats no row. Rows
are stored as they come; the first row per open time is chosen when the bars are read, which also
settles a bar that arrives in two files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapegrid.config import Study
from tapegrid.functions.columns import month_of
from tapegrid.schema import BAR_FIELDS, KLINE_TEXT
from tapegrid.sources.files import clean_klines, pair_of_path


STORED = (
    "open_time string, "
    + ", ".join(f"`{f}` string" for f in BAR_FIELDS)
    + ", pair string, file string, block bigint, line bigint, batch bigint, month string"
)


def kline_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """New text rows with their pair, month and place."""
    rows = spark.readStream.schema(KLINE_TEXT).option("header", "false").csv(pattern)
    meta = F.col("_metadata")
    return rows.where(F.col("open_time").rlike(r"^[0-9]+$")).select(
        "open_time",
        *BAR_FIELDS,
        pair_of_path(meta.file_path).alias("pair"),
        month_of(F.timestamp_millis(F.col("open_time").cast("long"))).alias("month"),
        meta.file_name.alias("file"),
        meta.file_block_start.alias("block"),
    )


def ingest_new_files(
    spark: SparkSession, pattern: str, table: str, checkpoint: str
) -> StreamingQuery:
    """Store every new file under ``table`` and stop; run again when files arrive."""

    def store_batch(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.monotonically_increasing_id())
        lines.write.mode("overwrite").partitionBy("month").parquet(f"{table}/batch={number}")

    query = (
        kline_stream(spark, pattern)
        .writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingested_bars(
    spark: SparkSession, table: str, universe: Sequence[tuple[str, str, str | None]], study: Study
) -> DataFrame:
    """Clean bars of everything ingested so far."""
    place = F.struct("batch", "file", "block", "line")
    rows = spark.read.schema(STORED).parquet(table).withColumn("_place", place)
    return clean_klines(rows, universe, study)
