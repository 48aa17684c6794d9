"""Bars and funding-like settlements built from event and order-line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.config import Study
from tapegrid.functions.columns import bar_position, bar_time, pair_order


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def aggregate_bars(ticks: DataFrame, order: Column, bar_seconds: int) -> DataFrame:
    """Ticks ``asset, time, price, quantity, traded, bought`` to bars.

    One hash aggregate: ticks combine on the map side, so a hot asset never gathers in one task.
    That needs an ``order`` of fixed width (``pair_order``): over a struct each task sorts its ticks.
    """
    bought = F.col("bought")
    value = F.col("quantity") * F.col("price")
    zero = F.lit(0.0)
    bars = ticks.groupBy("asset", bar_position("time", bar_seconds).alias("pos")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(value).alias("quote_volume"),
        F.count_if("traded").cast("double").alias("count"),
        F.sum(F.when(bought, F.col("quantity")).otherwise(zero)).alias("taker_buy_volume"),
        F.sum(F.when(bought, value).otherwise(zero)).alias("taker_buy_quote_volume"),
    )
    return bars.withColumn("open_time", bar_time("pos", bar_seconds))


def event_ticks(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_type").alias("asset"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id"),
        (F.col("value") + 100).alias("price"),
        F.col("value").alias("quantity"),
        (k >= 10).alias("traded"),
        (k >= 50).alias("bought"),
    )


def event_bars(events: DataFrame, study: Study) -> DataFrame:
    # Bars part by time, so the moment within the bar orders like the time.
    moment = F.pmod(F.unix_micros("time"), F.lit(study.bar_seconds * 1_000_000))
    order = pair_order(moment, "event_id", first_bits=56, second_bits=64)
    return aggregate_bars(event_ticks(events), order, study.bar_seconds)


def event_funding_text(events: DataFrame) -> DataFrame:
    """Raw settlement rows every eight hours, a few milliseconds late, one file per asset."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 28_800_000_000).cast("long")
    settled = events.groupBy(F.col("event_type").alias("asset"), bucket.alias("_bucket")).agg(
        F.min("event_id").alias("_first"), F.avg("value").alias("_mean")
    )
    return settled.select(
        "asset",
        (F.col("_bucket") * 28_800_000 + F.col("_first") % 20).alias("calc_time"),
        F.lit(8).alias("funding_interval_hours"),
        ((F.col("_mean") - 50) / 9_973).alias("last_funding_rate"),
        F.struct(F.col("asset").alias("file"), F.col("_bucket").alias("line")).alias("_place"),
    )


def line_ticks(lineitem: DataFrame) -> DataFrame:
    """Each order line trades in two series: its return flag and its line status."""
    series = F.array(
        F.concat(F.lit("flag_"), F.lower("l_returnflag")),
        F.concat(F.lit("status_"), F.lower("l_linestatus")),
    )
    return lineitem.select(
        F.explode(series).alias("asset"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / 1000 + 100).alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_discount") >= 0).alias("traded"),
        (F.col("l_discount") >= 0.05).alias("bought"),
    )


def line_bars(lineitem: DataFrame, study: Study) -> DataFrame:
    return aggregate_bars(line_ticks(lineitem), pair_order("l_orderkey", "l_linenumber"), study.bar_seconds)


def line_funding(lineitem: DataFrame, study: Study) -> DataFrame:
    """Weekly settlements per return flag, stamped on the first day of the week."""
    week = 604_800 // study.bar_seconds
    bucket = F.floor(bar_position(F.col("l_shipdate").cast("timestamp"), study.bar_seconds) / week)
    return (
        lineitem.groupBy(
            F.concat(F.lit("flag_"), F.lower("l_returnflag")).alias("asset"),
            (bucket * week).cast("long").alias("pos"),
        )
        .agg(((F.avg("l_tax") - 0.04) / 100).alias("rate"))
        .select("asset", "pos", bar_time("pos", study.bar_seconds).alias("open_time"), "rate")
    )
