"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.functions.columns import uniform
from tapegrid.llm.text import whole, word_count
from tapegrid.operators.blocks import order_counts
from tapegrid.session import settle

SALTS = 64


def source_totals(sized: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, weight``: sizes per source, weights in code point order, null last."""
    totals = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Ranks come from a range partitioned sort, so the number of sources may be large.
    ranks = order_counts(totals.select("source"), [], "source").select("source", "below", "n")
    known = totals.join(ranks, "source", "left")
    place = F.coalesce(F.col("below"), F.lit(totals.where("source IS NOT NULL").count()))
    choice = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(place, F.lit(len(weights))) + 1).cast("int"),
    )
    return known.select("source", "source_size", choice.alias("weight"))


def source_targets(totals: DataFrame, most: float = 3.0) -> DataFrame:
    """Add ``target``: the total size shared by weight, no source above ``most`` times its size.

    The share per unit of weight rises as sources reach their ceiling: those at it are taken out,
    with what they get, until the rest fits. One small aggregate per turn; a turn that fills no
    further source ends the loop. Sources without words get 0.
    """
    totals = settle(totals)
    ceiling = F.col("source_size") * F.lit(float(most))
    total = float(totals.agg(F.sum("source_size").cast("double")).first()[0] or 0)
    level, filled = 0.0, -1
    while True:
        full = ceiling <= F.col("weight") * F.lit(level)
        row = totals.agg(
            F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(full).alias("filled"),
        ).first()
        if row["weight"] == 0 or row["filled"] == filled:
            break
        filled = row["filled"]
        level = (total - row["given"]) / row["weight"]
    share = F.col("weight") * F.lit(level)
    return totals.withColumn("target", F.least(ceiling, share))


def copies(rate: Column, doc: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the probability of the fraction, drawn from a digest."""
    draw = uniform(F.lit(seed), F.coalesce(doc.cast("string"), F.lit("null")))
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _copies``.

    Size is the number of words, null text 0. A document's draw depends on the seed and its id only,
    so reruns and repeated rows agree. Rates never exceed ``most``, hence no document is taken more
    often than that.

    The table of sources is joined on source and a salt that spreads each source over 64 keys, so
    a source with a third of all rows is no single task; only that table is repeated.
    """
    sized = docs.withColumn("_size", word_count(whole(text_col)))
    totals = source_totals(sized.select(F.col(source_col).alias("source"), F.col("_size").alias("size")), weights)
    targets = settle(source_targets(totals, most)).select(
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    met = (salted["_salt"] == targets["_salt"]) & salted[source_col].eqNullSafe(targets["_source"])
    joined = salted.join(targets, met).drop("_salt", "_source")
    rate = F.coalesce(F.try_divide(F.col("_target"), F.col("_source_size")), F.lit(0.0))
    return joined.withColumn("_copies", copies(rate, F.col(id_col), seed).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs``."""
    mixed = mixture(docs, **options).where(F.col("_copies") > 0)
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return repeated.select(*docs.columns)
