"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.session import settle


def _ordered(column: str) -> Column:
    """Hashed order: along a chain of ascending ids the plain order would contract one id a round."""
    return F.struct(F.xxhash64(column).alias("rank"), F.col(column).alias("id"))


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, root`` for every end of a link; ``root`` is one node of the component.

    Each round every node picks the first of its neighbours and itself, follows that choice one step
    further, and links are renamed to the picks. A star vanishes in one round, a chain loses a fixed
    share of its nodes. Everything is an aggregation with map-side sums or a join that adaptive
    execution may split, so a node with most of the links is no single task. Rounds are written to
    the shared folder; the driver only asks whether a link is left. Links from a node to itself and
    repeated links are ignored; no link gives no row.
    """
    pair = F.least(left, right).alias("u"), F.greatest(left, right).alias("v")
    edges = settle(links.where(F.col(left) != F.col(right)).select(*pair).distinct())
    steps = []
    while not edges.isEmpty():
        ends = edges.select("u", "v").union(edges.select("v", "u"))
        first = F.least(F.min(_ordered("v")), F.min(_ordered("u")))
        picks = settle(ends.groupBy("u").agg(first["id"].alias("pick")))
        further = picks.select(F.col("u").alias("pick"), F.col("pick").alias("root"))
        step = settle(picks.join(further, "pick").select(F.col("u").alias("node"), "root"))
        steps.append(step)
        renamed = (
            edges.join(step.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
            .join(step.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
            .where(F.col("a") != F.col("b"))
        )
        edges = settle(
            renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        found = found.join(later, "root", "left").select(
            "node", F.coalesce("_later", "root").alias("root")
        )
    return found
