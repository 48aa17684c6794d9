"""Preference formatting: one shared prompt and two masked completions per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _place() -> Column:
    return F.struct("turn", "role", "text")


def turns(conversations: DataFrame, side: int) -> DataFrame:
    """``pair_id, turn, role, text, side`` without repeated rows; nulls as -1 and empty text."""
    return conversations.select(
        "pair_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(side).alias("side"),
    )


def split_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, part, turn, role, text`` with part prompt, chosen or rejected.

    Both sides have ``pair_id, turn, role, text``. The first turn that only one side has ends the
    common prefix; turns before it are the prompt, once. All of it is aggregation with map-side
    sums and a join on the pair, never a window over a conversation.
    """
    sides = turns(chosen, 1).unionByName(turns(rejected, 2)).distinct()
    met = sides.groupBy("pair_id", "turn", "role", "text").agg(F.sum("side").alias("sides"))
    parting = (
        met.where("sides <> 3").groupBy("pair_id").agg(F.min(_place()).alias("parting"))
    )
    joined = met.join(
        parting.withColumnRenamed("pair_id", "_pair"), F.col("pair_id").eqNullSafe(F.col("_pair")), "left"
    ).drop("_pair")
    shared = F.col("parting").isNull() | (_place() < F.col("parting"))
    parts = F.when(shared, F.array(F.lit("prompt"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("sides").isin(1, 3), F.lit("chosen")),
                F.when(F.col("sides").isin(2, 3), F.lit("rejected")),
            ),
            lambda p: p.isNotNull(),
        )
    )
    return joined.select("pair_id", F.explode(parts).alias("part"), "turn", "role", "text")


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns``, a row per pair.

    A mask lists the character spans of its completion that are trained on: the text and end mark of
    each assistant turn. Pairs whose two sides are equal have empty completions; a side that is
    missing has an empty one. Null turns come before all others, equal turns go by role and text,
    repeated rows count once, other columns are ignored, an empty table gives no rows. However many
    turns a pair has, its prompt is rendered once; a pair must fit a row.
    """
    rows = split_turns(chosen, rejected)
    entry = F.struct("turn", "role", "text")
    lists = rows.groupBy("pair_id").agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("part") == part, entry))).alias(part)
            for part in ("prompt", "chosen", "rejected")
        ]
    )

    def text_of(part: str) -> Column:
        return F.array_join(F.transform(part, lambda t: rendered(t["role"], t["text"])), "")

    def mask_of(part: str) -> Column:
        start = F.struct(
            F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")
        )

        def step(acc: Column, t: Column) -> Column:
            stop = acc["at"] + F.length(rendered(t["role"], t["text"]))
            body = acc["at"] + F.length(t["role"]) + 5
            span = F.struct(body.cast("long").alias("start"), stop.cast("long").alias("stop"))
            return F.struct(
                stop.cast("long").alias("at"),
                F.when(t["role"] == TRAINED_ROLE, F.array_append(acc["spans"], span))
                .otherwise(acc["spans"])
                .alias("spans"),
            )

        return F.aggregate(F.col(part), start, step)["spans"]

    return lists.select(
        "pair_id",
        text_of("prompt").alias("prompt"),
        text_of("chosen").alias("chosen"),
        text_of("rejected").alias("rejected"),
        mask_of("chosen").alias("chosen_mask"),
        mask_of("rejected").alias("rejected_mask"),
        F.size("prompt").cast("long").alias("prompt_turns"),
    )


def neighbour_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from a table ``conv_id, turn, role, text`` without preferences.

    Chosen is the conversation. Rejected is its history up to its last assistant turn, ended by the
    last assistant turn of the neighbour with which it shares all but the lowest bit of the id; by
    nothing if there is none. Conversations without an assistant turn keep all turns on both sides.
    """
    rows = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text"
    )
    answers = rows.where(F.col("role") == TRAINED_ROLE)
    last = answers.groupBy("conv_id").agg(
        F.max("turn").alias("last"),
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("answer"),
    )
    history = (
        rows.join(last, "conv_id", "left")
        .where(F.col("last").isNull() | (F.col("turn") < F.col("last")))
        .select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    )
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "answer")
    ending = last.select("conv_id", "last").join(other, "conv_id").select(
        F.col("conv_id").alias("pair_id"),
        F.col("last").alias("turn"),
        F.lit(TRAINED_ROLE).alias("role"),
        F.col("answer").alias("text"),
    )
    return rows.withColumnRenamed("conv_id", "pair_id"), history.unionByName(ending)
