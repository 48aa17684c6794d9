"""Quality rules: text statistics of each document, and lines that too many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapegrid.llm.text import utf8, word_count
from tapegrid.session import settle

# Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` words that stand in the text twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = codes[:n]
    for step in range(1, width):
        # Number the distinct prefixes anew each time, so that the product stays in 64 bits.
        _, key = np.unique(key * len(numbers) + codes[step : step + n], return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), dtype=bool)
    for step in range(width):
        covered[step : step + n] |= again
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """``STATS`` of one text."""
    words = text.split()
    letters = b"".join(words)
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    return (
        len(words),
        len(letters.translate(None, _CONTINUATION)),
        len(text.translate(None, _NOT_SYMBOLS)),
        again,
        repeated_words(words),
    )


def with_statistics(rows: DataFrame) -> DataFrame:
    """Add ``STATS`` to ``doc_id, host, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in utf8(batch.column(2))], dtype=np.int64)
            columns = [pa.array(c) for c in found.reshape(-1, len(STATS)).T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *columns],
                names=["doc_id", "host", "text", *STATS],
            )

    fields = [rows.schema["doc_id"], rows.schema["host"], rows.schema["text"]]
    schema = T.StructType([*fields, *[T.StructField(s, T.LongType()) for s in STATS]])
    return rows.mapInArrow(run, schema)


def normal_lines(text: Column) -> Column:
    """Lines in lower case with digits as 0 and blanks run together; wordless lines go."""
    even = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.split(F.regexp_replace(even, "[0-9]", "0"), "\n", -1)
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def hashed_lines(text: Column) -> Column:
    """(hash, words) of every normalised line, in order."""
    return F.transform(
        normal_lines(text),
        lambda x: F.struct(F.xxhash64(x).alias("hash"), word_count(x).alias("words")),
    )


def shared_lines(lines: DataFrame, ratio: float, least: int) -> DataFrame:
    """``host, common``: per host the hashes of lines in too many of its documents.

    ``lines`` has ``host, content, hashes``. Documents with equal content count once, so a text with
    many copies does not turn its own lines into boilerplate. Both counts combine on the map side.
    """
    each = (
        lines.select("host", "content", F.explode("hashes").alias("hash"))
        .distinct()
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    documents = (
        lines.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    )
    often = each.join(documents, each["host"].eqNullSafe(documents["host"])).where(
        F.col("n") > F.col("docs") * F.lit(ratio)
    )
    return often.groupBy(each["host"]).agg(F.sort_array(F.collect_list("hash")).alias("common"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = 0.1,
    least: int = 10,
    min_words: int = 50,
    min_left: float = 0.5,
) -> DataFrame:
    """``doc_id, STATS, words_left, base_failed, kept``, one row per row of ``docs``.

    Base rules: fewer than ``min_words`` words, or more than half of the words in repeated windows.
    Then lines are removed that stand in more than ``ratio`` of the distinct documents of their host
    and in ``least`` of them or more; a document that keeps fewer than ``min_words`` words or less
    than ``min_left`` of its words is depleted and rejected. Null text has no word; documents
    without host are one host. Other columns are ignored.

    The text is read once; what is settled and shuffled are statistics and line hashes.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")
    )
    marked = settle(
        with_statistics(rows).select(
            "doc_id",
            "host",
            *STATS,
            F.xxhash64("text").alias("content"),
            hashed_lines(F.col("text")).alias("lines"),
        )
    )
    common = settle(
        shared_lines(marked.select("host", "content", F.col("lines.hash").alias("hashes")), ratio, least)
    )
    met = marked["host"].eqNullSafe(common["host"])
    joined = marked.join(common, met, "left").drop(common["host"])
    stays = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("common", x["hash"]), F.lit(False)))
    left = F.aggregate(stays, F.lit(0).cast("long"), lambda total, x: total + x["words"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("words_left") < min_words) | (
        F.col("words_left") < F.lit(min_left) * F.col("n_words")
    )
    return (
        joined.withColumn("words_left", left)
        .withColumn("base_failed", failed)
        .select("doc_id", *STATS, "words_left", "base_failed", (~failed & ~depleted).alias("kept"))
    )
