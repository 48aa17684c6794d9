"""Word conventions shared by the operators, and small JVM-side helpers.

A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage
return. ``bytes.split()`` uses exactly that set, which ``str.split()`` does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows for the plans run inside: rows of long texts are large."""
    with _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextmanager
def read_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """The same for what a task reads of a columnar file at once."""
    with _held(spark, "spark.sql.parquet.columnarReaderBatchSize", rows):
        yield


@contextmanager
def _held(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole(text: str) -> Column:
    """Text column with null read as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text. Possessive, so that the matcher never steps back into a word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def one_spaced(text: Column) -> Column:
    return F.regexp_replace(text, GAP, " ")


def utf8(values: pa.Array) -> Iterator[bytes]:
    """The values of a string column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    for value in values.cast(kind):
        yield value.as_py() or b""
