"""Saved tables: bars, features, predictions, result tables and small choices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.functions.columns import rounded
from tapegrid.session import settle


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, one folder per partition key, so a reader of one coin opens only its files."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, digits: int = 6) -> None:
    rounded(df, digits).write.mode("overwrite").option("header", "true").csv(path)


def write_choice(df: DataFrame, path: str, digits: int = 6) -> None:
    """A one-row decision as JSON."""
    rounded(df, digits).coalesce(1).write.mode("overwrite").json(path)


def read_choice(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted keys that the store lacks."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


class PredictionStore:
    """Predictions computed once per key and appended to one partitioned table.

    A key is a value of every key column. It counts as stored once it stands in the ledger, which is
    written after its rows, so a job that fails half-way leaves no key that looks finished.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.keys = spark, list(keys)
        self._rows, self._ledger = f"{path}/rows", f"{path}/keys"

    def _stored(self, wanted: DataFrame) -> DataFrame:
        try:
            return self.spark.read.parquet(self._ledger)
        except AnalysisException:  # nothing is stored yet
            return wanted.limit(0)

    def get(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of all ``wanted`` keys; those missing are computed and appended first.

        ``compute`` gets the table of missing keys and returns rows with all key columns.
        """
        wanted = wanted.select(*self.keys).distinct()
        missing = settle(missing_keys(wanted, self._stored(wanted), self.keys))
        if not missing.isEmpty():
            fresh = compute(missing).join(missing, self.keys, "left_semi")
            save(fresh, self._rows, self.keys, mode="append")
            save(missing, self._ledger, mode="append")
        rows = self.spark.read.parquet(self._rows)
        types = dict(wanted.dtypes)
        typed = rows.withColumns({k: F.col(k).cast(types[k]) for k in self.keys})
        return typed.join(wanted, self.keys, "left_semi")
