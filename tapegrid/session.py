"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on: UTC clocks and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    A local master may fall back on a temporary folder; a cluster without the setting is an error,
    because a folder of one machine is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tapegrid-"))
    return context.getCheckpointDir()


def settle(
    df: DataFrame, partition_by: Sequence[str] = (), options: Mapping[str, str | int] | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's ``options``, and read it back.

    Later stages and retries then see the same rows whatever executor is lost, and a columnar table
    lets each reader open only the columns it needs, and only the folders of the keys it filters.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


class Scratch:
    """Settled tables that live no longer than a run: ``with Scratch(spark) as scratch`` deletes what
    ``scratch.settle`` wrote when the block ends, also on failure. ``replace`` writes a table and deletes
    the one it follows, for state that goes on from step to step.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tapegrid/run-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self._delete(self.folder)

    def settle(self, df: DataFrame) -> DataFrame:
        return self.replace(df, None)[0]

    def replace(self, df: DataFrame, former: str | None) -> tuple[DataFrame, str]:
        """The settled table and its path; ``former`` is the path of the table that goes."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        if former:
            self._delete(former)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns), path

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
