"""Exact deduplication on streaming state: one entry per digest, kept without expiry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm.text import one_spaced, whole
from tapegrid.session import settle, shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# A store takes the space it fills; reserving 4 MB ahead adds up over many small partitions.
RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of a normalised text."""
    return F.sha2(text.cast("binary"), 256)


FILE, ROW = "_kept_file", "_kept_row"


def _located(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row number of each row's content; settled if it has none."""
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return settle(docs).select("*", *place)


def _first() -> Column:
    """Of equal texts the smallest id, null last; rows that repeat the id by their place."""
    order = F.col("doc_id").isNull().alias("missing"), "doc_id", FILE, ROW
    return F.min(F.struct(*order)).alias("first")


def digest_state(keys: str, spark: SparkSession, files_per_batch: int | None = None) -> DataFrame:
    """``digest, first, group_size`` after every file of ``keys`` went through the stream.

    A streaming aggregation keeps, per digest, the stable id and the content locator of the row to
    keep, and a count, in RocksDB: on the executors' disks, with snapshots in the shared folder, and
    without watermark, so no entry ever expires. Each micro-batch writes the entries it changed
    under its own number, so a repeated batch overwrites itself; the last change of a digest is its
    state. ``files_per_batch`` bounds a micro-batch.
    """
    work = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    changes = f"{work}/changes"
    schema = spark.read.parquet(keys).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = (
        reader.parquet(keys)
        .groupBy("digest")
        .agg(_first(), F.count(F.lit(1)).alias("group_size"))
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    wanted = {PROVIDER: ROCKSDB, RESERVE: "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/state")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    id_type = schema["doc_id"].dataType.simpleString()
    first = f"struct<missing:boolean,doc_id:{id_type},{FILE}:string,{ROW}:bigint>"
    kind = f"digest string, first {first}, group_size bigint, batch int"
    try:
        saved = spark.read.schema(kind).parquet(changes)
    except AnalysisException:  # no file, hence no batch and no folder
        saved = spark.createDataFrame([], kind)
    return saved.groupBy("digest").agg(
        F.max_by("first", "batch").alias("first"), F.max("group_size").alias("group_size")
    )


def _groups(
    located: DataFrame, id_col: str, text_col: str, digest: Digest, files_per_batch: int | None
) -> DataFrame:
    spark = located.sparkSession
    place = [FILE, ROW]
    normal = one_spaced(whole(text_col))
    keys = f"{shared_folder(spark)}/tapegrid/{uuid.uuid4().hex}"
    located.select(
        F.col(id_col).alias("doc_id"), digest(normal).alias("digest"), *place
    ).write.parquet(keys)
    rows = spark.read.parquet(keys)
    state = settle(digest_state(keys, spark, files_per_batch))
    hits = rows.join(state.where(F.col("group_size") > 1).select("digest"), "digest")
    texts = located.select(normal.alias("_text"), *place)
    same = (
        hits.join(texts, place)
        .groupBy("digest", "_text")
        .agg(_first(), F.count(F.lit(1)).alias("group_size"))
    )
    checked = settle(same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")))
    disputed = checked.where(F.col("texts") > 1).select("digest")
    answer = rows.join(state, "digest")
    if not disputed.isEmpty():
        apart = (
            hits.join(disputed, "digest")
            .join(texts, place)
            .join(same.join(disputed, "digest"), ["digest", "_text"])
            .drop("_text")
        )
        answer = answer.join(disputed, "digest", "left_anti").unionByName(apart)
    own = F.col(f"first.{FILE}").eqNullSafe(F.col(FILE)) & (F.col(f"first.{ROW}") == F.col(ROW))
    return answer.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        own.alias("kept"),
        "digest",
        *place,
    )


def group_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Digest = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest``, one row per row of ``docs``.

    Texts are equal when identical after every run of space, tab, line feed, vertical tab, form feed
    and carriage return became one space; null is the empty text. ``keep_id`` is the smallest id of
    the equal texts (null only if all are null) and exactly one row of a group is ``kept``, also
    where rows repeat an id. Columns besides id and text are ignored.

    The stream sees digests, ids and places. A hit (a digest met more than once) is settled by its
    full bytes: the hit rows are grouped by digest and text, which compares the texts themselves
    and keeps one of them per task before the shuffle. Digests that cover different texts are
    regrouped by text.
    """
    return _groups(_located(docs), id_col, text_col, digest, files_per_batch).drop(FILE, ROW)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group of equal texts with the smallest id, all columns kept."""
    located = _located(docs)
    groups = _groups(located, id_col, text_col, sha256, None)
    gone = groups.where(~F.col("kept")).select(FILE, ROW)
    return located.join(gone, [FILE, ROW], "left_anti").drop(FILE, ROW)
