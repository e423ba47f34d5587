"""Continuous collection: first-seen rows and incremental loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.listing import keep_first
from ..operators.load import load_day
from ..sources.tables import Tables


def first_seen_stream(rows: DataFrame, keys: Sequence[str], ts: str, delay: str = "2 days") -> DataFrame:
    """Drops a row whose key came less than ``delay`` before. A key is forgotten, and its state
    freed, once the watermark has passed that time."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def first_seen_into(rows: DataFrame, keys: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Append to ``folder`` the rows whose key it does not hold yet: the result is the same for any cut into batches.

    The folder is the only memory of keys, so nothing grows in the stream's state; a batch run again replaces what it wrote.
    """
    keys = list(keys)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = keep_first(batch, keys, F.struct(*batch.columns))
        if number:
            stored = StructType([*batch.schema.fields, StructField("batch", LongType())])
            known = spark.read.schema(stored).parquet(folder).where(F.col("batch") < number)
            once = once.join(known.select(*keys), keys, "left_anti")
        once.select(*batch.columns, F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder, which may be a table written in parts; a glob may also name a single file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def write_available(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything that has landed, then stop; the checkpoint stands for the hand-over flag."""
    return (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(folder))


def load_available(rows: DataFrame, tables: Tables, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Runs the normalising load per micro-batch. A replayed batch finds its load committed and does nothing."""

    def load(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            load_day(tables, f"{name}-{number}", batch)
        finally:
            batch.unpersist()

    return (rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
