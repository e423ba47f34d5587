"""Session helpers: reliable checkpoints, scratch folders, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may fall back to a folder of its own:
    on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


# Parquet looks at the size of what it holds after 100 rows at the earliest; for tables whose rows are megabytes, after each.
# Weights hardly compress, and (un)compressing takes buffers of a row's size outside the heap.
LARGE_ROWS = {"compression": "none", "parquet.block.size": str(1 << 25), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
              "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Cuts the lineage like a checkpoint and outlives lost executors, but as parquet:
    later steps read only the columns they use, and the planner knows the size.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table written during a job, next to the checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FEW_FILES = 8
TOGETHER = 4_096


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a scan of fewer than ``FEW_FILES`` files, which may have fewer splits than the machine has slots.

    Physical only: rows and results stay the same. Tables of many files are read as they are.
    """
    if 0 < len(df.inputFiles()) < FEW_FILES:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
    return df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt out evenly, some ``rows`` to a task at most, however many a file holds: for steps that take long for a row."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task. Steps by these keys then need no shuffle of their own, whatever they explode a row to.

    A task gets some ``TOGETHER`` rows at most, unless a key has more, so what it holds does not grow with the table.
    """
    tasks = -(-df.count() // TOGETHER)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def numbered(df: DataFrame, order: list[str], group: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``nth``: the place of a row, from 0, in ``order`` within its ``group``.

    Rows are dealt by ranges and counted there; across ranges only one row per range and group is summed, so neither
    a hot group nor the whole table is sorted by one task.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy("__part", *group).orderBy(*order)
    sizes = ranged.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    across = (Window.partitionBy(*group) if group else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(across), F.lit(0))).drop("__n")
    inside = ranged.withColumn("__i", F.row_number().over(here) - 1)
    return inside.join(bases, ["__part", *group]).withColumn("nth", F.col("__i") + F.col("__before")).drop("__part", "__i", "__before")
