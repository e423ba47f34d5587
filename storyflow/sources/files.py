"""Article files: scans, by-name union, exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import ARRAY_MARK

ARTICLE_SCHEMA = (
    "source string, section string, section_url string, title string, url string, "
    "date string, image string, subheading string"
)
# Results of earlier steps that lie in the same folder.
NOT_COLLECTED = ("articles.csv", "simart.csv", "test.csv", "combined_data.csv")
MIN_FILE_BYTES = 2
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False}


def scan_articles(spark: SparkSession, folder: str, schema: str = ARTICLE_SCHEMA,
                  exclude: Sequence[str] = NOT_COLLECTED, glob: str = "*.csv") -> DataFrame:
    """All csv files below ``folder``, by name of column, but for excluded and empty ones."""
    rows = (
        spark.read.schema(schema).options(**CSV).option("enforceSchema", False)
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(folder))
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    return rows.where(~name.isin(*exclude) & (size > MIN_FILE_BYTES))


def write_by_source(articles: DataFrame, folder: str) -> None:
    """One folder per source; the source stays a column of the file too."""
    (articles.withColumn("part", F.col("source")).write.mode("overwrite").partitionBy("part")
     .options(header=True, quote='"', escape='"').option("emptyValue", "").csv(folder))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """By name; a column a source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def export_csv(rows: DataFrame, folder: str, mark: str = ARRAY_MARK) -> None:
    """Flat copy for other tools: arrays joined by ``mark``. Jobs hand over parquet instead."""
    cols = [F.array_join(f.name, mark).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in rows.schema.fields]
    rows.select(*cols).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(folder)
