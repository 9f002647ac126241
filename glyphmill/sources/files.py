"""Files in and rows out: object stores, strict text, appended scans, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .media import extension, route


def files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 15_000_000) -> DataFrame:
    """asset_id, name, content and kind of files up to a size; larger ones are never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(F.col("path").alias("asset_id"), name.alias("name"), "content", route(name).alias("kind"), F.col("modificationTime").alias("modified"))


def strict_text(rows: DataFrame) -> DataFrame:
    """Text files as text; those that are not valid UTF-8 are left out."""
    return rows.where((F.col("kind") == "text") & F.is_valid_utf8(F.col("content").cast("string"))).select("asset_id", "name", extension(F.col("name")).alias("extension"), F.decode("content", "UTF-8").alias("text"))


def append_scans(rows: DataFrame, folder: str) -> None:
    """Rows to a Parquet table by day; a day that is written again adds to it."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(folder)


def reports(rows: DataFrame, key: str) -> DataFrame:
    """key and one JSON text of all other columns."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("report"))
