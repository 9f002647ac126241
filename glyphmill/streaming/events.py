"""Streams of events: each once, counted in windows, applied to a table.

The reference has no stream processor; these are the streaming forms of its
event handling (an event applied once, quotas, state by key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
KINDS = ("click", "view", "purchase", "signup", "error")


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark; state older than it is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counted(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and value by kind in tumbling or sliding windows; works on batches and streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of a user with no longer pause than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def _versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """The versions of each bucket of a table, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*/version=*")) or ():
        path = status.getPath()
        out.setdefault(int(path.getParent().getName().split("=")[1]), []).append(int(path.getName().split("=")[1]))
    return {k: sorted(v) for k, v in out.items()}


def latest_state(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """The table that ``upsert_latest`` keeps: of each bucket the last version."""
    paths = [f"{folder}/bucket={k}/version={v[-1]}" for k, v in _versions(spark, folder).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_latest(folder: str, key: str = "user_id", buckets: int = 64):
    """For foreachBatch: a table of each key's latest row, in buckets by hash of the key.

    A batch gives a new version of the buckets that its keys are in and leaves the
    others alone.  A batch that is given again writes its own versions again, from
    those before it, so a restart changes nothing; older ones go.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names = batch.columns
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        touched = {r.bucket for r in batch.select(bucket).distinct().collect()}  # as many rows as there are buckets
        before = {k: [x for x in v if x < number] for k, v in _versions(spark, folder).items() if k in touched}
        paths = [f"{folder}/bucket={k}/version={v[-1]}" for k, v in before.items() if v]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*paths)) if paths else batch
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("ts", "event_id")).alias("r")).select("r.*")
        out = latest.select("*", bucket, F.lit(number).alias("version"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(folder)
        # The version that this batch started from stays, as the batch may come again.
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        for k, v in before.items():
            for old in v[:-1]:
                path = fs.Path(f"{folder}/bucket={k}/version={old}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return apply


def quota(events: DataFrame, most: int):
    """A running count for each user in a stream, and whether each event is within the quota."""
    from collections.abc import Iterator

    import pandas as pd

    def run(key, frames: Iterator[pd.DataFrame], state):
        used = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            n = range(used + 1, used + len(frame) + 1)
            used += len(frame)
            yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"], "used": list(n), "allowed": [k <= most for k in n]})
        state.update((used,))

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, used bigint, allowed boolean", "used bigint", "append", "NoTimeout")
