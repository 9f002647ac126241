"""What several operators need: shared folders, row keys, bounded broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_tables: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df by way of a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    return len(_tables)


def release(spark: SparkSession, since: int, last: int = 0, names: tuple[str, ...] = ()) -> None:
    """Delete the tables that `written` has made after the first `since`, but for the last ones, all or those of these names.

    Nothing may still be computed from them.  The collection lets the cleaner remove the shuffle files of finished steps, too.
    """
    end = len(_tables) - last
    gone = [t for t in _tables[since:end] if not names or t.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
    _tables[since:end] = [t for t in _tables[since:end] if t not in gone]
    context = spark.sparkContext
    for path in map(context._jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def row_key(text: str = "text"):
    """The same for rows that agree in doc_id and text, so for repeats only."""
    doc = F.col("doc_id").cast("long")
    return F.xxhash64(doc, doc.isNull(), F.col(text).cast("string"), F.col(text).isNull())


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text as binary, row_key)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        row_key(text).alias("row_key"),
    )


#: Pairs with one text on the right that a task gets, about.
PAIRS_A_TEXT = 64


def texts_beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, key_a, key_b, ...) with text_a and text_b, from texts (row_key, text); only texts that are needed travel.

    Many pairs may have one text on the right: it is copied as often as that
    needs, and its pairs are dealt out over the copies.
    """
    need = pairs.select(F.col("key_a").alias("row_key")).union(pairs.select("key_b")).distinct()
    if need.count() * 64 <= BROADCAST_BYTES:
        need = F.broadcast(need)
    texts = texts.select("row_key", "text").join(need, "row_key", "left_semi").dropDuplicates(["row_key"])
    hot = written(pairs.groupBy("key_b").agg(F.ceil(F.count("*") / PAIRS_A_TEXT).cast("int").alias("copies")).where("copies > 1"), "hot")
    # Joined without dealing the pairs out by key_b, where many would meet, as long as the list is short.
    if hot.count() * 16 <= BROADCAST_BYTES:
        hot = F.broadcast(hot)
    copies = F.coalesce("copies", F.lit(1))
    left = texts.select(F.col("row_key").alias("key_a"), F.col("text").alias("text_a"))
    right = texts.withColumnsRenamed({"row_key": "key_b", "text": "text_b"}).join(hot, "key_b", "left").select("key_b", "text_b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    numbered = pairs.join(hot, "key_b", "left").withColumn("copy", F.pmod(F.xxhash64("key_a"), copies).cast("int")).drop("copies")
    return numbered.join(left, "key_a").join(right, ["key_b", "copy"]).drop("key_a", "key_b", "copy")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, component), the smallest node of each.

    Each round gives every node the smallest label next to it and then the label
    of its label, so the labels along a path fall by halves.  Labels live in
    shared tables; only the number of changed labels comes to the driver.
    Minima are taken on the map side first, so a node with many edges is no hot key.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "low").alias("low"), F.col("component").alias("old"))
        # A node may have come under a label that has itself come under a lower one.
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = written(low.join(hop, "low").select("node", F.least("low", "next").alias("component"), "old"), "labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
