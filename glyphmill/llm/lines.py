"""Line deduplication over all documents, by range-partitioned hashes.

``keep_bitmaps`` finds the lines to drop.  Line hashes are range-partitioned by
(hash, document from the largest down, position) and sorted within the
partitions, so each partition is a stream in which the first occurrence of a
line is the one to keep.  A line's run may go on over several partitions (a
line of a third of all documents does): each partition gives a summary of its
first and last run, at most two rows, and those, added up, decide what is open
there.  No line's rows ever have to meet in one task.  What returns for a
document is a compressed bitmap of its lines, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import row_key, with_key, written
from .textscan import ASCII_LOWER, WHITE, slabs, tidied

LEAST_CHARS = 20
LEAST_DOCS = 3

#: Any document id is larger; stands for null, so that null is the smallest document.
NO_ID = -(1 << 63)

LINES = "h1 long, h2 long, doc long, row_key long, pos int"
STREAM = "kind int, h1 long, h2 long, doc long, row_key long, pos int, docs long"
DROP, OPEN, RUN = 0, 1, 2


def _keys(text: bytes, least_chars: int):
    """(position, key) of the lines whose key is long enough."""
    for pos, line in enumerate(text.translate(ASCII_LOWER).split(b"\n")):
        key = line.strip(WHITE)
        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
            yield pos, key


def _hashed(least_chars: int):
    def run(batches):
        for batch in batches:
            docs = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rows = batch.column("row_key").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for lo, hi, data, offsets in slabs(texts):
                at, pos, hashes = [], [], []
                for k in range(hi - lo):
                    for p, key in _keys(data[offsets[k] : offsets[k + 1]], least_chars):
                        at.append(lo + k)
                        pos.append(p)
                        hashes.append(xxhash.xxh3_128_digest(key))
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                at = np.array(at, np.int64)
                columns = [h[:, 0], h[:, 1], docs[at], rows[at], np.array(pos, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["h1", "h2", "doc", "row_key", "pos"])

    return run


def _streamed(least_docs: int):
    """Over one sorted partition: what is certain, what is open, and the runs that may go on elsewhere."""
    names = ["kind", "h1", "h2", "doc", "row_key", "pos", "docs"]

    def out(kind, h1, h2, doc, row, pos, docs):
        n = len(h1)
        columns = [np.full(n, kind, np.int32), h1, h2, doc, row, pos, docs]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    def settle(held, first, last):
        """Rows of whole runs; first, last: whether they begin or end the partition."""
        h1, h2, doc, row, pos = (np.concatenate(c) for c in zip(*held))
        n = len(h1)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        docs = np.add.reduceat(fresh.astype(np.int64), begin)
        # Documents go down, so a run's first document is the one that keeps the line.
        drop = (docs[run] >= least_docs) & (doc != doc[begin][run])
        edge = np.zeros(len(begin), bool)
        edge[0] |= first
        edge[-1] |= last
        sure = drop & ~edge[run]
        yield out(DROP, h1[sure], h2[sure], doc[sure], row[sure], pos[sure], docs[run][sure])
        wait = edge[run]
        yield out(OPEN, h1[wait], h2[wait], doc[wait], row[wait], pos[wait], docs[run][wait])
        b = begin[edge]
        yield out(RUN, h1[b], h2[b], doc[b], row[b], pos[b], docs[edge])

    def run(batches):
        # The last run of a batch waits for the next batch, as it may go on there.
        held, first = [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "row_key", "pos")]
            if held:
                old = held[-1]
                if not (old[0][-1] == new[0][0] and old[1][-1] == new[1][0]):
                    yield from settle(held, first, False)
                    held, first = [], False
            same = (new[0] == new[0][-1]) & (new[1] == new[1][-1])
            tail = int(np.argmax(same))
            if tail:
                yield from settle([*held, [c[:tail] for c in new]], first, False)
                held, first = [], False
            held.append([c[tail:] for c in new])
        if held:
            yield from settle(held, first, True)

    return run


def _packed(batches):
    for batch in batches:
        keep = [bitmap(x.values.to_numpy()) for x in batch.column("dropped")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row_key"), pa.array(keep, pa.binary())], ["doc", "row_key", "keep"])


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, partitions: int | None = None) -> DataFrame:
    """(doc, row_key, keep) of the documents that lose lines: see ``bitmap``; doc is doc_id, NO_ID where that is null.

    A line's key is the line without white space at its ends, A-Z in lower case.
    Keys of ``least_chars`` code points or more that ``least_docs`` documents hold
    stay in the largest doc_id only.  Rows with one doc_id are one document; a
    null doc_id is a document too, the smallest.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, as the cuts of the ranges take a pass over them of their own.
    lines = written(with_key(docs).mapInArrow(tidied(_hashed(least_chars)), LINES), "line-hashes")
    order = ["h1", "h2", F.col("doc").desc(), "pos"]
    found = lines.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order)
    found = written(found.mapInArrow(tidied(_streamed(least_docs)), STREAM), "line-runs")
    # At most two rows a partition, so this side is small whatever the input.
    whole = found.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("keeper"))
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(whole), ["h1", "h2"]).where((F.col("all_docs") >= least_docs) & (F.col("doc") < F.col("keeper")))
    columns = ["doc", "row_key", "pos"]
    drops = found.where(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))
    dropped = drops.groupBy("doc", "row_key").agg(F.collect_set("pos").alias("dropped"))
    return dropped.mapInArrow(tidied(_packed), "doc long, row_key long, keep binary")


def bitmap(dropped) -> bytes:
    """One bit a line, 0: drop, 1: keep, compressed; lines beyond the last bit are kept."""
    dropped = np.asarray(dropped, np.int64)
    keep = np.ones(int(dropped.max()) // 8 * 8 + 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def dropped_lines(packed: bytes | None) -> np.ndarray:
    """Positions whose bit in the bitmap is 0."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)) == 0) if packed else np.zeros(0, np.int64)


def kept_lines(text: bytes, packed: bytes | None) -> tuple[bytes, int, int]:
    """The text without the lines that its bitmap drops, the number of its lines and of those dropped."""
    gone = dropped_lines(packed)
    if not len(gone):
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    keep = np.ones(len(lines), bool)
    keep[gone] = False
    return b"\n".join([line for line, k in zip(lines, keep.tolist()) if k]), len(lines), len(gone)


def with_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of docs (doc_id, row_key, ...) with the bitmap ``keep`` of its lines, null where all stay; docs need text, too."""
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), row_key().alias("__key")]
    gone = keep_bitmaps(docs, least_chars, least_docs).select(F.col("doc").alias("__doc"), F.col("row_key").alias("__key"), F.col("keep").alias("__keep"))
    return docs.select("*", *keys).join(gone, ["__doc", "__key"], "left").drop("__doc", "__key")


def _digests(batches):
    for batch in batches:
        out, n, k = [], [], []
        for text, keep in zip(batch.column("text"), batch.column("__keep")):
            kept, lines, gone = kept_lines(text.as_py() or b"", keep.as_py())
            out.append(hashlib.sha256(kept).hexdigest())
            n.append(lines)
            k.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """What query op9_lines returns: a row for every row of docs.

    Null and empty texts have one empty line, which stays; other columns are not
    looked at; rows with one doc_id are one document, repeated rows repeat; an
    empty table gives an empty one.
    """
    both = with_bitmaps(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "__keep")
    return both.mapInArrow(tidied(_digests), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def rewritten(docs: DataFrame) -> DataFrame:
    """docs, same columns, each text with only the lines that stay, null texts null; n_chars follows if there is one."""
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts = batch.column("text")
            out = [None if t is None else kept_lines(t.encode(), k)[0].decode() if k else t for t, k in zip(texts.to_pylist(), batch.column("__keep").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if n == "text" else batch.column(n) for n in names], names)

    new = with_bitmaps(docs).mapInArrow(tidied(cut), docs.schema)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else new
