"""Known items: exact labels by hash, nearest perceptual hashes, lineage pairs, duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Known fingerprints are broadcast at most so many rows at a time.
MOST_BROADCAST = 200_000


def in_blocks(known: DataFrame, key: str, match, most: int = MOST_BROADCAST) -> DataFrame:
    """match(block) for all of known, in blocks of about `most` rows by hash of key, and their union.

    Each block is small enough to be broadcast, so the other side is never shuffled.
    """
    n = max(1, -(-known.count() // most))
    out = None
    for k in range(n):
        part = match(known if n == 1 else known.where(F.pmod(F.xxhash64(key), F.lit(n)) == k))
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of the known side in a list, and queries compared with a list's rows at once.
LIST, AT_ONCE = 16384, 32


def beside(queries: DataFrame, known: DataFrame, key: str, most: int) -> DataFrame:
    """(queries, known): lists of known rows, dealt evenly, each beside the list of a block of queries.

    So a pair is no row: whoever compares the two lists keeps what is asked for.
    """
    cores = known.sparkSession.sparkContext.defaultParallelism
    n = max(cores, -(-known.count() // LIST))
    lists = known.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("__n")).agg(F.collect_list(F.struct(*known.columns)).alias("known"))
    lists = lists.select("known").repartition(min(n, 4 * cores))
    return in_blocks(queries, "query_id", lambda block: lists.join(F.broadcast(block.agg(F.collect_list(F.struct(*queries.columns)).alias("queries")))), most)


def _lists(batches, known_by: list[str]):
    """For each row of `beside`, the queries' columns and the known rows', by turns of LIST and in order of `known_by`."""
    asked = None
    for batch in batches:
        queries, known = batch.column("queries"), batch.column("known")
        for i in range(batch.num_rows):
            # A task has the queries of one block.
            asked = asked or {f.name: x for f, x in zip(queries.type.value_type, queries[i].values.flatten())}
            if len(next(iter(asked.values()))) == 0:
                return
            for lo in range(0, len(known[i].values), LIST):
                part = known[i].values.slice(lo, LIST)
                columns = {f.name: x for f, x in zip(part.type, part.flatten())}
                order = pa.array(np.lexsort([_numbers(columns[c]) for c in reversed(known_by)]))
                yield asked, {name: x.take(order) for name, x in columns.items()}


def _numbers(x: pa.Array, null=0) -> np.ndarray:
    return x.fill_null(null).to_numpy(zero_copy_only=False)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ, of each of a and each of b."""
    return np.bitwise_count(a[:, None].view(np.uint64) ^ b[None, :].view(np.uint64))


# Labels of a document's parts.
ITEM_LABELS = ("strong_ai_signal", "likely_ai_signal", "human_edit_candidate", "mixed_signal", "low_signal")


def exact_labels(items: DataFrame, truth: DataFrame, content: str = "text") -> DataFrame:
    """items with sha256, matched and label, by equal hash; an equi-join, so its plan is the optimiser's."""
    hashed = items.withColumn("sha256", F.sha2(F.col(content), 256))
    return hashed.join(truth.select(F.col("file_sha256").alias("sha256"), "label"), "sha256", "left").withColumn("matched", F.col("label").isNotNull())


def with_override(df: DataFrame, score: str = "score", items: str | None = None) -> DataFrame:
    """An exact match with label ai settles the score at 100, and with items (structs with label, score, ...) those of all items."""
    ai = F.col("matched") & F.coalesce(F.col("label") == "ai", F.lit(False))
    df = df.withColumn(score, F.when(ai, 100).otherwise(F.col(score)))
    if items is None:
        return df
    settled = F.transform(items, lambda x: x.withField("label", F.lit("strong_ai_signal")).withField("score", F.lit(100).cast("int")))
    return df.withColumn(items, F.when(ai, settled).otherwise(F.col(items)))


def item_counts(items: str = "items") -> Column:
    """How many items have each label."""
    count = lambda k: F.size(F.filter(items, lambda x: x["label"] == k)).cast("long")
    return F.struct(*(count(k).alias(k) for k in ITEM_LABELS))


def duplicate_groups(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """sha256, copies, first: texts that several rows have."""
    return docs.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def hex_longs(h: Column, n: int) -> list[Column]:
    """A hash of 16 n hexadecimal digits as n longs."""
    return [F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("long") for i in range(n)]


HAIR = 1e-9


def four_decimals(x: Column) -> Column:
    """Four decimals; a hair is added, so that exact halves go up on any engine."""
    return F.round(x + HAIR, 4)


def similarity(a: list[Column], b: list[Column]) -> Column:
    """1 less the share of bits that differ."""
    return 1 - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.bit_count(a[0].bitwiseXOR(b[0]))) / (64 * len(a))


#: Labels that begin so are told apart by the ladder of classes.
KINDS = ("ai", "human")


#: In place of ten-thousandths.
NO_SIMILARITY, NO_MATCH = -1, -2


def _decisive(batches):
    """(query_id, known_id, label, similarity) of the best match of each kind of label of a task's known ones, ties by known_id."""
    ids = None
    # 1 less the share of 256 bits, with its weight, by the number of bits.
    of_a, of_d = 0.40 * (1 - np.arange(257) / 256), 0.50 * (1 - np.arange(257) / 256)
    for asked, known in _lists(batches, ["kind", "known_id"]):
        if ids is None:
            ids, qr = _numbers(asked["query_id"]), _numbers(asked["ratio"])
            qa, qd = ([_numbers(x) for x in _longs(asked, name)] for name in "ad")
            q_none = _numbers(asked["none"], False)
            best = np.full((len(KINDS) + 1, len(ids)), NO_MATCH, np.int64)
            near = np.zeros_like(best)
            labels = [pa.nulls(len(ids), known["label"].type)] * len(best)
        every, kr, k_none = _numbers(known["known_id"]), _numbers(known["ratio"]), _numbers(known["none"], False)
        ka, kd = ([_numbers(x) for x in _longs(known, name)] for name in "ad")
        ends = np.searchsorted(_numbers(known["kind"]), np.arange(len(best) + 1))
        for kind, (b, e) in enumerate(zip(ends, ends[1:])):
            if b == e:
                continue
            vec = every[b:e]
            lo, hi = np.searchsorted(vec, ids), np.searchsorted(vec, ids, "right")
            place, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for q in range(0, len(ids), AT_ONCE):
                to = slice(q, q + AT_ONCE)
                a, d = (sum((_bits(x[to], y[b:e]) for x, y in zip(xs[1:], ys[1:])), _bits(xs[0][to], ys[0][b:e]).astype(np.uint16)) for xs, ys in ((qa, ka), (qd, kd)))
                most, least = np.maximum(qr[to, None], kr[b:e]), np.minimum(qr[to, None], kr[b:e])
                ratio = np.where(least > 0, np.maximum(0.0, 1 - (most - least) / np.where(least > 0, most, 1)), 1.0)
                s = np.floor(((of_a[a] + of_d[d] + 0.10 * ratio) + HAIR) * 10000 + 0.5).astype(np.int32)
                # Without a hash there is a match, but no similarity.
                s[:, k_none[b:e]] = s[q_none[to]] = NO_SIMILARITY
                for i in np.flatnonzero(hi[to] > lo[to]):
                    s[i, lo[q + i] : hi[q + i]] = NO_MATCH
                place[to] = s.argmax(axis=1)
                found[to] = s[np.arange(len(s)), place[to]]
            better = (found > best[kind]) | (found == best[kind]) & (vec[place] < near[kind])
            at = np.where(better, len(ids) + place, np.arange(len(ids)))
            labels[kind] = pa.concat_arrays([labels[kind], known["label"].slice(b, e - b)]).take(pa.array(at))
            best[kind], near[kind] = np.where(better, found, best[kind]), np.where(better, vec[place], near[kind])
    if ids is not None:
        for score, vec, label in zip(best, near, labels):
            there = pa.array(score > NO_MATCH)
            columns = [pa.array(ids), pa.array(vec), label, pa.array(score / 10000, mask=score == NO_SIMILARITY)]
            yield pa.RecordBatch.from_arrays([x.filter(there) for x in columns], ["query_id", "known_id", "label", "similarity"])


def _longs(columns: dict, name: str) -> list:
    return [columns[f"{name}{i}"] for i in range(4)]


def perceptual_matches(queries: DataFrame, known: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """(query_id, known_id, label, similarity): of each query with the known fingerprints of other ids, the matches that decide its class.

    Both have ahash256, dhash256 and aspect_ratio; ids are longs.  Queries are
    broadcast in blocks; every pair is compared, as numbers in one Arrow pass, and
    what ``perceptual_class`` asks for, the best match of each kind of label, with
    the smallest known_id, is all that travels, from each task.
    """

    def numbers(df: DataFrame, key: str, *more: Column) -> DataFrame:
        r = F.col("aspect_ratio").cast("double")
        hashes = [x.alias(f"{name}{i}") for name, h in (("a", "ahash256"), ("d", "dhash256")) for i, x in enumerate(hex_longs(F.col(h), 4))]
        out = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), *more, *hashes, F.when((r > 0) & (r < float("inf")), r).otherwise(0.0).alias("ratio"))
        return out.withColumn("none", F.greatest(*(F.col(f"{name}{i}").isNull() for name in "ad" for i in range(4))))

    label = F.coalesce("label", F.lit(""))
    kind = F.when(label.startswith(KINDS[0]), 0).when(label.startswith(KINDS[1]), 1).otherwise(2).alias("kind")
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("known_id", T.LongType()), T.StructField("label", known.schema["label"].dataType), T.StructField("similarity", T.DoubleType())])
    return beside(numbers(queries, "query_id"), numbers(known, "known_id", F.col("label"), kind), "known_id", most).mapInArrow(_decisive, out)


#: Numbers of bits that no two hashes differ by.
NO_HASH, NONE = 65, 66


def _nearest(k: int):
    """(query_id, vec_id, label, bits) of the k known ones of a task that are nearest to each query."""

    def run(batches):
        ids = None
        for asked, known in _lists(batches, ["vec_id"]):
            if ids is None:
                ids, qh = _numbers(asked["query_id"]), _numbers(asked["qh"])
                no_hash = _numbers(asked["qh"].is_null(), False)
                # A missing hash is farther than any other, NONE stands for no row at all.
                bits, near = np.full((len(ids), k), NONE, np.uint8), np.zeros((len(ids), k), np.int64)
                labels = pa.nulls(len(ids) * k, known["label"].type)
            vec, h, without = _numbers(known["vec_id"]), _numbers(known["h"]), _numbers(known["h"].is_null(), False)
            some = min(k, len(vec))
            lo, hi = np.searchsorted(vec, ids), np.searchsorted(vec, ids, "right")
            place, found = np.zeros((len(ids), some), np.int64), np.zeros((len(ids), some), np.uint8)
            for q in range(0, len(ids), AT_ONCE):
                d = _bits(qh[q : q + AT_ONCE], h)
                d[:, without] = d[no_hash[q : q + AT_ONCE]] = NO_HASH
                for i in np.flatnonzero(hi[q : q + AT_ONCE] > lo[q : q + AT_ONCE]):
                    d[i, lo[q + i] : hi[q + i]] = NONE
                # Known ones are in order of vec_id, so of equal distances the first place counts.
                first = np.partition(d.astype(np.int32) * len(vec) + np.arange(len(vec), dtype=np.int32), some - 1, axis=1)[:, :some]
                place[q : q + AT_ONCE], found[q : q + AT_ONCE] = first % len(vec), first // len(vec)
            labels = pa.concat_arrays([labels, known["label"].take(pa.array(place.ravel()))])
            at = np.concatenate([np.arange(len(ids) * k).reshape(-1, k), len(ids) * k + np.arange(place.size).reshape(-1, some)], axis=1)
            bits, near = np.concatenate([bits, found], axis=1), np.concatenate([near, vec[place]], axis=1)
            order = np.lexsort((near, bits), axis=1)[:, :k]
            bits, near, at = (np.take_along_axis(x, order, 1) for x in (bits, near, at))
            labels = labels.take(pa.array(at.ravel()))
        if ids is not None:
            there = pa.array((bits < NONE).ravel())
            columns = [pa.array(np.repeat(ids, k)), pa.array(near.ravel()), labels, pa.array(bits.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays([x.filter(there) for x in columns], ["query_id", "vec_id", "label", "bits"])

    return run


def nearest_hashes(queries: DataFrame, known: DataFrame, k: int = 5, most: int = MOST_BROADCAST) -> DataFrame:
    """Of each query (query_id, qh) the k known ones (vec_id, label, h) of other ids with the most equal bits, ties by vec_id.

    Ids are longs.  Queries are broadcast in blocks; every pair is compared, as
    numbers in one Arrow pass, and of each task's pairs only the first k of a query travel.
    """
    q = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long"), hex_longs(F.col("qh"), 1)[0].alias("qh"))
    v = known.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "label", hex_longs(F.col("h"), 1)[0].alias("h"))
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("label", known.schema["label"].dataType), T.StructField("bits", T.IntegerType())])
    near = beside(q, v, "vec_id", most).mapInArrow(_nearest(k), out)
    s = F.when(F.col("bits") < NO_HASH, F.round(1 - F.col("bits") / 64, 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("bits", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "label", s.alias("similarity"), "rank")


def perceptual_class(matches: DataFrame, query: str = "query_id") -> DataFrame:
    """Best match, best of either label, and a class by the ladder of thresholds."""
    ai, human = (F.col("label").startswith(k) for k in KINDS)
    best = matches.groupBy(query).agg(
        F.max("similarity").alias("best"), F.max_by("label", F.struct("similarity", -F.col("known_id"))).alias("best_label"),
        F.max(F.when(ai, F.col("similarity"))).alias("best_ai"), F.max(F.when(human, F.col("similarity"))).alias("best_human"),
    )
    margin = F.round(F.coalesce("best_ai", F.lit(0.0)) - F.coalesce("best_human", F.lit(0.0)), 4)
    out = best.withColumn("margin", margin)
    cls = F.when(F.col("best") >= 0.965, F.col("best_label")).when((F.col("best_ai") >= 0.90) & (F.col("margin") >= 0.045), "ai").when((F.col("best_human") >= 0.90) & (F.col("margin") <= -0.045), "human").otherwise("none")
    return out.withColumn("class", cls)


def pair_contrast(queries: DataFrame, known: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Each query against each lineage's synthetic and original image: similarities, margin and direction."""
    one = lambda role: known.where(F.col("lineage_role") == role).groupBy("lineage_group").agg(F.min_by(F.struct("phash64", "center_dhash64"), "known_id").alias(role))
    both = in_blocks(one("synthetic").join(one("original"), "lineage_group"), "lineage_group", lambda block: queries.join(F.broadcast(block)), most)

    def like(role: str) -> Column:
        p = similarity(hex_longs(F.col("phash64"), 1), hex_longs(F.col(f"{role}.phash64"), 1))
        c = similarity(hex_longs(F.col("center_dhash64"), 1), hex_longs(F.col(f"{role}.center_dhash64"), 1))
        return 0.58 * p + 0.42 * c

    s, o = like("synthetic"), like("original")
    return both.select("query_id", "lineage_group", four_decimals(s).alias("synthetic_similarity"), four_decimals(o).alias("original_similarity"), four_decimals(s - o).alias("margin"), F.when(s >= o, "synthetic").otherwise("original").alias("toward"))


def pair_class(contrast: DataFrame, most: int = 5) -> DataFrame:
    """The lineages with the widest margins, and the class of the widest."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.abs("margin")), "lineage_group"))
    top = contrast.withColumn("rank", rank).where(F.col("rank") <= most)
    cls = F.when((F.col("synthetic_similarity") >= 0.82) & (F.col("margin") >= 0.04), "ai").when((F.col("original_similarity") >= 0.82) & (F.col("margin") <= -0.04), "human").otherwise("none")
    return top.withColumn("class", F.when(F.col("rank") == 1, cls))


def sign_hash(vector: Column) -> Column:
    """64 bits of an array of 64 numbers: 1 where positive, the first one highest; as 16 hexadecimal digits."""
    nibble = lambda i: sum((F.when(F.get(vector, 4 * i + j) > 0, 1 << (3 - j)).otherwise(0) for j in range(1, 4)), F.when(F.get(vector, 4 * i) > 0, 8).otherwise(0))
    return F.concat(*(F.lower(F.hex(nibble(i).cast("long"))) for i in range(16)))


#: Ranges of a group's values within which its median is looked for.
RANGES = 256


def group_medians(df: DataFrame, value: str, by: str) -> DataFrame:
    """by, median: exact; no group's values have to meet in one task.

    Equal values are counted first.  Approximate quantiles cut a group's values into
    ranges; the ranges' counts say which one or two hold the middle, and only what
    lies there is put in order.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = counted.groupBy(by).agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("__cuts"))
    placed = counted.join(cuts, by).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    in_order = Window.partitionBy(by).orderBy("__r")
    ranges = placed.groupBy(by, "__r").agg(F.sum("__n").alias("__k"))
    ranges = ranges.withColumns({"__from": F.sum("__k").over(in_order) - F.col("__k"), "__all": F.sum("__k").over(Window.partitionBy(by))})
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    middle = ranges.where((F.col("__from") <= high) & (F.col("__from") + F.col("__k") > low)).drop("__k")
    rank = F.col("__from") + F.sum("__n").over(Window.partitionBy(by, "__r").orderBy("__v")) - F.col("__n")
    found = placed.join(middle, [by, "__r"]).withColumn("__rank", rank).where((F.col("__rank") <= high) & (F.col("__rank") + F.col("__n") > low))
    return found.groupBy(by).agg(((F.min("__v") + F.max("__v")) / 2).alias("median"))


def robust_z(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with med, mad and z: (value - median) / (1.4826 MAD + 1e-6) within each group."""
    around = df.join(group_medians(df, value, by).withColumnRenamed("median", "med"), by)
    far = group_medians(around.withColumn("__far", F.abs(F.col(value) - F.col("med"))), "__far", by)
    mad = far.select(by, F.greatest("median", F.lit(1e-6)).alias("mad"))
    return around.join(mad, by).withColumn("z", (F.col(value) - F.col("med")) / (1.4826 * F.col("mad") + 1e-6))
