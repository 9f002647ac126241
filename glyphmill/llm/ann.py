"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Equal vectors are one class with its smallest ids, so a vector that a third of
all rows have is one entry.  Coarse centroids and codebooks are fitted on a
bounded sample; every class is then put on its centroid's list, as one byte for
each part of its residual.  A query looks at the lists of its nearest centroids.
Its distance to an entry is asymmetric: the query's own vector against the entry's
code.  It is added up from tables: the query's products with each code of each
part, its distance to the list's centroid, and what is the entry's alone.  The
nearest entries by that measure are ranked anew by the exact distance of the
original vectors.

Entries are dealt into bundles of bounded size, some short lists or a part of a
long one, and a bundle's queries into chunks; each bundle and chunk is one group,
so no list has to fit in a task.  A group returns of each query only the nearest.
How entries are dealt changes nothing in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textscan import tidied

NEAREST = 10
#: Classes that centroids and codebooks are fitted on, at most; drawn by hash of id.
SAMPLE = 20_000
MOST_LISTS = 1024
PARTS, CODES = 16, 256
#: Lists for each root of the number of classes, up to MOST_LISTS: short lists follow what structure there is more closely.
LISTS_A_ROOT = 4
#: Share of the lists that a query looks at, and the fewest.
PROBE_SHARE, LEAST_PROBES = 0.4, 8
#: Entries ranked anew for each query, as a multiple of the neighbours asked for.
RERANK = 20
#: Entries of a bundle, so that there are some bundles a core, and queries of a chunk.
LEAST_CHUNK, MOST_CHUNK, QUERY_CHUNK = 1_000, 20_000, 500


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = counts > 0
        c[full] = sums[full] / counts[full, None]
        if not full.all():
            c[~full] = x[r.choice(len(x), int((~full).sum()))]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([squared(x[i : i + block], c).argmin(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        lists = nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1) if len(codes) else np.zeros((0, self.cuts[-1]))

    def distances(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to each entry, given by list and code: |q - c|^2 + |r|^2 + 2 c r - 2 q r."""
        numbers, at = np.unique(lists, return_inverse=True)
        rest, centres = self.decoded(codes), self.centroids[lists]
        out = squared(q, self.centroids[numbers]).astype(np.float32)[:, at]
        out += ((rest * rest).sum(1) + 2 * (centres * rest).sum(1)).astype(np.float32)
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            table = (2 * (q[:, a:b] @ book.T)).astype(np.float32)
            out -= table[:, codes[:, k]]
        return out


def fit(sample: np.ndarray, n: int, seed: int = 1) -> Model:
    """From a sample of n classes in all."""
    dim = sample.shape[1]
    k = int(min(MOST_LISTS, max(1, round(LISTS_A_ROOT * n**0.5)), max(1, len(sample) // 4)))
    centroids = kmeans(sample, k, seed=seed)
    rest = sample - centroids[nearest(sample, centroids)]
    cuts = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int).tolist()
    books = [kmeans(rest[:, a:b], min(CODES, len(rest)), seed=seed + a + 1) for a, b in zip(cuts, cuts[1:])]
    return Model(centroids, books, cuts)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with finite components only, not all 0, of the length that most have (of equally many, the smallest)."""
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    length = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (length.d if length else 0))


def classes(fine: DataFrame, most: int) -> DataFrame:
    """(cls, ids, v): equal vectors once, with their `most` smallest ids in order; cls is the smallest."""
    keyed = fine.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # The filter on the rank is applied before the shuffle as well, so a frequent vector sends few rows.
    ranked = keyed.withColumn("k", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("k") <= most)
    one = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    return one.select(F.col("ids")[0].alias("cls"), "ids", "v")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _encoded(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists, codes = shared.value.encode(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["cls", "list", "code"])

    return run


def bundles(sizes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each list its first bundle and the number of bundles it is dealt out over, and the number of all.

    A bundle is some short lists, or a part of a long one, about `chunk` entries.
    """
    first, parts, number, fill = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if fill and fill + n > chunk:
            number, fill = number + 1, 0
        first[k], parts[k] = number, max(1, -(-n // chunk))
        fill += n
        if parts[k] > 1:
            number, fill = number + int(parts[k]), 0
    return first, parts, number + 1


def _probing(shared, sizes: np.ndarray, chunk: int, share: float, enough: int):
    """Of each query the lists that it looks at, a row for each bundle of them."""
    first, parts, _ = bundles(sizes, chunk)

    def run(batches):
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            order = squared(x, model.centroids).argsort(1, kind="stable")
            probes = max(LEAST_PROBES, int(np.ceil(share * len(sizes))))
            # More lists where these hold few entries.
            need = np.maximum(probes, (np.cumsum(sizes[order], 1) < enough).sum(1) + 1)
            at, bundle, lists = [], [], []
            for i, k in enumerate(np.minimum(need, len(sizes)).tolist()):
                own: dict[int, list[int]] = {}
                for number in np.sort(order[i, :k]).tolist():
                    for b in range(int(first[number]), int(first[number] + parts[number])):
                        own.setdefault(b, []).append(number)
                at += [i] * len(own)
                bundle += own
                lists += own.values()
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), pa.array(bundle, pa.int32()), pa.array(lists, pa.list_(pa.int32())), batch.column("v").take(rows)], ["query_id", "bundle", "lists", "v"])

    return run


def _searched(shared, keep: int):
    def run(key, entries, queries):
        out = []
        if entries.num_rows and queries.num_rows:
            cls, lists = entries["cls"].to_numpy(), entries["list"].to_numpy()
            codes = np.frombuffer(b"".join(entries["code"].to_pylist()), np.uint8).reshape(len(cls), -1)
            wanted = queries["lists"].combine_chunks()
            looks = np.zeros((queries.num_rows, len(shared.value.centroids)), bool)
            looks[np.repeat(np.arange(queries.num_rows), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()] = True
            about = shared.value.distances(_matrix(queries["v"]), lists, codes)
            about[~looks[:, lists]] = np.inf
            if len(cls) > keep:
                best = np.argpartition(about, keep - 1, 1)[:, :keep]
            else:
                best = np.tile(np.arange(len(cls)), (len(about), 1))
            near = np.take_along_axis(about, best, 1)
            row, column = np.nonzero(np.isfinite(near))
            out = [queries["query_id"].to_numpy()[row], cls[best[row, column]], near[row, column]]
        return pa.table({name: pa.array(out[i] if out else [], kind) for i, (name, kind) in enumerate((("query_id", pa.int64()), ("cls", pa.int64()), ("about", pa.float32())))})

    return run


def distance(a: str, b: str):
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, queries: DataFrame, nearest_k: int = NEAREST, share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of vectors to each row (query_id, v) of queries, but for those with its id.

    Rows that repeat an id and a vector count once; vectors of one id that differ
    are rows of their own.  Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    whole = written(classes(usable(vectors), nearest_k + 1), "vectors")
    n = whole.count()
    rows = whole.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("v").toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = fit(_matrix(rows["v"]), n)
    shared = spark.sparkContext.broadcast(model)
    entries = written(whole.select("cls", "v").mapInArrow(tidied(_encoded(shared)), "cls long, list int, code binary"), "codes")
    sizes = np.zeros(len(model.centroids), np.int64)
    for r in entries.groupBy("list").count().collect():  # as many rows as there are lists, MOST_LISTS at most
        sizes[r["list"]] = r["count"]
    keep = RERANK * nearest_k
    cores = spark.sparkContext.defaultParallelism
    chunk = int(min(MOST_CHUNK, max(LEAST_CHUNK, n // (4 * cores))))
    first, parts, number = bundles(sizes, chunk)
    probes = written(queries.select("query_id", "v").mapInArrow(tidied(_probing(shared, sizes, chunk, share, 2 * keep)), "query_id long, bundle int, lists array<int>, v array<double>"), "probes")
    # A row a list, MOST_LISTS at most.
    plan = F.broadcast(spark.createDataFrame([(k, int(b), int(n)) for k, (b, n) in enumerate(zip(first, parts))], "list int, first int, parts int"))
    dealt = entries.join(plan, "list").withColumn("bundle", (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))).cast("int"))
    asked = probes.groupBy("bundle").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("query_chunks"))
    left = dealt.join(asked, "bundle").withColumn("query_chunk", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)))
    right = probes.join(asked, "bundle").withColumn("query_chunk", F.pmod(F.xxhash64("query_id"), F.col("query_chunks")).cast("int"))
    keys = ["bundle", "query_chunk"]
    # Dealt by number, so that groups which are small to read and long to search are not put together.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(number, 4 * cores))
    left, right = (df.select(*keys, *columns).repartition(parts, *keys).groupBy(*keys) for df, columns in ((left, ("cls", "list", "code")), (right, ("query_id", "lists", "v"))))
    found = left.cogroup(right).applyInArrow(_searched(shared, keep), "query_id long, cls long, about float")
    best = Window.partitionBy("query_id").orderBy("about", "cls")
    short = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= keep).select("query_id", "cls")
    exact = short.join(queries.withColumnRenamed("v", "q"), "query_id").join(whole, "cls").withColumn("score", distance("q", "v")).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").distinct()
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return exact.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= nearest_k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """What query op2_ann returns: neighbours of the vectors whose id is divisible by 100; of several with one id, the smallest."""
    queries = usable(vectors).where("vec_id % 100 = 0").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return search(vectors, queries)
