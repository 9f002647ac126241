"""Exact n-gram Jaccard join that works along set relations, and its link components.

A document's set holds the 64-bit hashes of its distinct shingles.  Documents
with one set are one class from the start.  Then:

1.  Roots.  Of the smallest hash in each of 16 ranges of hashes, a set and the
    first document of a class that shares several of them are compared exactly.
    What returns is the answer for that pair and the *delta*: the shingles in
    one of the two only.  So a highly similar set stands for many others.
2.  Pairs below one root are answered from the deltas.  |x xor y| is
    |dx xor dy|.  Where the deltas share nothing, a link between x and y means that
    both are linked with the root, and nothing has to be computed; all other links
    share part of their deltas, and an inverted index over (root, delta shingle),
    the rarest first, finds those pairs, however many sets the root has.
3.  All other pairs come from an inverted index over prefixes of the sets.  Lists
    are cut into blocks in order of root, size and position; blocks are skipped
    by pairs when their roots, sizes or positions leave no link.

Candidates of steps 2 and 3 are compared exactly over whole texts.  Hash values
decide the order of a prefix, but shingles that are frequent within slabs come
last; any order gives the same answers, this one keeps the lists short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, row_key, texts_beside, with_key, written
from .textscan import Words, mix, slabs, tidied

SHINGLE = 4
PERCENT = 85
#: Shingles that the prefixes of two linked sets share at least (all, in small sets).
SHARED = 4
#: Ranges of hash values of which the smallest one is kept, and how many of them a set and its root have in common.
BINS = 16
ALIKE = 4
#: Sets are described by their root from this similarity on.
ROOT_PERCENT = 30
BLOCK = 256
#: Frequent shingles that are put last; a fixed bound.
FREQUENT = 1 << 18
IN_SLAB = 4

SHORT = np.uint64(0x5851F42D4C957F2D)  # fixed value: marks sequences shorter than a shingle
NO_ID = (1 << 63) - 1


def least_shared(n, percent: int):
    """Of a set of n, the fewest elements that a linked set shares with it."""
    return -(-percent * n // 100)


def sets(column, w: int):
    """For each slab: number of its first row, list of sorted distinct hashes."""
    for lo, hi, data, offsets in slabs(column):
        words = Words(data, offsets)
        s, first = words.shingles(w)
        out = []
        for k in range(hi - lo):
            if 0 < words.count[k] < w:
                h = words.hashes[words.first[k] : words.first[k + 1]]
                out.append(mix(np.bitwise_xor.reduce(mix(h + np.arange(1, len(h) + 1, dtype=np.uint64) * SHORT)) ^ np.full(1, len(h), np.uint64)))
            else:
                out.append(np.unique(s[first[k] : first[k + 1]]))
        yield lo, out


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _described(w: int):
    """One row a document: size, class of its set, smallest hashes by range, and on the first row of a slab its frequent shingles."""
    cuts = (np.arange(BINS, dtype=np.uint64) << np.uint64(60))

    def run(batches):
        for batch in batches:
            for lo, found in sets(batch.column("text"), w):
                n, cls, mins = [], [], []
                for u in found:
                    n.append(len(u))
                    cls.append(int(_signed(mix(mix(u).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(u))))[0]) if len(u) else 0)
                    at = np.searchsorted(u, cuts)
                    at = at[(at < len(u)) & (np.append(at[1:], len(u)) > at)]
                    mins.append(_signed(u[at]))
                token, count = np.unique(np.concatenate(found), return_counts=True)
                often = [_signed(token[count >= IN_SLAB])] + [None] * (len(found) - 1)
                part = batch.slice(lo, len(found))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(mins, longs), pa.array(often, longs)],
                    ["doc_id", "row_key", "n", "cls", "mins", "often"],
                )

    return run


def _prefixes(frequent, w: int, percent: int):
    """Rows of the inverted index: token, class, size, position in the set's order; copies within a batch once."""

    def run(batches):
        last = frequent.value
        for batch in batches:
            seen = set()
            for _, found in sets(batch.column("text"), w):
                rows = []
                for u in found:
                    if not len(u):
                        continue
                    cls = int(_signed(mix(mix(u).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(u))))[0])
                    if cls in seen:
                        continue
                    seen.add(cls)
                    n = len(u)
                    need = least_shared(n, percent)
                    size = n - need + min(SHARED, need)
                    if len(last):
                        at = np.searchsorted(last, u)
                        late = last[np.minimum(at, len(last) - 1)] == u
                        u = np.concatenate([u[~late], u[late]])
                    rows.append((u[:size], cls, n))
                if rows:
                    lengths = [len(r[0]) for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_signed(np.concatenate([r[0] for r in rows]))),
                            pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), lengths)),
                            pa.array(np.repeat(np.array([r[2] for r in rows], np.int32), lengths)),
                            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                        ],
                        ["token", "cls", "n", "pos"],
                    )

    return run


def shared_lists(names: list[str], own: int = 2):
    """Of rows sorted by the first `own` names, of which two are token and class: those whose token other classes have too.

    Of rows that agree in these names the first; a partition's first and last list
    whole, as they may go on elsewhere.
    """

    def settle(held, edge):
        columns = [np.concatenate(c) for c in zip(*held)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns[:own]], axis=0))
        columns = [c[new] for c in columns]
        token, cls = columns[:2]
        head = np.append(True, token[1:] != token[:-1])
        run = np.cumsum(head) - 1
        keep = np.bincount(run, np.append(True, (cls[1:] != cls[:-1]) | head[1:]))[run] > 1
        keep |= ((run == 0) & edge[0]) | ((run == run[-1]) & edge[1])
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)

    def run(batches):
        held, first = [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held and held[-1][0][-1] != new[0][0]:
                yield settle(held, (first, False))
                held, first = [], False
            tail = int(np.searchsorted(new[0], new[0][-1]))
            if tail:
                yield settle([*held, [c[:tail] for c in new]], (first, False))
                held, first = [], False
            held.append([c[tail:] for c in new])
        if held:
            yield settle(held, (first, True))

    return run


def _blocks(batches):
    """Number the blocks of lists: at most BLOCK rows in succession, of one token."""
    from pyspark import TaskContext

    block, token, rows = TaskContext.get().partitionId() << 33, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column("token").to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        sizes = np.diff(np.append(begin, len(tokens)))
        carried = rows if token == tokens[0] else 0
        within = np.arange(len(tokens)) - np.repeat(begin, sizes)
        within[: sizes[0]] += carried
        fresh = within % BLOCK == 0
        number = block + np.cumsum(fresh)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, "block"])
        block, token, rows = int(number[-1]), tokens[-1], int(within[-1]) + 1


ENTRY = "token long, cls long, grp long, n int, pos int, len int"


def _paired(lists: DataFrame, parts: int, possible, block_possible) -> DataFrame:
    """(a, b) for each list and each two of its entries of two groups that `possible` admits; a < b.

    lists: token, cls, grp, n, pos, len.  Lists are range-partitioned over all
    of their order, so that a long one is spread over partitions.
    """
    order = ["token", "grp", "n", "pos", "cls"]
    lists = written(lists.select("token", "cls", "grp", "n", "pos", "len"), "entries")
    # A list of one group has nothing to pair.  Written, so that both sides of the join are dealt anew and a long list is split.
    mixed = written(lists.groupBy("token").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 < g1").select("token"), "mixed")
    lists = lists.join(mixed, "token", "left_semi")
    cut = written(lists.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(_blocks), ENTRY + ", block long"), "index")
    about = cut.groupBy("token", "block").agg(*(f(c).alias(f"{c}{k}") for c in ("n", "pos", "grp") for k, f in enumerate((F.min, F.max))))
    x, y = about.alias("p"), about.alias("q")
    one_group = (F.col("p.grp0") == F.col("p.grp1")) & (F.col("q.grp0") == F.col("q.grp1")) & (F.col("p.grp0") == F.col("q.grp0"))
    two = x.join(y, "token").where((F.col("p.block") <= F.col("q.block")) & ~one_group & block_possible("p", "q"))
    two = two.select("token", F.col("p.block").alias("block_p"), F.col("q.block").alias("block_q"))
    left = cut.select("token", F.col("block").alias("block_p"), F.struct("cls", "grp", "n", "pos", "len").alias("p"))
    right = cut.select("token", F.col("block").alias("block_q"), F.struct("cls", "grp", "n", "pos", "len").alias("q"))
    once = (F.col("block_p") < F.col("block_q")) | (F.col("p.cls") < F.col("q.cls"))
    met = two.join(left, ["token", "block_p"]).join(right, ["token", "block_q"]).where(once & (F.col("p.grp") != F.col("q.grp")) & possible("p", "q"))
    return met.select(F.least("p.cls", "q.cls").alias("a"), F.greatest("p.cls", "q.cls").alias("b"), F.least("p.n", "q.n").alias("low_n"))


def _ratio(a, b, percent: int):
    return (F.lit(100) * a >= F.lit(percent) * b) & (F.lit(100) * b >= F.lit(percent) * a)


def _compared(w: int, percent: int, deltas: bool):
    """Exact comparison of text_a and text_b."""
    names = ["a", "b", "n_a", "n_b", "both", "delta"]

    def run(batches):
        for batch in batches:
            for (lo, left), (_, right) in _side_by_side(batch, w):
                rows = []
                for k, (x, y) in enumerate(zip(left, right)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    delta = None
                    if deltas:
                        added, gone = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                        delta = _signed(np.concatenate([added, ~gone]))
                    rows.append((len(x), len(y), both, delta))
                part = batch.slice(lo, len(left))
                columns = [part.column("a"), part.column("b"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _side_by_side(batch, w: int):
    step = 256
    for lo in range(0, batch.num_rows, step):
        sides = []
        for name in ("text_a", "text_b"):
            column = batch.column(name).slice(lo, step)
            sides.append((lo, [u for _, found in sets(column, w) for u in found]))
        yield tuple(sides)


class NgramJoin:
    """The join over docs; every intermediate table is written to the shared folder."""

    def __init__(self, docs: DataFrame, w: int = SHINGLE, percent: int = PERCENT):
        self.w, self.percent = w, percent
        self.texts = with_key(docs)
        self.spark = docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        """pairs of classes (a, b), with a text of each; only texts that are needed travel."""
        pairs = pairs.join(self.classes.select(F.col("cls").alias("a"), F.col("key").alias("key_a")), "a").join(self.classes.select(F.col("cls").alias("b"), F.col("key").alias("key_b")), "b")
        return texts_beside(written(pairs, "pairs"), self.texts)

    def _compare(self, pairs: DataFrame, deltas: bool) -> DataFrame:
        return self._with_texts(pairs).mapInArrow(tidied(_compared(self.w, self.percent, deltas)), "a long, b long, n_a long, n_b long, both long, delta array<long>")

    def _linked(self):
        return F.lit(100) * F.col("both") >= F.lit(self.percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))

    def describe(self) -> None:
        """The documents' sizes and classes; of each class its first document."""
        self.rows = written(self.texts.mapInArrow(tidied(_described(self.w)), "doc_id long, row_key long, n long, cls long, mins array<long>, often array<long>"), "sets")
        first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row_key")).alias("first")
        some = self.rows.where("n > 0").groupBy("cls").agg(first, F.first("n").alias("n"), F.first("mins").alias("mins"))
        self.classes = written(some.select("cls", F.col("first.doc").alias("doc"), F.col("first.row_key").alias("key"), "n", "mins"), "classes")

    def roots(self) -> None:
        """Each class and the first document of those that share a range's smallest hash with it, compared."""
        keys = self.classes.select("cls", "doc", F.explode("mins").alias("token"))
        lead = keys.groupBy("token").agg(F.min(F.struct("doc", "cls")).alias("lead"), F.count("*").alias("k")).where("k > 1")
        votes = keys.join(lead, "token").where("lead.cls <> cls").groupBy("cls", F.col("lead.cls").alias("root"), F.col("lead.doc").alias("root_doc")).count()
        chosen = votes.where(F.col("count") >= ALIKE).groupBy("cls").agg(F.max_by("root", F.struct("count", -F.col("root_doc"))).alias("root"))
        self.answers = written(self._compare(chosen.select(F.col("cls").alias("a"), F.col("root").alias("b")), True), "answers")

    def below_roots(self) -> DataFrame:
        """Candidates among the sets of one root, from their deltas."""
        near = self._near()
        limit = F.floor((F.lit(100 - self.percent) * (F.col("n_a") + F.floor(F.lit(100) * F.col("n_a") / self.percent))) / (100 + self.percent)).cast("int")
        # Sets linked with their root are one group: nothing has to be found between them.
        rows = near.where(F.size("delta") > 0).select(
            "a", "b", F.col("n_a").cast("int").alias("n"), F.size("delta").alias("len"), limit.alias("limit"), F.when(self._linked(), F.col("b")).otherwise(F.col("a")).alias("grp"), F.explode("delta").alias("x")
        )
        often = rows.groupBy("b", "x").agg(F.count("*").alias("k"))
        # The rarest first, so that prefixes hold what few others have; what no other has needs no list.
        place = F.row_number().over(Window.partitionBy("a").orderBy("k", "x")) - 1
        rows = rows.join(often, ["b", "x"]).withColumn("pos", place).where((F.col("pos") <= F.col("limit")) & (F.col("k") > 1))
        lists = rows.select(F.xxhash64("b", "x").alias("token"), F.col("a").alias("cls"), "grp", "n", "pos", "len")
        p = self.percent

        def possible(x, y):
            a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
            h = F.floor(F.lit(100 - p) * (a("n") + b("n")) / (100 + p))
            # The deltas share (|dx| + |dy| - h) / 2 or more; the first of it, the rarest, is no further back than leaves room for that.
            begins = (2 * a("pos") <= a("len") - b("len") + h) & (2 * b("pos") <= b("len") - a("len") + h)
            return _ratio(a("n"), b("n"), p) & begins & (F.abs(a("len") - b("len")) <= h)

        def blocks(x, y):
            return (F.lit(100) * F.col(f"{x}.n1") >= F.lit(p) * F.col(f"{y}.n0")) & (F.lit(100) * F.col(f"{y}.n1") >= F.lit(p) * F.col(f"{x}.n0"))

        return _paired(lists, self.parts, possible, blocks).select("a", "b").distinct()

    def _near(self) -> DataFrame:
        """Answers of sets that their root describes; a root is described by itself, so not by another."""
        alike = self.answers.where(F.lit(100) * F.col("both") >= F.lit(ROOT_PERCENT) * (F.col("n_a") + F.col("n_b") - F.col("both")))
        return alike.join(alike.select(F.col("b").alias("a")).distinct(), "a", "left_anti")

    def across(self) -> DataFrame:
        """Candidates among sets of different roots, or of none, from the inverted index of prefixes."""
        often = self.rows.select(F.explode("often").alias("token")).groupBy("token").count().orderBy(F.desc("count"), "token").limit(FREQUENT)
        tokens = np.sort(np.array([r.token for r in often.select("token").collect()], np.int64).view(np.uint64))
        frequent = self.spark.sparkContext.broadcast(tokens)
        index = self.texts.select("text").mapInArrow(tidied(_prefixes(frequent, self.w, self.percent)), "token long, cls long, n int, pos int")
        order = ["token", "n", "pos", "cls"]
        # Written, as the cuts of the ranges take a pass over it of their own.
        shared = written(index, "prefixes").repartitionByRange(self.parts, *order).sortWithinPartitions("token", "cls").mapInArrow(tidied(shared_lists(["token", "cls", "n", "pos"])), "token long, cls long, n int, pos int")
        shared = written(shared, "lists")
        roots = self._near().select(F.col("a").alias("cls"), F.col("b").alias("root"))
        lists = shared.join(roots, "cls", "left").select("token", "cls", F.coalesce("root", "cls").alias("grp"), "n", "pos", F.lit(0).alias("len"))
        p = self.percent

        def possible(x, y):
            a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
            rest = F.least(a("pos"), b("pos")) + 1 + F.least(a("n") - a("pos"), b("n") - b("pos")) - 1
            return _ratio(a("n"), b("n"), p) & (F.lit(100 + p) * rest >= F.lit(p) * (a("n") + b("n")))

        def blocks(x, y):
            a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
            sizes = (F.lit(100) * a("n1") >= F.lit(p) * b("n0")) & (F.lit(100) * b("n1") >= F.lit(p) * a("n0"))
            rest = F.least(a("pos1"), b("pos1")) + F.least(a("n1") - a("pos0"), b("n1") - b("pos0"))
            return sizes & (F.lit(100 + p) * rest >= F.lit(p) * (a("n0") + b("n0")))

        need = F.least(F.lit(SHARED), F.ceil(F.lit(p) * F.col("low_n") / 100))
        met = _paired(lists, self.parts, possible, blocks).groupBy("a", "b").agg(F.count("*").alias("k"), F.first("low_n").alias("low_n"))
        return met.where(F.col("k") >= need).select("a", "b")

    def links(self) -> DataFrame:
        """(a, b): links between classes, enough of them that all links lie within their components."""
        self.describe()
        self.roots()
        more = self.below_roots().union(self.across())
        found = self._compare(more, False)
        return written(self.answers.where(self._linked()).select("a", "b").union(found.where(self._linked()).select("a", "b")), "links")

    def groups(self) -> DataFrame:
        """(doc_id, row_key, n, component): component is the smallest doc_id reachable by links, a document's own included."""
        links = self.links()
        name = self.classes.select("cls", "doc")
        edges = links.join(name.select(F.col("cls").alias("a"), F.col("doc").alias("x")), "a").join(name.select(F.col("cls").alias("b"), F.col("doc").alias("y")), "b")
        found = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
        name = name.join(found, name["doc"] == found["node"], "left").select("cls", F.coalesce("component", "doc").alias("component"))
        joined = self.rows.join(name, "cls", "left")
        own = F.coalesce("doc_id", F.lit(NO_ID))
        component = F.coalesce("component", own)
        return joined.select("doc_id", "row_key", "n", F.when(component != NO_ID, component).alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    """What query op10_jaccard returns.

    Null and empty texts have no shingles and are linked with nothing.  Rows of
    one doc_id count as one document for components.  A null doc_id names no
    component, unless nothing else is in it: then component_id is null.
    """
    return NgramJoin(docs).groups().select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, w: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, one document of each component: the one with the smallest doc_id; of its repeated rows one.

    Rows that agree in doc_id and text are repeats even where other columns
    differ, and so are those without a word; any one of them stays.
    """
    groups = NgramJoin(docs, w, percent).groups()
    stay = groups.where("n = 0 or component is null or component = doc_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("row_key").alias("__key"))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"), row_key().alias("__key")]
    kept = docs.select("*", *keys).join(stay.distinct(), ["__doc", "__key"], "left_semi")
    return kept.dropDuplicates(["__doc", "__key"]).select(*docs.columns)
