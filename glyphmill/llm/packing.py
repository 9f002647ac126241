"""Packing of documents into token sequences along a Hilbert curve.

1.  Each document is tokenised once.  Its ids, hashed into a few dimensions by a
    fixed random projection, give a point; the point's place on a Hilbert curve
    is its key, so documents of like content have keys close by.
2.  Keys are range-sorted.  Within each partition a running sum of lengths gives
    each document its place, and the partitions' totals, one row each, give the
    places at which the partitions begin.
3.  Laid end to end in that order, ids fill one sequence after another.  A
    document is cut wherever a sequence is full, so only the last sequence of all
    is padded.

Words (runs without ASCII white space) are tokenised once for many texts: the
tokenizer drops white space and never joins ids over it.  Each Python worker keeps the
ids of words it has met, up to a bound, in sorted arrays; a word that is not
there is simply tokenised again.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import with_key, written
from .textscan import TO_BLANK, Words, slabs, tidied

SEQUENCE = 4096
END_ID = 2
DIMS, BITS = 4, 8
#: Words that a worker keeps, at most.
KEPT_WORDS = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes of words whose number of pieces is known: 1 letter, 2 digit, 3 another ASCII sign; 0: tokenised by itself.
#: Letters are a-z, A-Z and those of U+00C0 to U+00FF, 0xC3 and a second byte; 0x97 and 0xB7 would end signs there.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[ord(c) for c in "'<|>"]] = 0
_KIND[[0xC3, *range(0x80, 0xC0)]] = 1
_KIND[[0x97, 0xB7]] = 0

#: Words that are tokenised in one string.
TOGETHER = 512


class Tokens:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.tiers = [_Tier(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.dtype))]

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, w: Words, at: np.ndarray) -> "_Tier":
        """A tier of the words w.start[at].. with these sorted hashes.

        Letters, digits and ASCII signs are cut into pieces in a way that needs no
        look at the neighbours: runs of letters, single digits, runs of other
        signs; and the last id of each piece is one that closes.  So many such
        words are tokenised in one string, whose ids are then dealt out by
        counting the closing ones.  All other words are tokenised singly.
        """
        start, end = w.start[at], w.end[at]
        kind = _KIND[np.frombuffer(w.bytes, np.uint8)]
        odd = np.append(0, np.cumsum(kind == 0))
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        pieces = np.append(0, np.cumsum(new))
        # A word's first byte begins a piece, whatever is before it.
        pieces = pieces[end] - pieces[start] + ~new[start]
        plain = (odd[end] == odd[start]) if self.closes.any() else np.zeros(len(at), bool)
        numbers = np.flatnonzero(plain)
        groups = [numbers[i : i + TOGETHER] for i in range(0, len(numbers), TOGETHER)]
        flat, sizes, rest = [], np.zeros(len(at), np.int64), np.flatnonzero(~plain).tolist()
        spelled = lambda k: w.bytes[start[k] : end[k]].decode("utf-8", "replace")
        joined = [b" ".join(w.bytes[s:e] for s, e in zip(start[g].tolist(), end[g].tolist())).decode() for g in groups]
        order = []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            got = np.array(e.ids, self.dtype)
            closing = np.flatnonzero(self.closes[got])
            last = np.cumsum(pieces[g]) - 1
            if len(closing) != last[-1] + 1:
                rest += g.tolist()
                continue
            sizes[g] = np.diff(np.append(0, closing[last] + 1))
            flat.append(got)
            order.append(g)
        lists = self._one_by_one([spelled(k) for k in rest])
        sizes[rest] = [len(x) for x in lists]
        flat += [np.array(x, self.dtype) for x in lists]
        order.append(np.array(rest, np.int64))
        order = np.concatenate(order)
        begin = np.empty(len(at), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        pool = np.concatenate([*flat, np.zeros(0, self.dtype)])
        return _Tier(hashes, np.append(0, np.cumsum(sizes)), pool[spread(begin, sizes)])

    def _keep(self, tier: "_Tier") -> None:
        """Tiers at least halve in size, so a word is merged few times."""
        if sum(len(t.known) for t in self.tiers) + len(tier.known) > KEPT_WORDS:
            self.forget()
        self.tiers.append(tier)
        while len(self.tiers) > 1 and 2 * len(self.tiers[-1].known) > len(self.tiers[-2].known):
            b, a = self.tiers.pop(), self.tiers.pop()
            self.tiers.append(a.merged(b))

    def slab(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slab's texts, one after the other, and where each text's begin, and one more entry."""
        w = Words(data, offsets, TO_BLANK)
        distinct, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        begin = np.zeros(len(distinct), np.int64)
        sizes = np.zeros(len(distinct), np.int64)
        missing = np.ones(len(distinct), bool)
        pools, used = [], 0
        for tier in self.tiers:
            at = np.flatnonzero(missing)
            k, there = tier.find(distinct[at])
            at, k = at[there], k[there]
            begin[at] = tier.begin[k] + used
            sizes[at] = tier.begin[k + 1] - tier.begin[k]
            missing[at] = False
            pools.append(tier.ids)
            used += len(tier.ids)
        if missing.any():
            tier = self._learn(distinct[missing], w, first[missing])
            begin[missing] = tier.begin[:-1] + used
            sizes[missing] = np.diff(tier.begin)
            pools.append(tier.ids)
            self._keep(tier)
        # The distinct words' ids first, so that what follows reads a small array.
        short = np.concatenate(pools)[spread(begin, sizes)]
        ends = np.append(0, np.cumsum(sizes))
        sizes = sizes[back]
        ids = short[spread(ends[back], sizes)]
        return ids, np.append(0, np.cumsum(sizes))[w.first]


class _Tier:
    """Sorted hashes of words, and their ids, one word after the other."""

    def __init__(self, known: np.ndarray, begin: np.ndarray, ids: np.ndarray):
        self.known, self.begin, self.ids = known, begin, ids

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return k, self.known[k] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def merged(self, other: "_Tier") -> "_Tier":
        known = np.concatenate([self.known, other.known])
        order = np.argsort(known, kind="stable")
        sizes = np.concatenate([np.diff(self.begin), np.diff(other.begin)])[order]
        begin = np.concatenate([self.begin[:-1], other.begin[:-1] + len(self.ids)])[order]
        return _Tier(known[order], np.append(0, np.cumsum(sizes)), np.concatenate([self.ids, other.ids])[spread(begin, sizes)])


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (sizes[0] numbers), begin[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(2)
def projection(dims: int) -> np.ndarray:
    """A row of random normal numbers for each of 65,536 hashed ids."""
    return np.random.default_rng(20240229).standard_normal((1 << 16, dims), np.float32)


@lru_cache(2)
def cuts(bits: int) -> np.ndarray:
    """Where a normal number's range is cut into equally likely parts."""
    return np.array([NormalDist().inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)])


def points(ids: np.ndarray, begin: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """For each document the cell of its projected counts of ids, dims numbers of so many bits."""
    n = np.diff(begin)
    out = np.zeros((len(n), dims))
    for d in range(dims):
        sums = np.append(0.0, np.cumsum(projection(dims)[:, d].astype(np.float64)[ids & 0xFFFF]))
        out[:, d] = (sums[begin[1:]] - sums[begin[:-1]]) / np.sqrt(np.maximum(n, 1))
    return np.searchsorted(cuts(bits), out)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (Skilling's transform, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            x[0] = np.where(up, x[0] ^ p, x[0])
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenised(path: str, end_id: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text")):
                ids, begin = tokens(path).slab(data, offsets)
                keys = hilbert(points(ids, begin))
                packed = [np.append(ids[begin[k] : begin[k + 1]], end_id).astype(ids.dtype) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(keys, pa.int64()),
                        pa.array(np.diff(begin) + 1, pa.int64()),
                        pa.array([zlib.compress(p.tobytes(), 1) for p in packed], pa.binary()),
                        pa.array([p.itemsize for p in packed], pa.int32()),
                    ],
                    ["doc_id", "key", "n", "ids", "width"],
                )

    return run


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, key, n, ids, width), written to the shared folder; row numbers the rows."""
    ids = with_key(docs).mapInArrow(tidied(_tokenised(path, end_id)), "doc_id long, key long, n long, ids binary, width int")
    return written(ids.withColumn("row", F.monotonically_increasing_id()), "ids")


def unpack(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(ids), f"<u{width}")


def _numbered(batches):
    """Number of the partition, and the sum of n so far in it."""
    from pyspark import TaskContext

    part, sofar = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = sofar + np.cumsum(n) - n
        sofar += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), pa.array(np.full(len(n), part, np.int32)), pa.array(at, pa.int64())], ["row", "n", "part", "at"])


def places(ids: DataFrame) -> DataFrame:
    """(row, place): how many ids of all documents come before each row's, in order of key."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ids.select("key", "row", "n").repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("row", "n")
    order = written(order.mapInArrow(tidied(_numbered), "row long, n long, part int, at long"), "order")
    # One row a partition, so this side is small whatever the input.
    totals = order.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin"))
    return order.join(F.broadcast(begins), "part").select("row", (F.col("begin") + F.col("at")).alias("place"))


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, width, doc_tokens, place) for every row of docs; null texts count as empty.

    ids: the document's ids and ``end_id``, compressed (``unpack``); place: how
    many ids of all documents come before them.  Sequence number and place in the
    sequence are the quotient and the rest of a place by the sequence's length.
    """
    ids = tokenised(docs, path or default_tokenizer(), end_id)
    return ids.join(places(ids), "row").select("doc_id", "ids", "width", F.col("n").alias("doc_tokens"), "place")


def _pieces(sequence: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc, data, width, n, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width", "doc_tokens", "place"))):
                ids = unpack(data, width).astype("<u4")
                start = 0
                while start < n:
                    number, offset = divmod(place + start, sequence)
                    length = min(sequence - offset, n - start)
                    row = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, number, offset)
                    for column, value in zip(out, row):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return run


def digest(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """What query op7_packing returns: one row a piece of a document within a sequence."""
    return packed(docs, path, sequence).mapInArrow(tidied(_pieces(sequence)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
