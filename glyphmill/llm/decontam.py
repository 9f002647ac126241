"""Benchmark decontamination by Wu-Manber search for many strings at once.

Texts are put in a plain form first: A-Z lower-cased, words (runs of digits,
letters a-z and bytes of 0x80 and more) with one blank before and after.  The
strings looked for are windows of 13 words of the benchmark in that form, blanks
at both ends included, so that word edges need no other care.

Over the first m bytes of all strings (m: the shortest's length) a table by the
hash of a block of bytes tells how far the search may go on without missing a
string.  Where it says 0, the same hash, now of the last block of those m bytes,
selects the strings to compare directly.  Strings are searched in three classes
by length, as a single short one would make every step short.  The search runs
over many places of a slab at a time, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, row_key, with_key
from .textscan import MIX_A, mix, slabs, tidied

WINDOW = 13

PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))

#: (least length of a string in bytes, bytes of a block); fixed values.
CLASSES = ((24, 12), (8, 6), (3, 3))

#: Places of a slab that one cursor goes over.
STRETCH = 2048


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def windows(text: bytes, w: int = WINDOW) -> list[bytes]:
    """The strings that an item stands for: w successive words; all words of a shorter item; none of an empty one."""
    words = plain_words(text)
    return [b" " + b" ".join(words[i : i + w]) + b" " for i in range(max(1, len(words) - w + 1))] if words else []


def _view(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; b has 8 bytes to spare at its end."""
    return np.ndarray((len(b) - 7,), "<u8", b, strides=(1,))


def _block_hash(v: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Of the `size` bytes that end at place `last`."""
    if size > 8:
        return mix(v[last - size + 1] * MIX_A + v[last - 7])
    keep = np.uint64((1 << (8 * size)) - 1) if size < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
    return mix(v[last - size + 1] & keep)


class StringClass:
    """Shift table, buckets and strings of one class."""

    def __init__(self, strings: list[bytes], numbers: list[int], block: int):
        self.strings, self.numbers, self.block = strings, np.array(numbers), block
        self.m = m = min(map(len, strings))
        data = np.frombuffer(b"".join(s[:m] for s in strings) + bytes(8), np.uint8).copy()
        v = _view(data)
        n = len(strings)
        bits = max(10, min(24, int(np.ceil(np.log2(n * (m - block + 1) + 1))) + 3))
        self.drop = np.uint64(64 - bits)
        far = m - block + 1
        self.shift = np.full(1 << bits, min(far, 255), np.uint8)
        begin = np.arange(n) * m
        for end in range(block - 1, m):
            slot = (_block_hash(v, begin + end, block) >> self.drop).astype(np.int64)
            np.minimum.at(self.shift, slot, np.uint8(min(m - 1 - end, 255)))
        slot = (_block_hash(v, begin + m - 1, block) >> self.drop).astype(np.int64)
        self.order = np.argsort(slot, kind="stable")
        self.slots, self.begin = np.unique(slot[self.order], return_index=True)
        self.begin = np.append(self.begin, n)
        self.head = v[begin] if m >= 8 else None

    def search(self, text: bytes, b: np.ndarray):
        """(place, string number) of every occurrence; b: the bytes of text with 8 spare ones."""
        v, m, n = _view(b), self.m, len(text)
        if n < m:
            return
        begin = np.arange(m - 1, n, STRETCH)
        at, end = begin.copy(), np.minimum(begin + STRETCH, n)
        hits = []
        while len(at):
            slot = (_block_hash(v, at, self.block) >> self.drop).astype(np.int64)
            step = self.shift[slot].astype(np.int64)
            zero = step == 0
            if zero.any():
                hits.append((at[zero], slot[zero]))
            at = at + np.maximum(step, 1)
            go = at < end
            if not go.all():
                at, end = at[go], end[go]
        if not hits:
            return
        last, slot = (np.concatenate(x) for x in zip(*hits))
        k = np.searchsorted(self.slots, slot)
        there = (k < len(self.slots)) & (self.slots[np.minimum(k, len(self.slots) - 1)] == slot)
        last, k = last[there], k[there]
        size = self.begin[k + 1] - self.begin[k]
        first = np.repeat(last - m + 1, size)
        inside = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
        number = self.order[np.repeat(self.begin[k], size) + inside]
        if self.head is not None and len(first):
            same = v[first] == self.head[number]
            first, number = first[same], number[same]
        for p, x in zip(first.tolist(), number.tolist()):
            if text.startswith(self.strings[x], p):
                yield p, x


class Matcher:
    """All strings of (item, text) pairs, ready to be searched for."""

    def __init__(self, items: list[tuple[object, bytes]], w: int = WINDOW):
        owners: dict[bytes, list] = {}
        for item, text in items:
            for s in dict.fromkeys(windows(text or b"", w)):
                owners.setdefault(s, []).append(item)
        strings = list(owners)
        self.owners = [owners[s] for s in strings]
        self.words = [s.count(b" ") - 1 for s in strings]
        self.classes, most = [], None
        for least, block in CLASSES:
            chosen = [i for i, s in enumerate(strings) if len(s) >= least and (most is None or len(s) < most)]
            most = least
            if chosen:
                self.classes.append(StringClass([strings[i] for i in chosen], chosen, block))

    def slab(self, data: bytes, offsets: np.ndarray):
        """For each text of a slab: number of words, sorted numbers of the hit ones, items found."""
        raw = np.frombuffer(data.translate(PLAIN), np.uint8)
        n = len(offsets) - 1
        # A zero between texts, and a blank at both ends of each.
        lengths = np.diff(offsets)
        wide = np.full(len(raw) + 3 * n + 8, 32, np.uint8)
        wide[len(raw) + 3 * n :] = 0
        begin = offsets[:-1] + 3 * np.arange(n) + 1
        wide[np.arange(len(raw)) + np.repeat(3 * np.arange(n) + 1, lengths)] = raw
        wide[begin + lengths + 1] = 0
        keep = np.ones(len(wide), bool)
        keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
        keep[-8:] = True
        b = wide[keep]
        text = b[:-8].tobytes()
        edge = np.flatnonzero(b[:-8] == 0)  # after each text
        word = np.flatnonzero((b[:-9] == 32) & (b[1:-8] != 0)) if len(b) > 9 else np.zeros(0, np.int64)
        first = np.searchsorted(word, np.concatenate([[0], edge]))
        counts = np.diff(first)
        hit: dict[int, set] = {}
        found: dict[int, set] = {}
        for c in self.classes:
            got = list(c.search(text, b))
            if not got:
                continue
            places = np.array([p for p, _ in got])
            doc = np.searchsorted(edge, places)
            w0 = np.searchsorted(word, places) - first[doc]
            for d, w, (_, x) in zip(doc.tolist(), w0.tolist(), got):
                x = int(c.numbers[x])
                hit.setdefault(d, set()).update(range(w, w + self.words[x]))
                found.setdefault(d, set()).update(self.owners[x])
        return counts, hit, found


FOUND = "doc_id long, row_key long, n_words long, hit array<int>, items array<string>"


def _searched(shared, w: int, only_hits: bool):
    cache: list[Matcher] = []

    def run(batches):
        if not cache:
            cache.append(Matcher(shared.value, w))
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text")):
                counts, hit, found = cache[0].slab(data, offsets)
                rows = np.array(sorted(hit), np.int64) if only_hits else np.arange(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows + lo)),
                        batch.column("row_key").take(pa.array(rows + lo)),
                        pa.array(counts[rows].astype(np.int64)),
                        pa.array([sorted(hit.get(d, ())) for d in rows.tolist()], pa.list_(pa.int32())),
                        pa.array([sorted(map(str, found.get(d, ()))) for d in rows.tolist()], pa.list_(pa.string())),
                    ],
                    ["doc_id", "row_key", "n_words", "hit", "items"],
                )

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null").distinct()


def n_blocks(benchmark: DataFrame, most_bytes: int) -> int:
    total = _items(benchmark).agg(F.sum(F.octet_length("text") * 13 + 64)).first()[0] or 0
    return max(1, -(-total // most_bytes))


def blocks(benchmark: DataFrame, most_bytes: int):
    """The benchmark's items in blocks whose windows take at most about most_bytes; one block at a time in the driver.

    A window is some 13 times as long as the text it adds to, hence the factor.
    Repeated rows count once.  An item is never cut, so one of more than that has
    a block of its own size.
    """
    items = _items(benchmark)
    n = n_blocks(benchmark, most_bytes)
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield n, [(r.item, bytes(r.text)) for r in block.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, w: int = WINDOW, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, row_key, n_words, hit, items) for every row of docs.

    hit: numbers of the words inside any occurrence of a window; items: sorted
    ids, as strings, of the items with such windows.  Null and empty texts have
    no words; a null item_id is never found; items with one id count as one.
    A benchmark beyond ``most_bytes`` is searched for in blocks, in one pass over
    the documents each, and the blocks' findings are joined by row.
    """
    keyed = with_key(docs)
    spark = docs.sparkSession
    parts = []
    for n, block in blocks(benchmark.where("item_id is not null"), most_bytes):
        shared = spark.sparkContext.broadcast(block)
        parts.append(keyed.mapInArrow(tidied(_searched(shared, w, only_hits=n > 1)), FOUND))
    if len(parts) == 1:
        return parts[0]
    none = spark.sparkContext.broadcast([])
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    merged = hits.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    every = keyed.mapInArrow(tidied(_searched(none, w, only_hits=False)), FOUND)
    return every.join(merged, (F.col("row_key") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "row_key", "n_words", F.coalesce("h", "hit").alias("hit"), F.coalesce("i", "items").alias("items"))


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What query op8_decontam returns: a row for every row of docs; see ``contamination`` for nulls and repeats."""
    found = contamination(docs, benchmark)
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, w: int = WINDOW, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the contaminated rows; a benchmark of one block needs no shuffle.

    Rows without a word stay; repeated rows stay or go together.
    """
    if n_blocks(benchmark, most_bytes) > 1:
        bad = contamination(docs, benchmark, w, most_bytes).where(is_contaminated(F.size("hit").cast("long"), F.col("n_words"))).select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key")).distinct()
        return docs.join(bad, (row_key() == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__doc")), "left_anti")
    ((_, block),) = blocks(benchmark.where("item_id is not null"), most_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    cache: list[Matcher] = []

    def run(batches):
        if not cache:
            cache.append(Matcher(shared.value, w))
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text").cast(pa.binary())):
                counts, hit, _ = cache[0].slab(data, offsets)
                keep = np.ones(hi - lo, bool)
                for d, words in hit.items():
                    keep[d] = 20 * len(words) < counts[d]
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)

