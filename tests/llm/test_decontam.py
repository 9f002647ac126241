from __future__ import annotations

import hashlib
import random

from helpers import EMPTY, SCHEMA, contamination, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import decontam
from glyphmill.llm.textscan import slabs

import pyarrow as pa


def wanted(docs, items):
    out = {}
    for d, (n, hit, found) in contamination(docs, items).items():
        ids = ",".join(sorted(map(str, found)))
        out[d] = (n, len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= n)
    return out


def got(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}


def test_whole_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = wanted([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(decontam.digest(docs, items)) == want
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == sorted(d for d, x in want.items() if not x[-1])


def test_a_benchmark_in_blocks_gives_the_same(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontam.contamination(docs, items)
    parts = decontam.contamination(docs, items, most_bytes=20_000)
    key = lambda df: sorted((r.doc_id, r.n_words, tuple(r.hit), tuple(r.items)) for r in df.collect())
    assert key(whole) == key(parts)
    assert decontam.clean(docs, items).count() == decontam.clean(docs, items, most_bytes=20_000).count()


def test_awkward_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [*EMPTY, long.upper(), long.replace(" ", "--\x7f"), "w1", "x " * 3000 + long, "eins zwei", "EINS, zwei! drei", "éins", "Éins", "a " * 100_000]
    items = [(1, long), (2, long), (3, "w1"), (4, None), (5, ""), (6, "..."), (7, "zwei drei"), (8, "éins"), (30, "w39")]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.digest(df, bench)) == wanted(list(enumerate(texts)), items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.digest(df, none).collect()} == {0}
    assert decontam.digest(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontam.clean(df, bench).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5))
def test_search_finds_all_and_only_what_is_there(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    texts = [" ".join(word() for _ in range(r.randint(0, 300))) for _ in range(4)]
    items = [(i, " ".join((r.choice(texts) or "a").split(" ")[k : k + r.randint(1, 20)])) for i in range(n) for k in [r.randint(0, 40)]]
    m = decontam.Matcher([(i, t.encode()) for i, t in items])
    want = contamination(list(enumerate(texts)), items)
    for lo, hi, data, offsets in slabs(pa.array([t.encode() for t in texts])):
        counts, hit, found = m.slab(data, offsets)
        for k in range(hi - lo):
            assert (counts[k], hit.get(k, set()), found.get(k, set())) == want[lo + k]
