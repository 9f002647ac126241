from __future__ import annotations

import random

from helpers import EMPTY, SCHEMA, components, rows

from glyphmill.llm import jaccard


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def prose(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
    return w


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(jaccard.digest(docs)) == components([(r.doc_id, r.text) for r in docs.collect()])


def test_near_copies_of_one_text_with_links_that_the_first_does_not_have(spark):
    r = random.Random(4)
    first = prose(r, 150)
    far = edited(r, first, 12)  # too far from the first, but copies of it are linked with each other
    second = prose(r, 90)
    passage = prose(r, 60)
    texts = [first, second, *(edited(r, first, r.randint(0, 14)) for _ in range(150)), far, *(edited(r, far, r.randint(0, 3)) for _ in range(40))]
    texts += [edited(r, second, r.randint(0, 5)) for _ in range(40)]
    texts += [prose(r, 60) + passage + prose(r, 60) for _ in range(150)]
    texts = [" ".join(t) for t in texts] + [" ".join(first)] * 30
    r.shuffle(texts)
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    want = components(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) < len(texts) - 80
    assert got(jaccard.digest(df)) == want


def test_random_small_sets(spark):
    r = random.Random(9)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(1, 24))] for _ in range(30)]
    texts = [" ".join(edited(r, r.choice(base), r.randint(0, 2))) for _ in range(300)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 30))) for _ in range(100)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert got(jaccard.digest(df)) == components(list(enumerate(texts)))
    w5 = {x.doc_id: x.component for x in jaccard.NgramJoin(df, 5, 80).groups().collect()}
    assert w5 == {d: c for d, (_, c) in components(list(enumerate(texts)), 5, 80).items()}


def test_awkward_rows(spark):
    texts = [*EMPTY, "one", "ONE", "one two three", "One\tTWO\nthree", "one two", "a b c d", "a  b\x0bc d", "q " * 60_000, "q q q q"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    want = components(list(enumerate(texts)))
    assert got(jaccard.digest(df)) == want
    # Repeated rows are one document; a null id names no component.
    twice = df.union(df)
    assert jaccard.digest(twice).distinct().count() == len(texts)
    null = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "x y z u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.digest(null).collect()) == [(0, 0), (0, 7), (7, 7)]
    assert jaccard.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = jaccard.first_of_each(twice)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (n, c) in want.items() if n == 0 or c == d)
