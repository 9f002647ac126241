"""Packing, nearest neighbours, quality, passages and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from helpers import EMPTY, SCHEMA, components, contamination, line_dedup, rows, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm import ann, packing, passages, quality, shared


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def check_packing(df, tokenizer, sequence=packing.SEQUENCE):
    pieces = packing.digest(df, sequence=sequence).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    docs = df.select("doc_id", "text").collect()
    assert set(by_doc) == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for k, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == sequence or k == max(by_sequence)


def test_packing_whole_table(spark, data, tokenizer):
    check_packing(spark.read.parquet(f"{data}/documents.parquet"), tokenizer)


def test_packing_awkward_texts(spark, tokenizer):
    texts = [*EMPTY, "a <|endoftext|> b don't É́ ́x <|ENDOFTEXT|>x\x0bq z y ＡＢ ß ΣΑΣ 12a é×ü÷", "q " * 100_000, "x" * 3000, "it's we're '' ''s", "\x00\x01 \x1c", "ÀÉªµ naïve.", "\U0001f600 \U00010400"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    check_packing(df, tokenizer, 1000)
    assert packing.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.digest(df.union(df)).count() >= 2 * len(texts)


def test_hilbert_key_is_a_walk_through_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_words_that_are_forgotten_are_tokenised_again(monkeypatch, tokenizer):
    from glyphmill.llm.textscan import slabs
    import pyarrow as pa

    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    t = packing.Tokens(packing.default_tokenizer())
    r = random.Random(3)
    for _ in range(20):
        texts = [" ".join(r.choice(["alpha,", "béta", "g4mma", "δelta", "x'll"]) + str(r.randrange(99)) * r.randrange(2) for _ in range(40)) for _ in range(3)]
        for _, hi, data, offsets in slabs(pa.array([x.encode() for x in texts])):
            ids, begin = t.slab(data, offsets)
            assert [ids[begin[k] : begin[k + 1]].tolist() for k in range(hi)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


# --- nearest neighbours ------------------------------------------------------


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_ann_recall_and_exact_scores(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    p = df.toPandas()
    ids, x = p.vec_id.to_numpy(), np.array(p.embedding.tolist(), float)
    got = defaultdict(list)
    for r in ann.digest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 11))
        exact = dict(zip(ids.tolist(), np.sqrt(((x - x[q]) ** 2).sum(1))))
        assert all(abs(exact[v] - s) < 1e-12 for _, v, s in mine)
        hits.append(len({v for _, v, _ in mine} & {v for v, _ in brute(ids, x, q)}) / 10)
    assert np.mean(hits) >= 0.9


def test_ann_recall_beyond_the_exhaustive_size(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((60, 16))
    x = (centres[r.integers(0, 60, 12_000)] + 0.4 * r.standard_normal((12_000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for row in ann.digest(df).collect():
        got[row.query_id].add(row.vec_id)
    ids = np.arange(len(x))
    assert np.mean([len(got[q] & {v for v, _ in brute(ids, x.astype(float), q)}) / 10 for q in range(0, 12_000, 100)]) >= 0.9


def test_ann_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [3.0, 0.0]), (9, []), (10, [1.0]), (100, [0.0, 0.0]), (200, [3.0, 4.0]), (6, [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    rows_ = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.digest(df).collect())
    assert rows_ == [(0, 1, 6, 0.0), (0, 2, 7, 0.0), (0, 3, 8, 2.0), (0, 4, 200, 20**0.5), (200, 1, 8, 4.0), (200, 2, 0, 20**0.5), (200, 3, 6, 20**0.5), (200, 4, 7, 20**0.5)]
    assert ann.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_one_vector_of_a_third_of_all_rows(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for row in ann.digest(df).collect():
        got[row.query_id].append((row["rank"], row.vec_id))
    ids = np.arange(900)
    for q in range(0, 900, 100):
        assert [v for _, v in sorted(got[q])] == [v for v, _ in brute(ids, x.astype(float), q)]


def test_ann_recall_on_a_whole_table_with_most_lists_left_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    ids, x = p.vec_id.to_numpy(), np.array(p.embedding.tolist(), float)
    got = defaultdict(set)
    for row in ann.search(df, ann.usable(df).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")).collect():
        got[row.query_id].add(row.vec_id)
    recall = np.mean([len(got[ids[q]] & {v for v, _ in brute(ids, x, q)}) / 10 for q in np.flatnonzero(ids % 20 == 0)])
    print("recall:", recall)
    assert len(got) == (ids % 20 == 0).sum() and recall >= 0.9


def test_ann_distances_from_tables():
    r = np.random.default_rng(3)
    model = ann.fit(r.standard_normal((600, 24)), 600)
    x, q = r.standard_normal((50, 24)), r.standard_normal((7, 24))
    lists, codes = model.encode(x)
    near = model.centroids[lists] + model.decoded(codes)
    assert np.allclose(model.distances(q, lists, codes), ((q[:, None] - near[None]) ** 2).sum(2), atol=1e-3)


def test_bundles_hold_what_they_should():
    first, parts, n = ann.bundles(np.array([3, 3, 3, 3, 25, 1, 0, 10]), 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 5, 5, 6] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1, 1] and n == 7


# --- quality -----------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.digest(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    both = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in both)
    assert np.mean([r.predicted == r.quality for r in both]) > 0.95
    assert docs.count() == scored.count()


def test_prior_is_estimated_from_positives_and_unlabelled_rows_alone():
    r = np.random.default_rng(4)
    d = len(quality.FEATURES)
    shift = np.append(np.full(3, 2.5), np.zeros(d - 3))
    for share in (0.2, 0.5, 0.8):
        positive = r.standard_normal((1500, d)) + shift
        hidden = r.random(3000) < share
        unlabelled = r.standard_normal((3000, d)) + hidden[:, None] * shift
        assert abs(quality.estimated_prior(positive, unlabelled) - share) < 0.07


def test_prior_of_documents_is_near_the_labels_share():
    import pandas as pd

    docs, labels = (pd.read_parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    both = docs.merge(labels, on="doc_id")
    texts = [t.encode() for t in both.text.fillna("")]
    x = quality.features(b"".join(texts), np.cumsum([0, *map(len, texts)]))
    good = (both.quality == 1).to_numpy()
    first = np.arange(len(x)) % 2 == 0
    assert abs(quality.estimated_prior(x[good & first], x[~first]) - good.mean()) < 0.1


def test_quality_does_not_look_at_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    scores = [{r.doc_id: r.score for r in quality.digest(docs, x).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]


def test_quality_awkward_texts(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.createDataFrame(rows([*EMPTY, "word " * 50_000, "é", "A"], first=10**6), SCHEMA)
    assert quality.digest(docs, labels).where("score between 0 and 1").count() == docs.count()
    none = labels.limit(0)
    assert {r.score for r in quality.digest(docs, none).collect()} == {0.5}
    assert quality.digest(docs.limit(0), labels).count() == 0
    assert quality.good(docs, labels).columns == docs.columns
    # Repeated rows and ties: a row for each, one score.
    twice = spark.createDataFrame(rows(["A tie.", "A tie."], first=2 * 10**6) * 2, SCHEMA)
    scores = [r.score for r in quality.digest(twice, labels).collect()]
    assert len(scores) == 4 and len(set(scores)) == 1
    assert quality.good(twice, labels).count() in (0, 4)
    assert quality.good(docs.limit(0), labels).count() == 0


# --- passages ----------------------------------------------------------------


def test_compact_windows_against_brute_force():
    r = np.random.default_rng(0)
    for k in range(200):
        first = np.append(0, np.cumsum(r.integers(0, 40, 4)))
        v = r.integers(1, r.integers(2, 60), first[-1]).astype(np.uint64)
        if k % 2:
            # The same words again and again.
            v = np.resize(v[: r.integers(1, 9)], len(v)) if len(v) else v
            v[r.integers(0, max(len(v), 1), k % 5 if len(v) else 0)] += np.uint64(1)
        windows = set(zip(*(x.tolist() for x in passages.compact_windows(v, first, 5))))
        for d in range(4):
            for begin in range(first[d], first[d + 1]):
                for end in range(begin + 4, first[d + 1]):
                    c = begin + int(v[begin : end + 1].argmin())
                    mine = [w for w in windows if w[1] == c]
                    assert all(w[0] <= begin and end <= w[2] for w in mine)
                    # Without a window, the places of least width around c repeat what is further left.
                    if not mine and end == begin + 4:
                        left = max(i for i in range(first[d], c) if v[i] == v[c])
                        assert v[begin : end + 1].tolist() == v[begin - c + left : end + 1 - c + left].tolist()
    # Not every place of a text of one word has a window.
    assert len(passages.compact_windows(np.ones(1000, np.uint64), np.array([0, 1000]), 46)[0]) < 100


def covered(spans, n):
    out = np.zeros(n, bool)
    for x in spans.split(","):
        s, e = map(int, x.split(":"))
        out[s:e] = True
    return out


def test_exactly_repeated_passages_are_all_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.passages for r in passages.digest(docs).collect()}
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    holders = defaultdict(set)
    for d, w in text.items():
        for i in range(len(w) - 49):
            holders[tuple(w[i : i + 50])].add(d)
    for d, w in text.items():
        repeated = [i for i in range(len(w) - 49) if len(holders[tuple(w[i : i + 50])]) > 1]
        if repeated:
            mine = covered(got[d], len(w))
            assert all(mine[i : i + 50].all() for i in repeated)


def test_near_passages_in_a_large_group_and_clean_documents(spark):
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = prose(80)
    texts = []
    for i in range(300):
        p = list(passage)
        if i % 3 == 0:
            p[r.randrange(80)] = "changed"
        texts.append(prose(r.randrange(200)) + p + prose(r.randrange(200)))
    clean = [prose(300) for _ in range(100)]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts + clean]), SCHEMA).repartition(5)
    got = {r.doc_id: r for r in passages.digest(df).collect()}
    assert set(got) == set(range(300))
    # Two copies with changes in different places are alike enough only on one side of a change.
    assert all(50 <= x.n_repeated <= 84 for x in got.values())
    assert sum(x.n_repeated >= 76 for x in got.values()) >= 200


def value_pairs(s):
    first, found = np.array([0, len(s)]), []
    for fn in range(passages.HASHES):
        v = passages.mix(s ^ passages.SEEDS[fn])
        l, c, r = passages.compact_windows(v, first, 46)  # noqa: E741
        found.append((passages._signed(v[c] << np.uint64(2) | np.uint64(fn)), np.full(len(c), fn), c, l, r))
    token, fn, c, l, r = (np.concatenate(x) for x in zip(*found))  # noqa: E741
    i, j = passages.crossed(np.zeros(len(c), np.int64), token, fn, c, l, r, 46)
    return set(zip(token[i].tolist(), token[j].tolist()))


def test_recall_of_near_passages_at_the_threshold():
    r = np.random.default_rng(5)
    prose = lambda n: r.integers(1, 1 << 63, n).astype(np.uint64)
    met = 0
    for _ in range(1000):
        # 50 words of which one is changed: 5 of 46 shingles, a similarity of .80.
        a = prose(46)
        b = a.copy()
        k = r.integers(1, 40)
        b[k : k + 5] = prose(5)
        met += bool(value_pairs(np.concatenate([prose(60), a, prose(60)])) & value_pairs(np.concatenate([prose(60), b, prose(60)])))
    assert met >= 985


def test_passages_of_many_families_with_one_frame(spark):
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    frame = prose(45)
    texts = [prose(60) + frame + tail + prose(60) for tail in [prose(10) for _ in range(10)] for _ in range(2)]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA)
    got = {d.doc_id: covered(d.passages, len(texts[0])) for d in passages.digest(df).collect()}
    assert all(d in got and got[d][60:115].all() for d in range(20))


def test_passages_like_a_member_but_not_the_first(spark):
    r = random.Random(4)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, last = [], []
    for _ in range(40):
        a = prose(52)
        b = [*a[:12], "changed", *a[13:]]
        c = [*b[:38], "again", *b[39:]]
        last.append(len(texts) + 2)
        texts += [prose(30) + p + prose(30) for p in (a, b, c)]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA)
    p = passages.Passages(df)
    p.describe()
    pairs = p.candidates().select("pair", "doc").distinct().collect()
    by = defaultdict(set)
    for x in pairs:
        by[x.pair].add(x.doc)
    near = {d for d in last if any({d, d - 1} <= m for m in by.values())}
    got = {x.doc_id for x in p.documents().collect()}
    assert len(near) > 25 and near <= got


def test_all_places_of_a_passage_within_documents(spark):
    r = random.Random(6)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = prose(60), prose(70)
    near = [*q[:30], "changed", *q[31:]]
    texts = [prose(30) + p + prose(30) + p + prose(20), prose(10) + p + prose(50), prose(20) + q + prose(40) + near + prose(100) + q[:20], prose(40) + q, q[:30] + prose(40) + near + prose(5) + q + p]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA)
    got = {x.doc_id: x.passages for x in passages.digest(df).collect()}
    assert got == {0: "30:90,120:180", 1: "10:70", 2: "20:90,130:200", 3: "40:110", 4: "70:140,145:275"}
    assert {x.doc_id: x.n_repeated for x in passages.digest(df).collect()} == {0: 120, 1: 60, 2: 140, 3: 70, 4: 200}


def test_insertions_longer_than_the_slack(spark):
    r = random.Random(7)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(10):
        a, b = prose(150), prose(95)
        texts += [prose(60) + a + prose(60), prose(60) + a[:40] + prose(15) + a[40:] + prose(60), prose(60) + b + prose(60), prose(60) + b[:47] + prose(13) + b[47:] + prose(60)]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA)
    got = {x.doc_id: x.passages for x in passages.digest(df).collect()}
    want = ["60:210", "60:225", "60:155", "60:168"]
    assert sum(got.get(d) == want[d % 4] for d in range(40)) >= 36


def test_recall_of_near_passages_against_brute_force(spark):
    """One passage in many documents with two words changed in each, and isolated pairs with one."""
    r = random.Random(9)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, family = prose(70), []
    for _ in range(200):
        p = list(passage)
        for k in r.sample(range(70), 2):
            p[k] = f"x{r.randrange(10**6)}"
        family.append(p)
    sets = [[hash(tuple(p[i : i + 5])) for i in range(66)] for p in family]

    def alike(x, y):
        # The stretch of all words; else, of 50 words or more at the same places, one that is alike.
        for size in (66, 60, 54, 50, 46):
            for i in range(0, 67 - size):
                a, b = set(x[i : i + size]), set(y[i : i + size])
                if len(a & b) >= 0.8 * len(a | b):
                    return True
        return False

    want = {d for d in range(200) if any(alike(sets[d], sets[e]) for e in range(200) if e != d)}
    texts = [prose(r.randrange(200)) + p + prose(r.randrange(200)) for p in family]
    for size in (50, 52, 55, 60) * 50:
        p = prose(size)
        k = r.randrange(size)
        texts += [prose(50) + p + prose(50), prose(50) + [*p[:k], "changed", *p[k + 1 :]] + prose(50)]
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA).repartition(4)
    got = {x.doc_id for x in passages.digest(df).collect()}
    pairs = [d in got and d + 1 in got for d in range(200, 600, 2)]
    print("near recall:", len(want & got) / len(want), len(want), sum(pairs) / len(pairs))
    assert len(want & got) >= 0.9 * len(want)
    assert sum(pairs) >= 0.9 * len(pairs)


def test_every_near_pair_is_found(spark):
    """Isolated pairs with one word changed, too few of whose min-hashes may be equal; and a family of variants, where few are like the first."""
    r = random.Random(12)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for size in (50, 51, 52, 54) * 75:
        p = prose(size)
        k = r.randrange(5, size - 5)
        texts += [prose(30) + p + prose(30), prose(40) + [*p[:k], "changed", *p[k + 1 :]] + prose(20)]
    pairs = len(texts)
    passage = prose(60)
    for _ in range(80):
        p = list(passage)
        for k in r.sample(range(5, 55), 2):
            p[k] = f"x{r.randrange(10**6)}"
        texts.append(prose(30) + p + prose(30))
    sets = [[tuple(t[i : i + 5]) for i in range(30, 86)] for t in texts[pairs:]]

    def alike(x, y):
        for i in range(len(x) - 45):
            for j in range(i + 46, len(x) + 1):
                a, b = set(x[i:j]), set(y[i:j])
                if x[i] == y[i] and x[j - 1] == y[j - 1] and len(a & b) >= 0.8 * len(a | b):
                    return True
        return False

    family = {pairs + d for d, x in enumerate(sets) if any(alike(x, y) for y in sets if y is not x)}
    df = spark.createDataFrame(rows([" ".join(t) for t in texts]), SCHEMA).repartition(4)
    got = {x.doc_id for x in passages.digest(df).collect()}
    print("lost:", len(set(range(pairs)) - got), "of", pairs, len(family - got), "of", len(family))
    assert set(range(pairs)) <= got
    assert family <= got


def test_runs_that_many_have_make_few_pairs(spark):
    """Texts of words again and again, and copies with changes: compared with few others, and nothing is lost."""
    r = random.Random(15)
    word = lambda: f"w{r.randrange(10**6)}"
    # Each has a run that all have, with others next to it; two of them go on alike for long enough.
    single = [["the"] * r.randrange(25, 45) for _ in range(120)]
    texts = [[word()] * 40 + s + [word()] * 40 + [word() for _ in range(60)] for s in single]
    texts += [[*t[:40], *t[40:-90], *[word() for _ in range(60)]] for t in texts[:2]]
    long = [[word() for _ in range(60)] + ["of"] * k + [word() for _ in range(60)] for k in (60, 75, 130, 200)]
    copy = [word() for _ in range(300)]
    copies = []
    for _ in range(60):
        c = list(copy)
        for k in r.sample(range(300), 3):
            c[k] = word()
        copies.append(c)
    df = spark.createDataFrame(rows([" ".join(t) for t in texts + long + copies]), SCHEMA).repartition(4)
    p, pairs = passages.Passages(df), []
    compare = p._compare
    p._compare = lambda q: pairs.append(q.select("a", "b").distinct().count()) or compare(q)
    got = {x.doc_id: x for x in p.documents().collect()}
    print("pairs:", pairs)
    assert sum(pairs) < 1500
    n = len(texts)
    assert {0, 1, 120, 121} <= set(got) and not set(range(2, 120)) & set(got)
    assert all(covered(got[n + i].passages, 400)[60 : 60 + k].all() for i, k in enumerate((60, 75, 130, 200)))
    assert all(got[d].n_repeated >= 280 for d in range(n + 4, n + 64))


def test_passages_awkward_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [*EMPTY, "same " * 30_000, "same " * 20_000, long, long.upper(), long + " more", " ".join(f"w{i}" for i in range(49)), "a b " * 100]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    n = len(EMPTY)
    got = {r.doc_id: r.passages for r in passages.digest(df).collect()}
    assert {k: got[k] for k in (n + 2, n + 3, n + 4)} == {n + 2: "0:60", n + 3: "0:60", n + 4: "0:60"}
    assert n + 5 not in got and not set(range(n)) & set(got)
    assert passages.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert passages.digest(df.where(f"doc_id = {n + 2}").union(df.where(f"doc_id = {n + 2}"))).count() == 0


# --- components and pipeline -------------------------------------------------


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 200)] + [(500, i) for i in range(501, 700)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    r.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x.node: x.component for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_pipeline_against_brute_force(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "packing"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in quality.digest(docs, labels).where("predicted = 1").collect()}
    now = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    now = [(d, "\n".join(x)) for d, (_, x) in line_dedup(now).items()]
    first = {d for d, (n, c) in components(now, 5, 80).items() if n == 0 or c == d}
    now = [(d, t) for d, t in now if d in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {d for d, (n, hit, _) in contamination(now, items).items() if hit and 20 * len(hit) >= n}
    now = {d: t for d, t in now if d not in bad}
    df = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = shared.written(f(spark, df, data), name)
        assert df.columns == columns
    assert {r.doc_id: r.text for r in df.collect()} == now
    check_packing(df, tokenizer)
    pieces = corpus_pipeline.run(spark, data)
    assert {r.doc_id: r.doc_tokens for r in pieces.collect()} == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in now.items()}


def awkward_tables(spark, data, folder, docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_of_awkward_rows(spark, data, tmp_path):
    """Null, empty, very long and repeated texts, ties and columns with the operators' own names."""
    r = random.Random(4)
    prose = " ".join(r.choice("The report of our meeting was long and clear about all that had been said before noon".split()) for _ in range(120)) + "."
    long = "\n".join(f"Line number {i} of a very long text has words of its own like w{r.randrange(10**6)} and more." for i in range(6000))
    texts = [*EMPTY, prose, prose, long, "é" * 50, "x"]
    own = spark.createDataFrame(rows(texts, first=10**6) + rows([prose, None], first=10**6 + len(EMPTY)), SCHEMA)
    others = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars", "'k' row_key", "0.5D score", "1 key", "'p' place", "0 dropped")
    docs = others.unionByName(own)
    folder = awkward_tables(spark, data, tmp_path / "some", docs)
    df, counts = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, df = df, shared.written(f(spark, df, folder), name)
        assert df.columns == docs.columns
        counts[name] = (before.count(), df.count())
    assert counts["line_dedup"][0] == counts["line_dedup"][1]
    kept = df.collect()
    # A row of each repeated document at most, and of copies the one with the smallest id.
    assert len({x.doc_id for x in kept}) == len(kept)
    assert 10**6 + len(EMPTY) + 1 not in {x.doc_id for x in kept}
    assert all(x.n_chars == len(x.text) for x in kept if x.text is not None and x.doc_id >= 10**6)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {x.doc_id for x in kept}


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    folder = awkward_tables(spark, data, tmp_path / "none", docs)
    assert corpus_pipeline.run(spark, folder).count() == 0
