from __future__ import annotations

import hashlib

from helpers import EMPTY, SCHEMA, line_dedup, rows
from pyspark.sql import functions as F

from glyphmill.llm import lines

LONG = "This very line is longer than twenty"


def wanted(docs):
    return {d: (n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for d, (n, kept) in line_dedup(docs).items()}


def got(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert got(lines.digest(docs)) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_texts(spark):
    texts = [*EMPTY, LONG, f"  {LONG.upper()}\t\n{LONG}\nshort\n{LONG}", f"{LONG}\r\nx", "é" * 19, "é" * 20, "É" * 20, "é" * 20, f"{'é' * 20}\n{'é' * 20}", "z\n" * 50_000, "Ünlike ASCII, this stays as it is\n" * 3]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert got(lines.digest(df)) == wanted(list(enumerate(texts)))


def test_a_line_of_most_documents_runs_over_partitions(spark):
    texts = [f"{LONG}\nown line of document number {i}\n{LONG}" for i in range(3000)]
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(7)
    gone = lines.keep_bitmaps(df, partitions=16)
    assert gone.count() == 2999
    assert got(lines.digest(df)) == wanted(list(enumerate(texts)))


def test_two_documents_are_too_few_and_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame(rows([LONG, LONG]) + rows([LONG, LONG]), SCHEMA)
    assert {r.n_dropped for r in lines.digest(df).collect()} == {0}
    null = spark.createDataFrame([(None, LONG), (1, LONG), (2, LONG)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.digest(null).collect()} == {None: 1, 1: 1, 2: 0}


def test_empty_table(spark):
    assert lines.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bitmaps_restore_the_text(spark):
    df = spark.createDataFrame(rows([f"a\n{LONG}\nb"] * 3 + [None, ""]), SCHEMA)
    packed = {r.doc: r.keep for r in lines.keep_bitmaps(df).collect()}
    assert {d: lines.dropped_lines(k).tolist() for d, k in packed.items()} == {0: [1], 1: [1]}
    kept = {r.doc_id: lines.kept_lines((r.text or "").encode(), r["__keep"]) for r in lines.with_bitmaps(df).collect()}
    assert kept == {0: (b"a\nb", 3, 1), 1: (b"a\nb", 3, 1), 2: (f"a\n{LONG}\nb".encode(), 3, 0), 3: (b"", 1, 0), 4: (b"", 1, 0)}
    new = lines.rewritten(df)
    assert new.columns == df.columns
    assert new.where(F.col("n_chars") != F.length("text")).count() == 0
    assert new.where("doc_id < 2").select("text").distinct().first()[0] == "a\nb"
    assert {r.text for r in new.where("doc_id > 2").collect()} == {None, ""}


def test_bitmap_of_many_lines():
    for gone in ([0], [7], [8], [3, 99_999]):
        assert lines.dropped_lines(lines.bitmap(gone)).tolist() == gone
    assert len(lines.bitmap([3, 99_999])) < 200
