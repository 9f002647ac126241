"""Statements in a text about how it was made: findings with exact places, and a verdict."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.display import surroundings

# Patterns of statements.
DISCLOSURES = (
    r"(?iu)(?:השתמשתי|השתמשנו|נעזרתי|נעזרנו)\s+(?:בכלי\s+)?(?:ב?בינה מלאכותית|ב[־-]?AI|ב[־-]?(?:ChatGPT|Claude|Gemini))",
    r"(?iu)(?:העבודה|המסמך|הטקסט)\s+(?:הזאת\s+|הזה\s+)?(?:נכתב[ה]?|נוצר[ה]?)\s+(?:(?:כולו|כולה|באמצעות|בעזרת|על ידי)\s+){0,3}(?:בינה מלאכותית|AI|ChatGPT|Claude|Gemini)",
    r"(?i)(?<![0-9A-Za-z_])(?:I|we)\s+(?:used|have used)\s+(?:an?\s+)?(?:AI|ChatGPT|Claude|Gemini)(?![0-9A-Za-z_])",
    r"(?:استخدمت|استخدمنا)\s+(?:الذكاء الاصطناعي|ChatGPT)",
)
ASSISTANT = r"(?iu)as an ai language model|כמודל שפה של בינה מלאכותית|بوصفي نموذج[اً]* لغوي[اً]*"
QUOTED = '["“”«»]'
DENIAL = r"(?i)(?:^|\s)(?:לא|ללא|איני|لم|لن)(?:\s|$)|(?<![0-9A-Za-z_])(?:not|never|didn't|without)(?![0-9A-Za-z_])"
DISCUSSION = r"(?i)מחקר|למשל|לדוגמ[הא]|ציטוט|כדוגמה|אמר|שאלון|(?<![0-9A-Za-z_])(?:example|quote|questionnaire|said|study)(?![0-9A-Za-z_])"
SECTION = "הצהרה על שימוש בכלי בינה מלאכותית"
SECTION_YES, SECTION_NO = "השימוש נעשה|השתמשתי|נעזרתי", "לא נעשה|ללא שימוש"

#: Each pattern has one of these, in small letters; a cheap filter before texts are cut into lines. The last one may stand for an s.
ANCHORS = ("used", "as an ai", "השתמש", "נעזר", "העבודה", "המסמך", "הטקסט", "כמודל שפה", "استخدم", "بوصفي", SECTION, "ſ")

LINE = "index int, text string, start_cp bigint, end_cp bigint, start_utf16 bigint, end_utf16 bigint"
#: Texts whose lines are returned at a time, but for the last about so many lines.
LINES_AT_ONCE = 20_000


def paragraph_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a line: key, index, text, start and end in code points and UTF-16 units.

    Lines are runs without a line break.  One pass over each text, whatever the
    number of its lines; null and empty texts have none.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, columns = [], [[] for _ in range(6)]

            def out():
                types = (pa.int32(), pa.string(), *[pa.int64()] * 4)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], [key, "index", "text", "start_cp", "end_cp", "start_utf16", "end_utf16"])

            for k, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                wide = [] if t.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", t)]
                for n, m in enumerate(re.finditer(r"[^\r\n]+", t)):
                    s, e = m.span()
                    rows.append(k)
                    for c, v in zip(columns, (n, m[0], s, e, s + bisect_left(wide, s), e + bisect_left(wide, e))):
                        c.append(v)
                if len(rows) >= LINES_AT_ONCE:
                    yield out()
                    rows, columns = [], [[] for _ in range(6)]
            if rows:
                yield out()

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {LINE}")


def _matches(p: Column, patterns: tuple[str, ...]) -> Column:
    """All matches of all patterns with the places where they begin in the paragraph; pattern by pattern."""

    def of(pattern: str) -> Column:
        hits = T.found(p, pattern)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<quote:string,at:int>>").alias("out"))

        def step(s, h):
            at = s["at"] + F.instr(F.substring(p, s["at"] + 1, F.length(p)), h) - 1
            return F.struct((at + F.length(h)).alias("at"), F.array_append(s["out"], F.struct(h.alias("quote"), at.cast("int").alias("at"))).alias("out"))

        return F.aggregate(hits, start, step, lambda s: s["out"])

    return F.flatten(F.array(*map(of, patterns)))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a finding: key, paragraph, type, quote, start and end in code points, context.

    Disclosures in quotation, denial or discussion are none.  A paragraph after a
    disclosure section's title (up to three) that says so is one as well, unless it
    already has one.
    """
    low = F.lower(text)
    rows = paragraph_rows(docs.where(reduce(or_, (F.contains(low, F.lit(a)) for a in ANCHORS))), key, text)
    p = F.col("text")
    guarded = p.rlike(QUOTED) | p.rlike(DENIAL) | p.rlike(DISCUSSION)
    kinds = rows.select("*", F.explode(F.array(
        F.struct(F.lit("ai_use_disclosure").alias("type"), F.when(~guarded, _matches(p, DISCLOSURES)).otherwise(F.array().cast("array<struct<quote:string,at:int>>")).alias("hits")),
        F.struct(F.lit("assistant_phrase").alias("type"), _matches(p, (ASSISTANT,)).alias("hits")),
    )).alias("k"))
    hits = kinds.select(key, F.col("index").alias("paragraph"), F.col("k.type").alias("type"), "start_cp", "text", F.explode("k.hits").alias("h"))
    direct = hits.select(key, "paragraph", "type", F.col("h.quote").alias("quote"), (F.col("start_cp") + F.col("h.at")).alias("start"), (F.col("start_cp") + F.col("h.at") + F.length("h.quote")).alias("end"), surroundings(p, F.col("h.at"), F.length("h.quote")).alias("context"))
    order = Window.partitionBy(key).orderBy("index")
    title = F.max(p.rlike(SECTION)).over(order.rowsBetween(-3, -1))
    section = rows.withColumn("below", F.coalesce(title, F.lit(False))).where("below").where(p.rlike(SECTION_YES) & ~p.rlike(SECTION_NO))
    section = section.select(key, F.col("index").alias("paragraph"), F.lit("ai_use_disclosure").alias("type"), F.col("text").alias("quote"), F.col("start_cp").alias("start"), F.col("end_cp").alias("end"), surroundings(p, F.lit(0), F.length(p)).alias("context"))
    known = direct.where("type = 'ai_use_disclosure'").select(key, "paragraph").distinct()
    return direct.unionByName(section.join(known, [key, "paragraph"], "left_anti"))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, findings, displayed (60 at most), status and verdict for every row of docs."""
    n = findings(docs, key, text).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "ai_use_disclosure").alias("d"), F.count_if(F.col("type") == "assistant_phrase").alias("a"))
    d, a = F.coalesce("d", F.lit(0)), F.coalesce("a", F.lit(0))
    status = F.when(d > 0, "self_reported").when(a > 0, "content_signal").otherwise("not_assessed")
    verdict = F.when(d > 0, "AI_USE_DISCLOSED").when(a > 0, "AI_RESIDUE_FOUND").otherwise("CLASSIFIER_NOT_CONFIGURED")
    total = F.coalesce("n", F.lit(0))
    return docs.select(key).join(n, key, "left").select(key, total.cast("long").alias("findings"), F.least(total, F.lit(60)).cast("long").alias("displayed"), status.alias("status"), verdict.alias("verdict"))


def with_process_verdict(df: DataFrame) -> DataFrame:
    """verdict after a file's process status is known: only where the text itself says nothing."""
    open_ = F.col("status") == "not_assessed"
    return df.withColumn("verdict", F.when(open_ & (F.col("process_status") == "strong_assembly_signal"), "STRONG_FILE_ASSEMBLY_SIGNAL").when(open_ & (F.col("process_status") == "assembly_review"), "FILE_ASSEMBLY_REVIEW").otherwise(F.col("verdict")))


def with_source_claim(df: DataFrame) -> DataFrame:
    """A trusted signed claim of AI origin settles the status."""
    return df.withColumn("status", F.when(F.coalesce(F.col("trusted") & F.col("ai_declared"), F.lit(False)), "authenticated_source_claim").otherwise(F.col("status")))


def segments(docs: DataFrame, size: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each `size` words of a text: key, segment, words, first and last word."""
    w = docs.select(key, T.words(F.col(text)).alias("w"))
    parts = w.where(F.size("w") > 0).select(key, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("segment"))
    piece = F.slice("w", F.col("segment") * size + 1, F.lit(size))
    return parts.select(key, "segment", F.size(piece).cast("long").alias("words"), piece[0].alias("first_word"), F.element_at(piece, -1).alias("last_word"))


def greedy_windows(docs: DataFrame, least: int = 160, most: int = 260, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences in buckets: a bucket is closed before a sentence that would pass `most` words once it has `least`."""
    sizes = F.transform(T.sentences(F.col(text)), lambda s: T.occurrences(s, T.TOKEN))
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<words:bigint,sentences:bigint>>").alias("out"))

    def step(s, n):
        closed = F.array_append(s["out"], F.struct(s["words"].alias("words"), s["n"].alias("sentences")))
        full = (s["words"] >= least) & (s["words"] + n > most)
        return F.when(full, F.struct(n.alias("words"), F.lit(1).cast("long").alias("n"), closed.alias("out"))).otherwise(F.struct((s["words"] + n).alias("words"), (s["n"] + 1).alias("n"), s["out"].alias("out")))

    folded = F.aggregate(sizes, start, step, lambda s: F.when(s["n"] > 0, F.array_append(s["out"], F.struct(s["words"].alias("words"), s["n"].alias("sentences")))).otherwise(s["out"]))
    return docs.select(key, F.posexplode(folded).alias("window", "b")).select(key, "window", "b.words", "b.sentences")


def change_points(scores: DataFrame, key: str = "doc_id", least_windows: int = 3, spread: float = 32) -> DataFrame:
    """key, windows, spread, mixed: whether a document's window scores lie far apart."""
    s = F.max("score") - F.min("score")
    return scores.groupBy(key).agg(F.count("*").alias("windows"), s.alias("spread")).withColumn("mixed", F.when((F.col("windows") >= least_windows) & (F.col("spread") >= spread), "review").otherwise("none"))
