"""What of an academic text is prose: headings, contents, references and declarations set apart.

The reader's modes (body, contents, references) are windows over a document's
lines: a heading begins a segment; within a segment of contents or references
the first line that breaks the mode is found by a window minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T

# Headings, entries and declarations.
TOC = r"^(?:תוכן\s*(?:ה)?עניינים|תוכן הענינים|תוכן ענינים)$"
REFERENCES = r"(?i)^(?:ביבליוגרפיה|רשימת (?:ה)?מקורות|מקורות|מקורות מידע|References|Bibliography)$"
HEADINGS = r"^(?:מבוא|תקציר|סיכום|מסקנות|סיכום ומסקנות|דיון|דיון ומסקנות|סקירת ספרות|שיט(?:ת|ות) המחקר|מתודולוגיה|ממצאים|תוצאות|נספחים|נספח\s*[א-ת0-9]?)$"
TOC_ENTRY = r"[.…\t]{2,}\s*[0-9]+\s*$|[א-תA-Za-z)\]]\s*[0-9]{1,3}\s*$"
SECTION = r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?\s+|פרק\s|נספח\s)"
DECLARATION = r"^(?:הצהר(?:ה|ת)\s|אני (?:מצהיר|מצהירה|מאשר|מאשרת)(?:\s|$)|הנני מצהיר)"
FUNCTION_WORDS = "בנוסף ולכן לכן כמו כן לפיכך עם זאת כי או אם גם אך אבל של על ידי את זה זו הוא היא הם הן אשר כאשר כדי חשוב לציין לסיכום מכאן יתרה מכך בהתאם".split()


def heading(line: Column) -> Column:
    plain = T.trimmed(F.regexp_replace(F.regexp_replace(line, T.NIQQUD, ""), "[\"״׳']", ""))
    return F.regexp_replace(F.regexp_replace(plain, r"^[0-9]+(?:\.[0-9]+)*[.)]?\s*", ""), r"[:.\s]+$", "")


def classified_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a line: key, pos, line, rule (null for prose)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("s", T.trimmed(F.col("line")))
    s, h = F.col("s"), heading(F.col("s"))
    kind = F.when(h.rlike(TOC), "toc").when(h.rlike(REFERENCES), "references").when(h.rlike(HEADINGS), "body")
    section = (F.length(s) < 150) & ~s.rlike(r"[.!?]$") & (F.size(F.split(s, r"\s+")) <= 16) & s.rlike(SECTION)
    lines = lines.where(s != "").withColumns({"mode": kind, "section": section, "entry": (F.length(s) < 260) & s.rlike(TOC_ENTRY), "declared": (F.length(s) < 650) & s.rlike(DECLARATION)})
    order = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("segment", F.count("mode").over(order))
    seg = Window.partitionBy(key, "segment")
    lines = lines.withColumn("begun", F.first("mode", ignorenulls=True).over(seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    title = F.col("mode").isNotNull()
    breaks = ((F.col("begun") == "toc") & ~F.col("entry")) | ((F.col("begun") == "references") & F.col("section"))
    lines = lines.withColumn("broken", F.min(F.when(~title & breaks, F.col("pos"))).over(seg))
    before = F.col("broken").isNull() | (F.col("pos") < F.col("broken"))
    body = F.when(F.col("section"), "academic-heading").when(F.col("declared"), "declaration")
    rule = (
        F.when(title, "academic-heading")
        .when((F.col("begun") == "toc") & before, "table-of-contents")
        .when((F.col("begun") == "toc") & (F.col("pos") == F.col("broken")), F.when(F.col("section"), "academic-heading"))
        .when((F.col("begun") == "references") & before, "bibliography")
        .otherwise(body)
    )
    return lines.select(key, "pos", "line", rule.alias("rule"))


def exclusion_summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, excluded lines and characters, and lines by rule, for every row of docs."""
    out = classified_lines(docs, key, text).where("rule is not null")
    last = docs.select(key, F.size(F.split(text, "\n")).alias("n"))
    chars = F.length("line") + F.when(F.col("pos") < F.col("n") - 1, 1).otherwise(0)
    rules = ("academic-heading", "table-of-contents", "bibliography", "declaration")
    counts = [F.count_if(F.col("rule") == r).alias(r.replace("-", "_")) for r in rules]
    summed = out.join(last, key).groupBy(key).agg(F.count("*").alias("excluded_lines"), F.sum(chars).cast("long").alias("excluded_characters"), *counts)
    return docs.select(key).join(summed, key, "left").na.fill(0)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, body: the text with excluded lines blanked, of the same length."""
    rules = classified_lines(docs, key, text).where("rule is not null").groupBy(key).agg(F.collect_set("pos").alias("gone"))
    lines = F.split(text, "\n")
    blank = F.transform(lines, lambda x, i: F.when(F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return docs.select(key, text).join(rules, key, "left").select(key, F.array_join(blank, "\n").alias("body"))


def repeated_phrases(docs: DataFrame, n: int = 8, least_content: int = 5, most: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrases of n words within a line that a document has twice: key, phrase, count, rank; most frequent first."""
    lines = docs.select(key, F.posexplode(F.split(text, r"[\r\n]+")).alias("line_no", "line"))
    ws = lines.select(key, "line_no", F.transform(T.words(F.col("line")), lambda w: F.lower(F.regexp_replace(w, T.NIQQUD, ""))).alias("w")).where(F.size("w") >= n)
    grams = ws.select(key, "line_no", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, F.lit(n)))).alias("at", "gram"))
    content = F.array_except("gram", F.array(*map(F.lit, FUNCTION_WORDS)))
    grams = grams.where(F.size(content) >= least_content).select(key, F.array_join("gram", " ").alias("phrase"), F.struct("line_no", "at").alias("place"))
    counted = grams.groupBy(key, "phrase").agg(F.count("*").alias("count"), F.min("place").alias("first_place")).where("count >= 2")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first_place"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "phrase", "count", "rank")


def distribution(counts: Column) -> Column:
    """count, mean, median, coefficient of variation of an array of integers; nulls for none."""
    from glyphmill.functions.metrics import total, variation

    n, ordered = F.size(counts), F.array_sort(counts)
    mid = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(ordered, mid).cast("double")).otherwise((F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2)
    some = n > 0
    return F.struct(n.cast("long").alias("count"), F.when(some, F.round(total(counts) / n, 3)).alias("mean"), F.when(some, median).alias("median"), F.when(some, F.round(variation(counts), 3)).alias("variation"))


def profile(bodies: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """Prose profile of masked texts: words, distinct words, sentence and paragraph lengths, marks, niqqud per 1,000 letters."""
    b = F.col(body)
    w = F.transform(T.words(b), F.lower)
    letters = T.occurrences(b, "[א-ת]")
    marks = F.struct(*(T.occurrences(b, "\\" + m if m in ".?()" else m).alias(name) for m, name in ((".", "dot"), (",", "comma"), (";", "semicolon"), (":", "colon"), ("?", "question"), ("!", "exclamation"), ("—", "em_dash"), ("–", "en_dash"), ("(", "open"), (")", "close"), ("״", "gershayim"), ('"', "quote"))))
    sizes = lambda parts: F.filter(F.transform(parts, lambda s: T.occurrences(s, T.WORD)), lambda n: n > 0)
    return bodies.select(
        key, F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"),
        distribution(sizes(T.simple_sentences(b))).alias("sentence_lengths"), distribution(sizes(F.split(b, r"\r?\n+"))).alias("paragraph_lengths"),
        marks.alias("marks"), F.when(letters > 0, F.round(T.occurrences(b, T.NIQQUD) / letters * 1000, 3)).otherwise(0.0).alias("niqqud"),
    )
