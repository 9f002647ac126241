"""What is shown of results: escaped text, sizes, surroundings of a finding, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_escaped(text: Column) -> Column:
    """The five signs with a meaning in HTML as entities; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def byte_size(n: Column) -> Column:
    """Bytes as B, KB or MB; with one decimal, halves up, from KB on."""
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(tenth(n / 1024), F.lit(" KB"))).otherwise(F.concat(tenth(n / (1 << 20)), F.lit(" MB")))


def surroundings(paragraph: Column, at: Column, length: Column) -> Column:
    """A paragraph of up to 400 code points whole, of a longer one 100 before a finding and 150 after it."""
    begin = F.greatest(F.lit(0), at - 100)
    return F.when(F.length(paragraph) <= 400, paragraph).otherwise(F.substring(paragraph, begin + 1, at + length + 150 - begin))


def regions_summary(scores: Column) -> Column:
    """Of the scores of a document's regions: how many, their mean, rounded, and how many are high."""
    n = F.size(scores)
    mean = F.floor(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0)) + 0.5)
    return F.struct(n.cast("long").alias("regions"), mean.cast("long").alias("mean"), F.size(F.filter(scores, lambda x: x >= 60)).cast("long").alias("high"))


def coverage(*there: Column) -> Column:
    """Share of the tools that had something to look at, in whole percent."""
    return F.floor(sum((F.coalesce(x, F.lit(False)).cast("int") for x in there), F.lit(0)) / len(there) * 100 + 0.5).cast("long")


def plan(checks: Column) -> Column:
    """Lists of checks as one, each where it comes first."""
    return F.array_distinct(F.flatten(checks))


def plan_confidence(items: Column) -> Column:
    """What a plan of so many checks can reach; an empty one nothing."""
    n = F.size(items)
    return F.when(n > 0, F.least(F.lit(92), 34 + 7 * n)).otherwise(0).cast("long")


def graph_kind(extension: Column) -> Column:
    """Which chain of stages a file of that extension has; generic ones have none."""
    e = F.lower(extension)
    return F.when(e.isin(".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff"), "image").when(e.isin(".docx", ".docm"), "document").otherwise("generic")
