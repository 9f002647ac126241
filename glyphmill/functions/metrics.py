"""Style metrics and panel scores of a text, as column expressions.

Ratios are written over sums of integers, so their value does not depend on the
order of rows: with S the sum and Q the sum of squares of n counts, the
coefficient of variation is sqrt(n Q - S S) / S.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)


def variation(counts: Column) -> Column:
    """Population standard deviation over mean; 0 without values."""
    n, s, q = F.size(counts).cast("long"), total(counts), total(F.transform(counts, lambda x: x * x))
    return F.when(s > 0, F.sqrt((n * q - s * s).cast("double")) / s).otherwise(0.0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda that names an expression would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def frequency(xs: Column) -> Column:
    """How often each distinct value occurs: the lengths of runs in the sorted array."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        sizes = let(starts, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(n)), lambda a, b: (b - a).cast("long")))
        return F.when(n > 0, sizes).otherwise(F.array().cast("array<bigint>"))

    return let(F.sort_array(xs), runs)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits from counts."""

    def bits(c: Column) -> Column:
        n = total(c)
        return F.when(n > 0, F.log2(n) - F.aggregate(c, F.lit(0.0), lambda s, k: s + k * F.log2(k)) / n).otherwise(0.0)

    return let(counts, bits)


def distinct_ratio(xs: Column) -> Column:
    n = F.size(xs)
    return F.when(n > 0, F.size(F.array_distinct(xs)) / n).otherwise(0.0)


def ngram_hashes(xs: Column, n: int) -> Column:
    """64 bits for each n successive values: what only has to be compared is compared as numbers."""
    return let(xs, lambda a: F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>")))


def repeat_ratio(xs: Column, n: int) -> Column:
    """Share of n-grams that repeat an earlier one; 0 for fewer than 2 n tokens."""
    count = F.size(xs) - n + 1
    return F.when(F.size(xs) >= 2 * n, (count - F.size(F.array_distinct(ngram_hashes(xs, n)))) / count).otherwise(0.0)


def repeated_starts(tokens: Column) -> Column:
    """1 less the share of distinct first three tokens, from sentences as arrays of tokens."""
    starts = F.filter(F.transform(tokens, lambda t: F.lower(F.array_join(F.slice(t, 1, 3), " "))), lambda x: x != "")
    return let(starts, lambda s: F.when(F.size(s) > 0, 1 - F.size(F.array_distinct(s)) / F.size(s)).otherwise(0.0))


def starter_repetition(sentences: Column) -> Column:
    return repeated_starts(F.transform(sentences, T.tokens))


def punctuation_diversity(text: Column, pattern: str = T.PUNCTUATION, most: int = 12) -> Column:
    marks = T.found(text, pattern)
    n = F.size(marks)
    return F.when(n > 0, F.size(F.array_distinct(marks)) / F.least(n, F.lit(most))).otherwise(0.0)


def adjacent_overlap(sentences: Column) -> Column:
    """Mean Jaccard similarity of neighbouring sentences' tokens of more than three characters."""
    sets = F.transform(sentences, lambda s: F.array_distinct(F.filter(F.transform(T.tokens(s), F.lower), lambda t: F.length(t) > 3)))

    def overlap(a: Column) -> Column:
        before, after = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(1)))
        pairs = F.zip_with(before, after, lambda x, y: F.struct(F.size(F.array_intersect(x, y)).alias("i"), F.size(F.array_union(x, y)).alias("u")))
        mean = lambda kept: F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, p: s + p["i"] / p["u"]) / F.size(kept)).otherwise(0.0)
        return let(F.filter(pairs, lambda p: p["u"] > 0), mean)

    return let(sets, overlap)


@F.pandas_udf(DoubleType())
def gzip_ratio(texts: pd.Series) -> pd.Series:
    """Bytes after compression at level 9 over bytes before; 0 for an empty text."""
    raw = (t.encode("utf-8", "surrogatepass") if t else b"" for t in texts)
    return pd.Series([len(gzip.compress(b, 9, mtime=0)) / len(b) if b else 0.0 for b in raw], dtype=float)


def clamped(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def points(*rules: tuple[Column, int]) -> Column:
    """Sum of the points of the rules that hold."""
    return sum((F.when(c, p).otherwise(0) for c, p in rules[1:]), F.when(rules[0][0], rules[0][1]).otherwise(0))


def measured(docs: DataFrame, text: str = "text", compression: bool = True) -> DataFrame:
    """docs with the metrics that panels are made of, each computed once a row."""
    t = F.col("__t")
    out = docs.withColumn("__t", T.trimmed(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumns({"__tokens": F.transform(T.tokens(t), lambda x: F.xxhash64(F.lower(x))), "__sentences": F.transform(T.sentences(t), T.tokens), "__paragraphs": T.paragraphs(t)})
    lens = F.filter(F.transform("__sentences", lambda s: F.size(s).cast("long")), lambda n: n > 0)
    out = out.withColumns({"__lens": lens, "__plens": F.transform("__paragraphs", lambda p: T.occurrences(p, T.TOKEN)), "language": T.panel_language(t)})
    return out.withColumns(
        {
            "words": F.size("__tokens").cast("long"),
            "sentences": F.size("__sentences").cast("long"),
            "paragraphs": F.size("__paragraphs").cast("long"),
            "sentence_cv": variation(F.col("__lens")),
            "paragraph_cv": variation(F.col("__plens")),
            "sentence_mean": F.when(F.size("__lens") > 0, total(F.col("__lens")) / F.size("__lens")).otherwise(0.0),
            "ttr": distinct_ratio(F.col("__tokens")),
            "entropy": entropy(frequency(F.col("__tokens"))),
            "repeat3": repeat_ratio(F.col("__tokens"), 3),
            "repeat4": repeat_ratio(F.col("__tokens"), 4),
            "starters": repeated_starts(F.col("__sentences")),
            "punctuation": punctuation_diversity(t),
            "markers": T.ascii_discourse_count(t, F.col("language")),
            "residue": T.residue_count(t),
            "exclaims": T.occurrences(t, "[!?]"),
            "parentheses": T.occurrences(t, "[()]"),
            "compression": gzip_ratio(t) if compression else F.lit(1.0),
        }
    ).drop("__tokens", "__sentences", "__paragraphs", "__lens", "__plens", "__t")


PANELS = ("rhythm", "lexical", "discourse", "surface_style", "predictability", "ai_residue")


def with_panels(df: DataFrame) -> DataFrame:
    """The six panels and the local score, from what ``measured`` gives."""
    c = F.col
    w = c("words")
    panels = {
        "rhythm": points(((w > 120) & (c("sentence_cv") < 0.38), 35), ((w > 180) & (c("paragraph_cv") > 0) & (c("paragraph_cv") < 0.32), 25), ((c("sentence_mean") > 17) & (c("sentence_mean") < 30), 12), (c("starters") > 0.22, 18)),
        "lexical": points(((w > 180) & (c("ttr") < 0.44), 28), ((w > 180) & (c("entropy") < 7.1), 18), (c("repeat4") > 0.012, 24), (c("repeat3") > 0.025, 18)),
        "discourse": points(((w > 0) & (c("markers") / F.nullif(w, F.lit(0)) > 0.009), 40), (c("starters") > 0.18, 25)),
        "surface_style": points(((w > 180) & (c("punctuation") < 0.4), 25), ((w > 180) & (c("exclaims") == 0), 12), ((w > 180) & (c("parentheses") / F.nullif(w, F.lit(0)) < 0.003), 10)),
        "predictability": points((c("compression") < 0.53, 35), ((c("compression") >= 0.53) & (c("compression") < 0.60), 22), (c("repeat3") > 0.02, 25), (c("entropy") < 6.8, 18), (c("sentence_cv") < 0.32, 18)),
        "ai_residue": F.when(c("residue") > 0, 100).otherwise(0),
    }
    out = df.withColumns({k: F.least(F.lit(100), v).cast("long") for k, v in panels.items()})
    weights = dict(zip(PANELS, (22, 18, 19, 10, 21, 10)))
    score = sum((F.col(k) * n for k, n in weights.items()), F.lit(0))
    return out.withColumn("local_score", F.least(F.lit(100), F.floor((score + 50) / 100)).cast("long"))
