"""How a Word file was put together: process score, lineage anomaly, run candidates, origin map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.metrics import clamped, measured, with_panels


def _number(c: str) -> Column:
    return F.coalesce(F.try_to_number(F.col(c), F.lit("999999999")).cast("long"), F.lit(0))


def process_scores(structure: DataFrame, properties: DataFrame) -> DataFrame:
    """asset_id, score, status and the rules that hold, from ``sources.ooxml.structure`` and ``properties``."""
    j = structure.join(properties, "asset_id", "left").withColumns({"words": _number("Words"), "pages": _number("Pages"), "minutes": _number("TotalTime"), "revision_no": _number("revision")})
    words, used, declared = F.col("words"), F.size("used_sessions"), F.size("declared_sessions")
    epoch = (F.col("entries") >= 8) & F.col("all_dos_epoch")
    tracked = F.col("insertions") + F.col("deletions") + F.col("moves")
    rules = (
        ("dos_epoch_package", 32, epoch),
        ("uniform_package_time", 10, ~epoch & (F.col("entries") >= 8) & (F.col("zip_times") == 1)),
        ("zero_metadata_lifetime", 18, (words >= 1000) & F.col("created").isNotNull() & (F.col("created") == F.col("modified"))),
        ("zero_editing_time", 18, (words >= 1000) & (F.col("minutes") == 0)),
        ("stale_pagination", 12, (words >= 3000) & (F.col("pages") <= 1)),
        ("single_revision", 8, (words >= 1000) & (F.col("revision_no") <= 1)),
        ("sparse_used_edit_sessions", 8, (words >= 1000) & (used <= 3)),
        ("rsid_template_residue", 4, (declared >= 8) & (used <= 3)),
        ("privacy_strip", 0, F.col("strips_persons")),
        ("revision_time_strip", 0, F.col("strips_times")),
        ("no_tracked_changes", 0, tracked == 0),
    )
    holds = [(k, p, F.coalesce(c, F.lit(False))) for k, p, c in rules]
    score = F.least(F.lit(100), sum((F.when(c, p).otherwise(0) for _, p, c in holds), F.lit(0)))
    status = F.when(score >= 70, "strong_assembly_signal").when(score >= 40, "assembly_review").when(score >= 20, "limited_process_signal").otherwise("ordinary_or_insufficient")
    return j.select("asset_id", "words", score.cast("long").alias("score"), status.alias("status"), F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, _, c in holds))).alias("rules"))


def lineage(parts: DataFrame, structure: DataFrame, properties: DataFrame) -> DataFrame:
    """asset_id, share of the most frequent package time, and the lineage anomaly score."""
    times = parts.where("status = 'ok'").groupBy("asset_id", "zip_time").count().groupBy("asset_id").agg((F.max("count") / F.sum("count")).alias("share"))
    j = structure.join(times, "asset_id").join(properties, "asset_id", "left").withColumn("words", _number("Words"))
    w, tracked = F.col("words"), F.col("insertions") + F.col("deletions") + F.col("moves")
    rules = ((F.col("share") > 0.9, 28), ((F.col("TotalTime") == "0") & (w > 800), 22), ((F.size("used_sessions") <= 3) & (w > 1500), 18), ((tracked == 0) & (w > 3000), 8), ((F.col("Pages") == "1") & (w > 1500), 12))
    score = sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0))
    return j.select("asset_id", F.round("share", 3).alias("time_share"), F.least(F.lit(100), score).cast("long").alias("anomaly"))


def risk(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, risk, findings, verdict: conflicts count 35, reviews 12, all else 4, 100 at most."""
    p = F.when(F.col("severity") == "conflict", 35).when(F.col("severity") == "review", 12).otherwise(4)
    out = findings.groupBy(key).agg(F.least(F.sum(p), F.lit(100)).alias("risk"), F.count("*").alias("findings"))
    return out.withColumn("verdict", F.when(F.col("risk") >= 60, "CONFLICT").when(F.col("risk") >= 20, "REVIEW").otherwise("LOW SIGNAL"))


def run_candidates(runs: DataFrame, least: int = 40) -> DataFrame:
    """Runs that look edited on their own, scored against their neighbours in the paragraph."""
    order = Window.partitionBy("asset_id", "paragraph").orderBy("run")
    whole = Window.partitionBy("asset_id", "paragraph")
    effective = F.coalesce("run_rsid", "paragraph_rsid")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumns({"session": effective, "n_runs": F.count("*").over(whole), "para_text": F.array_join(F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), ""), "at": F.coalesce(before, F.lit(0))})
    paras = r.where("run = 0").select("asset_id", "paragraph", (F.length("para_text") + 1).alias("len"))
    first = paras.withColumn("para_start", F.coalesce(F.sum("len").over(Window.partitionBy("asset_id").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("len")
    sessions = runs.where("run_rsid is not null").groupBy("asset_id", "run_rsid").agg(F.count("*").alias("session_runs"))
    styles = runs.groupBy("asset_id", "style").agg(F.count("*").alias("style_runs"))
    r = r.join(first, ["asset_id", "paragraph"]).join(sessions, ["asset_id", "run_rsid"], "left").join(styles, ["asset_id", "style"])
    near = {f"{p}_{c}": f(c).over(order) for p, f in (("prev", F.lag), ("next", F.lead)) for c in ("session", "style", "lang", "no_proof", "run")}
    r = r.withColumns(near)
    c = F.col
    wc = T.occurrences(c("text"), T.TOKEN)
    short, both = (wc > 0) & (wc <= 7), c("prev_run").isNotNull() & c("next_run").isNotNull()
    label = T.trimmed(c("text")).rlike(r"[:：]$") | c("bold") | c("italic")
    rules = (
        ("tracked", 80, c("inserted") | c("deleted")),
        ("rare_session", 30, c("session_runs") <= 2),
        ("between_sessions", 35, both & short & (c("prev_session") == c("next_session")) & (c("session") != c("prev_session"))),
        ("isolated_style", 24, both & short & (c("prev_style") == c("next_style")) & (c("style") != c("prev_style"))),
        ("language", 18, both & short & c("prev_lang").eqNullSafe(c("next_lang")) & c("lang").isNotNull() & ~c("lang").eqNullSafe(c("prev_lang"))),
        ("proofing", 15, both & short & (c("prev_no_proof") == c("next_no_proof")) & (c("no_proof") != c("prev_no_proof"))),
        ("rare_style", 10, (c("n_runs") >= 3) & short & (c("style_runs") <= 2)),
        ("label", -22, (c("run") == 0) & label),
        ("long", -12, wc > 18),
    )
    holds = [(k, p, F.coalesce(x, F.lit(False))) for k, p, x in rules]
    score = sum((F.when(x, p).otherwise(0) for _, p, x in holds), F.lit(0))
    evidence = F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, _, x in holds)))
    start = c("para_start") + c("at")
    out = r.where(T.trimmed(c("para_text")) != "").select("asset_id", "paragraph", "run", "text", start.cast("long").alias("start"), (start + F.length("text")).cast("long").alias("end"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), evidence.alias("evidence"))
    return out.where(c("score") >= least)


def merged_candidates(candidates: DataFrame, most: int = 60) -> DataFrame:
    """Neighbouring candidates of near scores as one; the strongest first.

    Whether one joins depends on the score merged so far, so it is a fold, not a window.
    """
    item = "struct<paragraph:int,start:bigint,end:bigint,score:int,text:string,evidence:array<string>>"
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", "start", "end", "score", "text", "evidence").cast(item)))

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        joins = (x["paragraph"] == last["paragraph"]) & (x["start"] - last["end"] <= 1) & (F.abs(x["score"] - last["score"]) <= 20)
        both = F.struct(last["paragraph"].alias("paragraph"), last["start"].alias("start"), x["end"].alias("end"), F.greatest(last["score"], x["score"]).alias("score"), F.concat(last["text"], x["text"]).alias("text"), F.array_union(last["evidence"], x["evidence"]).alias("evidence"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), both)).otherwise(F.array_append(out, x))

    folded = F.aggregate(ordered, F.array().cast(f"array<{item}>"), step)
    rows = candidates.groupBy("asset_id").agg(folded.alias("m")).select("asset_id", F.inline("m"))
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("score"), "start"))
    band = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 55, "medium").otherwise("low")
    return rows.withColumns({"confidence": band, "rank": rank}).where(F.col("rank") <= most)


def session_coverage(runs: DataFrame) -> DataFrame:
    """asset_id, runs, sessions, coverage: per cent of runs that carry a session."""
    return runs.groupBy("asset_id").agg(F.count("*").alias("runs"), F.count_distinct("run_rsid").alias("sessions"), F.round(F.avg(F.coalesce("run_rsid", "paragraph_rsid").isNotNull().cast("int")) * 100).cast("long").alias("coverage"))


def structural(text: Column) -> Column:
    """Empty, under five words, a dotted contents line, or under 35 % letters."""
    s = T.trimmed(text)
    visible, letters = F.length(F.regexp_replace(s, r"\s", "")), T.occurrences(s, r"[\p{L}\p{M}]")
    return (s == "") | (T.occurrences(s, T.TOKEN) < 5) | s.rlike(r"\.{6,}\s*[0-9]+\s*$") | ((visible > 0) & (letters / F.nullif(visible, F.lit(0)) < 0.35))


CONTEXT = "asset_id string, part string, index int, context string"


def _neighbourhoods(least: int):
    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        sizes, texts = frame["words"].tolist(), frame["text"].tolist()
        out = []
        for k in range(len(sizes)):
            lo = hi = k
            total = sizes[k]
            while total < least and (lo > 0 or hi < len(sizes) - 1):
                left = lo > 0 and (hi == len(sizes) - 1 or sizes[lo - 1] <= sizes[hi + 1])
                lo, hi = (lo - 1, hi) if left else (lo, hi + 1)
                total += sizes[lo] if left else sizes[hi]
            out.append("\n".join(t for t in texts[lo : hi + 1] if t))
        return pd.DataFrame({"asset_id": frame["asset_id"], "part": frame["part"], "index": frame["index"], "context": out})

    return grow


def neighbourhoods(paragraphs: DataFrame, least: int = 220) -> DataFrame:
    """Each paragraph with its neighbours in the part, the shorter side first, until `least` words.

    The two-sided greedy choice fits no window frame, so one part is one group;
    a part's size is bounded when its package is admitted.
    """
    sized = paragraphs.select("asset_id", "part", "index", "text", T.occurrences(F.col("text"), T.TOKEN).alias("words"))
    return sized.groupBy("asset_id", "part").applyInPandas(_neighbourhoods(least), CONTEXT)


def origin_map(paragraphs: DataFrame, documents: DataFrame, process: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row a prose paragraph: its origin score and label."""
    near = with_panels(measured(neighbourhoods(paragraphs), "context")).select("asset_id", "part", "index", F.col("local_score").alias("context_score"), "predictability", "lexical", "rhythm", "discourse", "ai_residue")
    own = with_panels(measured(paragraphs.where(~structural(F.col("text"))))).select("asset_id", "part", "index", "text", F.col("words").alias("n_words"), F.col("local_score").alias("own_score"))
    whole = with_panels(measured(documents)).select("asset_id", F.col("local_score").alias("document_score"))
    edits = candidates.groupBy("asset_id", F.col("paragraph").alias("index")).agg(F.max("score").alias("edit"), F.count("*").alias("hits")).withColumn("part", F.lit("word/document.xml"))
    j = own.join(near, ["asset_id", "part", "index"]).join(whole, "asset_id").join(process.select("asset_id", F.col("score").alias("process"), F.col("status").alias("process_status")), "asset_id", "left").join(edits, ["asset_id", "part", "index"], "left")
    c = lambda k: F.coalesce(F.col(k), F.lit(0))
    base = F.when(F.col("process_status") == "strong_assembly_signal", 46.0).when(F.col("process_status") == "assembly_review", 22.0).otherwise(F.least(F.lit(18.0), c("process") * 0.18))
    panels = sum((F.when(F.col(k) >= at, p).otherwise(0) for k, at, p in (("predictability", 35, 5), ("lexical", 35, 4), ("rhythm", 35, 3), ("discourse", 35, 3), ("ai_residue", 100, 24))), F.lit(0))
    score = base + F.col("context_score") * 0.36 + F.col("document_score") * 0.14 + F.when(F.col("n_words") >= 90, F.col("own_score") * 0.10).otherwise(0.0) + panels - F.least(F.lit(32.0), c("edit") * 0.34)
    j = j.withColumn("origin_score", F.floor(clamped(score) + 0.5).cast("long"))
    label = F.when(c("edit") >= 75, "human_edit_candidate").when(F.col("origin_score") >= 72, "strong_ai_signal").when(F.col("origin_score") >= 48, "likely_ai").when(F.col("origin_score") >= 30, "mixed_or_uncertain").otherwise("low_ai_signal")
    return j.select("asset_id", "part", "index", "n_words", "origin_score", label.alias("label"), c("hits").alias("hits"), "document_score", c("process").alias("process"), "process_status")


def origin_summary(items: DataFrame) -> DataFrame:
    """asset_id, paragraphs by label, share of words in strong and likely ones, document signal."""
    labels = ("strong_ai_signal", "likely_ai", "human_edit_candidate", "mixed_or_uncertain", "low_ai_signal")
    high = F.col("label").isin("strong_ai_signal", "likely_ai")
    a = items.groupBy("asset_id").agg(F.count("*").alias("paragraphs"), *(F.count_if(F.col("label") == k).alias(k) for k in labels), F.round(F.sum(F.when(high, F.col("n_words")).otherwise(0)) / F.sum("n_words") * 100).alias("high_share"), F.median("origin_score").alias("m"), F.first("document_score").alias("d"), F.first("process").alias("p"), F.first("process_status").alias("s"))
    base = F.when(F.col("s") == "strong_assembly_signal", 40.0).otherwise(F.col("p") * 0.30)
    return a.withColumn("document_signal", F.floor(clamped(base + F.col("d") * 0.32 + F.col("m") * 0.28) + 0.5).cast("long")).drop("m", "d", "p", "s")
