"""Queries over the older style features, ladders and adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import display as D
from glyphmill.functions import metrics as M
from glyphmill.functions import text as T
from glyphmill.operators import evidence, fusion, verdicts
from glyphmill.sources import adapters, media

from . import fixtures as X
from .text_queries import CUT, TOKEN, _docs, _repeat_sql, _residue_sql, doc_greedy_windows, doc_panel_metrics, round6, table


def doc_legacy_style(spark, sf_dir):
    """F11, A9, A13 without compression: older metrics, panels and regularity."""
    d = verdicts.style_features(_docs(spark, sf_dir), compression=False)
    return d.select("doc_id", "language", "words", *(round6(F.col(k)).alias(k) for k in ("hapax", "adjacency", "formulas", "contractions", "colons")), "rhythm", "lexical", "discourse", "surface", "predictability", "regularity", "band")


_S = rf"list_filter(list_transform(string_split({CUT.replace('[.!?׃]', '[.!?؟׃]')}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_FORMULA = r"(?i)\b(?:moreover|furthermore|additionally|consequently|in conclusion|in summary|overall|it is important to note|it is worth noting|on the other hand|this highlights|this underscores|in today''s (?:rapidly )?(?:evolving|changing)|multifaceted|nuanced|seamless(?:ly)?|robust|leverag(?:e|ing)|transformative|foster(?:ing|s)?|landscape|delve|key considerations|not only\b[^.!?]{0,100}\bbut also)\b"
doc_legacy_style.sql = rf"""
with d as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') text from documents),
e as (select *, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)) w, {_S} s, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') p,
 len(regexp_extract_all(text[1:30000], '[A-Za-z]')) en, len(regexp_extract_all(text[1:30000], '[\x{{0590}}-\x{{05FF}}]')) he, len(regexp_extract_all(text[1:30000], '[\x{{0600}}-\x{{06FF}}]')) ar, regexp_extract_all(text, '[.,;:!?()—–\-"“”''’،؛؟]') pu from d),
f as (select *, case when he / greatest(en + he + ar, 1) > 0.45 then 'he' when ar / greatest(en + he + ar, 1) > 0.45 then 'ar' else 'en' end language, list_transform(s, lambda x: regexp_extract_all(x, '{TOKEN}')) k, list_transform(p, lambda x: len(regexp_extract_all(x, '{TOKEN}'))) pl from e),
g as (select *, list_filter(list_transform(k, lambda x: len(x)), lambda n: n > 0) lens, list_filter(list_transform(k, lambda x: lower(array_to_string(x[1:3], ' '))), lambda x: x <> '') st, list_transform(k, lambda x: list_distinct(list_filter(list_transform(x, lambda y: lower(y)), lambda y: length(y) > 3))) sets from f),
fr as (select doc_id, w x, count(*) n from (select doc_id, unnest(w) w from g) group by doc_id, w),
fa as (select doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) ent, count(*) filter (n = 1) / count(*) hapax from fr group by doc_id),
aj as (select doc_id, avg(i / u) adj from (select doc_id, len(list_intersect(sets[i], sets[i + 1])) i, len(list_distinct(list_concat(sets[i], sets[i + 1]))) u from (select doc_id, sets, unnest(range(1, len(sets))) i from g)) where u > 0 group by doc_id),
h as (select g.*, coalesce(ent, 0.0) entropy, coalesce(hapax, 0.0) hapax, coalesce(adj, 0.0) adjacency, len(w) words, len(s) ns, len(lens) n1, coalesce(list_sum(lens), 0) s1, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) q1, len(pl) n2, coalesce(list_sum(pl), 0) s2, coalesce(list_sum(list_transform(pl, lambda x: x * x)), 0) q2 from g left join fa using (doc_id) left join aj using (doc_id)),
i as (select *, case when s1 > 0 then sqrt(cast(n1 * q1 - s1 * s1 as double)) / s1 else 0.0 end scv, case when s2 > 0 then sqrt(cast(n2 * q2 - s2 * s2 as double)) / s2 else 0.0 end pcv, case when words > 0 then len(list_distinct(w)) / words else 0.0 end ttr, {_repeat_sql(3).replace("round(", "(").replace(", 6)", ")")}, {_repeat_sql(4).replace("round(", "(").replace(", 6)", ")")},
 case when len(st) > 0 then 1 - len(list_distinct(st)) / len(st) else 0.0 end starters, case when len(pu) > 0 then len(list_distinct(pu)) / least(len(pu), 14) else 0.0 end pd,
 case when words > 0 then case when language = 'en' then len(regexp_extract_all(text, '{_FORMULA}')) when language = 'he' then len(regexp_extract_all(text, '{verdicts.FORMULAS["he"]}')) else len(regexp_extract_all(text, '{verdicts.FORMULAS["ar"]}')) end / words else 0.0 end formulas,
 case when words > 0 then len(regexp_extract_all(text, '(?i)\b[0-9A-Za-z_]+[''’](?:t|s|re|ve|ll|d|m)\b')) / words else 0.0 end contractions, case when ns > 0 then len(regexp_extract_all(text, '[?؟]')) / ns else 0.0 end qu, case when ns > 0 then len(regexp_extract_all(text, '!')) / ns else 0.0 end ex, case when ns > 0 then len(regexp_extract_all(text, ':')) / ns else 0.0 end colons, len(regexp_extract_all(text, '["“”]')) quo, {_residue_sql(T.LEGACY_RESIDUE)} residue from h),
j as (select *, (case when words >= 120 and scv < 0.31 then 48 when words >= 120 and scv < 0.40 then 30 else 0 end) + (case when len(p) >= 4 and pcv > 0 and pcv < 0.24 then 28 else 0 end) + (case when starters > 0.28 and ns >= 8 then 22 else 0 end) rhythm,
 least(100, (case when words >= 180 and ttr < 0.39 then 28 else 0 end) + (case when words >= 180 and hapax < 0.48 then 18 else 0 end) + (case when words >= 180 and entropy < 6.25 then 18 else 0 end) + (case when repeat4 > 0.018 then 22 else 0 end) + (case when repeat3 > 0.035 then 14 else 0 end)) lexical,
 (case when words >= 120 and formulas > 0.012 then 42 when words >= 120 and formulas > 0.006 then 24 else 0 end) + (case when adjacency > 0.16 and ns >= 8 then 26 else 0 end) + (case when qu < 0.01 and ex < 0.01 and words > 250 then 10 else 0 end) + (case when colons > 0.22 and ns >= 8 then 10 else 0 end) discourse,
 (case when words >= 180 and pd < 0.26 then 36 else 0 end) + (case when language = 'en' and words >= 180 and contractions < 0.0015 then 22 else 0 end) + (case when quo = 0 and words > 500 then 8 else 0 end) surface, (case when repeat4 > 0.025 then 25 else 0 end) + (case when scv < 0.34 and adjacency > 0.13 then 24 else 0 end) predictability from i),
k2 as (select *, round(least(100.0, (rhythm + lexical + discourse + surface + predictability) / 5 + case when residue > 0 then 22 else 0 end), 1) regularity from j)
select doc_id, language, cast(words as bigint) words, round(hapax, 6) hapax, round(adjacency, 6) adjacency, round(formulas, 6) formulas, round(contractions, 6) contractions, round(colons, 6) colons, cast(rhythm as bigint) rhythm, cast(lexical as bigint) lexical, cast(discourse as bigint) discourse, cast(surface as bigint) surface, cast(predictability as bigint) predictability,
 regularity, case when regularity >= 68 then 'strong' when regularity >= 45 then 'moderate' else 'weak' end band from k2
"""


def doc_legacy_verdict(spark, sf_dir):
    """Ensemble and consensus with votes of outside detectors given as a table."""
    d = verdicts.style_features(_docs(spark, sf_dir), compression=False).withColumns({"evasion": T.manipulation(F.col("text"))["evasion_count"], "generators": F.size(T.tool_names(F.col("text"))), "process_reviews": F.lit(0)})
    votes = {"ai": (F.col("doc_id") % 5 == 0).cast("int"), "mixed": (F.col("doc_id") % 7 == 0).cast("int"), "human": (F.col("doc_id") % 11 == 0).cast("int"), "verified": F.col("doc_id") % 13 == 0}
    return verdicts.consensus(verdicts.local_ensemble(d).withColumns(votes)).select("doc_id", "ensemble", "ensemble_verdict", "ensemble_confidence", "consensus")


doc_legacy_verdict.sql = rf"""
with s as ({doc_legacy_style.sql}),
m as (select doc_id, len(regexp_extract_all(text, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{00AD}}]')) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[\x{{0400}}-\x{{04FF}}\x{{0370}}-\x{{03FF}}]'))) ev,
 {_residue_sql(T.LEGACY_RESIDUE)} residue, len(list_filter([{", ".join(repr(x) for x in T.TOOL_NAMES)}], lambda x: contains(lower(text), x))) gen from documents),
e as (select s.*, ev, residue, gen, (rhythm + lexical + discourse + surface + predictability) / 5 pm, (case when rhythm >= 55 then 1 else 0 end) + (case when lexical >= 55 then 1 else 0 end) + (case when discourse >= 55 then 1 else 0 end) + (case when surface >= 55 then 1 else 0 end) + (case when predictability >= 55 then 1 else 0 end) strong from s join m using (doc_id)),
f as (select *, round(least(100.0, pm + (case when strong >= 3 then 12 else 0 end) + (case when residue > 0 then 25 else 0 end) + least(12, ev) + (case when gen > 0 then 20 else 0 end)), 1) ensemble, case when doc_id % 5 = 0 then 1 else 0 end a, case when doc_id % 7 = 0 then 1 else 0 end x, case when doc_id % 11 = 0 then 1 else 0 end h, doc_id % 13 = 0 v from e),
g as (select *, case when residue > 0 then 'AI_RESIDUE' when ensemble >= 72 then 'STRONG_LOCAL_AI_SIGNAL' when ensemble >= 54 then 'MODERATE_LOCAL_AI_SIGNAL' when ensemble >= 38 then 'WEAK_LOCAL_AI_SIGNAL' else 'NO_STRONG_LOCAL_AI_SIGNAL' end ensemble_verdict from f)
select doc_id, ensemble, ensemble_verdict, case when words >= 650 and strong >= 3 then 'medium-high' when words >= 280 and strong >= 2 then 'medium' when words >= 140 then 'low-medium' else 'low' end ensemble_confidence,
 case when v then 'VERIFIED_AI_PROVENANCE' when a + x >= 2 and h = 0 then case when x > 0 then 'AI_OR_AI_ASSISTED' else 'HIGH_AI_SIGNAL' end when a + x >= 1 and ensemble >= 72 and h = 0 then 'HIGH_AI_SIGNAL' when a + x >= 1 and h >= 1 then 'INCONCLUSIVE' when a + x = 1 then case when x > 0 then 'AI_ASSISTED_SIGNAL' else 'AI_SIGNAL' end
 when ensemble_verdict = 'AI_RESIDUE' then 'AI_RESIDUE_FOUND' when ensemble >= 72 then 'STRONG_LOCAL_AI_SIGNAL' when ensemble >= 54 then 'MODERATE_LOCAL_AI_SIGNAL' when h >= 2 then 'NO_AI_SIGNAL_FROM_ENSEMBLE' else 'INCONCLUSIVE' end consensus from g
"""


def doc_final_decision(spark, sf_dir):
    """The later ladder, its band, and whether a document's windows differ."""
    d = M.with_panels(M.measured(_docs(spark, sf_dir), compression=False)).withColumns({"process": (F.col("doc_id") * 13 % 100).cast("int"), "generators": (F.col("doc_id") % 40 == 0).cast("int"), "verified": F.col("doc_id") % 90 == 7})
    out = verdicts.final_decision(d).select("doc_id", "verdict", "confidence", verdicts.display_band(F.col("local_score")).alias("band"))
    windows = evidence.greedy_windows(_docs(spark, sf_dir)).select("doc_id", F.col("words").cast("double").alias("score"))
    return out.join(evidence.change_points(windows).select("doc_id", "mixed"), "doc_id", "left")


doc_final_decision.sql = rf"""
with p as (select *, cast(doc_id * 13 % 100 as integer) pr, doc_id % 40 = 0 gen, doc_id % 90 = 7 ver from ({doc_panel_metrics.sql})),
w as (select doc_id, case when count(*) >= 3 and max(words) - min(words) >= 32 then 'review' else 'none' end mixed from ({doc_greedy_windows.sql}) group by doc_id)
select doc_id, case when ver then 'VERIFIED_AI_PROVENANCE' when gen then 'AI_TOOL_METADATA_FOUND' when residue > 0 then 'AI_RESIDUE_FOUND' when pr >= 80 and predictability >= 55 and repeat3 >= 0.04 then 'STRONG_GENERATIVE_ASSEMBLY_SIGNAL' when local_score >= 70 and pr >= 45 then 'STRONG_AI_AUTHORSHIP_SIGNAL' when local_score >= 68 then 'STRONG_AI_STYLE_SIGNAL' when local_score >= 48 or pr >= 60 then 'AI_OR_ASSEMBLY_SIGNAL' else 'INCONCLUSIVE' end verdict,
 case when ver then 'verified' when gen then 'high' when residue > 0 then case when local_score >= 55 then 'high' else 'medium-high' end when pr >= 80 and predictability >= 55 and repeat3 >= 0.04 then 'medium-high' when local_score >= 70 and pr >= 45 then 'medium-high' when local_score >= 68 then 'medium' when local_score >= 48 or pr >= 60 then 'low-medium' else 'low' end confidence,
 case when local_score >= 75 then 'high' when local_score >= 55 then 'medium' when local_score >= 35 then 'low' else 'minimal' end band, mixed from p left join w using (doc_id)
"""


def image_boosts(spark, sf_dir):
    """Origin scores after container markers and perceptual matches."""
    rows = [("a", 50, ["x"], False, "none", 0.1, 0.1, 0.0), ("b", 50, [], False, "ai", 0.95, 0.5, 0.1), ("c", 80, [], False, "human", 0.2, 0.97, -0.5), ("d", 50, [], True, "ai", 0.95, 0.5, 0.1)]
    return verdicts.boosted(spark.createDataFrame(rows, "asset_id string, score int, markers array<string>, matched boolean, class string, best_ai double, best_human double, margin double")).select("asset_id", "score")


image_boosts.sql = """
with v(asset_id, score, markers, matched, class, ai, human, margin) as (values ('a', 50, 1, false, 'none', 0.1::double, 0.1::double, 0.0::double), ('b', 50, 0, false, 'ai', 0.95, 0.5, 0.1), ('c', 80, 0, false, 'human', 0.2, 0.97, -0.5), ('d', 50, 0, true, 'ai', 0.95, 0.5, 0.1)),
m as (select *, case when markers > 0 then greatest(98.0::double, score) else score::double end k from v)
select asset_id, case when not matched and class = 'ai' and ai >= 0.9 then greatest(k, least(98.0::double, floor(82 + (least(1.0, ai) - 0.9) * 140 + greatest(0.0, margin - 0.045) * 120 + 0.5)))
 when not matched and class = 'human' and human >= 0.9 then least(k, greatest(1.0::double, floor((1 - human) * 100 + 6 + 0.5))) else k end score from m
"""


def image_credible_regions(spark, sf_dir):
    """Regions that enough channels support."""
    sig = lambda *xs: [{"signal": s, "strength": v} for s, v in xs]
    rows = [("a", 70, 50, 0, False, 80, sig(("noise", 2.1), ("cfa", 1.5))), ("b", 50, 50, 0, False, 80, sig(("noise", 2.1), ("cfa", 2.5), ("grid", 1.4))), ("c", 50, 50, 0, False, 80, sig(("noise", 1.4), ("edge", 9.0))), ("d", 30, 10, 1, False, 20, []), ("e", 99, 99, 0, True, 90, [])]
    return verdicts.credible_regions(spark.createDataFrame(rows, "asset_id string, score int, agreement int, generators int, verified boolean, region_score int, dominant array<struct<signal:string,strength:double>>")).select("asset_id", "shown", "votes")


image_credible_regions.sql = """
with v(asset_id, score, agreement, generators, verified, region, v135, v2) as (values ('a', 70, 50, 0, false, 80, 2, 1), ('b', 50, 50, 0, false, 80, 3, 2), ('c', 50, 50, 0, false, 80, 1, 0), ('d', 30, 10, 1, false, 20, 0, 0), ('e', 99, 99, 0, true, 90, 0, 0)),
w as (select *, generators > 0 or score >= 95 direct from v)
select asset_id, cast(case when direct then region else least(region, least(92, floor(score + 18 + agreement * 0.16 + 0.5))) end as bigint) shown, cast(v135 as integer) votes from w
where not verified and (direct or (score >= 45 and agreement >= 35 and v135 >= case when score >= 65 then 2 else 3 end and region >= case when score >= 65 then 65 else 75 end and (score >= 55 or v2 >= 2)))
"""


def document_chain(spark, sf_dir):
    """The chain of stages of a file."""
    rows = [("a", True, 75, 50, 3, 2, 66, 80, "strong_assembly_signal"), ("b", False, 10, 5, 1, 0, None, None, None)]
    return verdicts.document_stages(spark.createDataFrame(rows, "asset_id string, matched boolean, anomaly int, coverage int, sessions int, tracked int, document_signal int, process int, process_status string"))


document_chain.sql = """
with v(asset_id, matched, anomaly, coverage, sessions, tracked, signal, process, status) as (values ('a', true, 75, 50, 3, 2, 66, 80, 'strong_assembly_signal'), ('b', false, 10, 5, 1, 0, null, null, null)),
s as (select asset_id, 0 o, 'known_identity' id, 'verified' status, 100.0 score from v where matched
 union all select asset_id, 1, 'package', case when anomaly >= 70 then 'strong_assembly' when anomaly >= 35 then 'review' else 'ordinary' end, anomaly from v
 union all select asset_id, 2, 'editing_sessions', case when coverage >= 35 then 'retained' else 'sparse' end, least(100, coverage * 0.55 + case when sessions > 1 then 25 else 5 end + case when tracked > 0 then 20 else 0 end) from v
 union all select asset_id, 3, 'authorship_regions', case when signal is not null then 'mapped' else 'unavailable' end, coalesce(signal, 0) from v
 union all select asset_id, 4, 'assembly', coalesce(status, 'observed'), coalesce(process, 0) from v)
select asset_id, cast(row_number() over (partition by asset_id order by o) - 1 as integer) "position", id, status, cast(floor(score + 0.5) as bigint) score from s
"""


def tool_adapters(spark, sf_dir):
    """Outside tools, absent here, as rows that say so."""
    f = X.containers(spark)
    out = None
    for tool in adapters.TOOLS:
        rows = adapters.output(f, tool).withColumn("tool", F.lit(tool))
        out = rows if out is None else out.union(rows)
    return out.select("tool", "asset_id", "available", "ok", adapters.needs_ocr(F.col("output")).alias("needs_ocr"))


def flat_metadata(spark, sf_dir):
    """Nested metadata as dotted names."""
    d = spark.createDataFrame([("a", '{"exif": {"Make": {"description": "Canon", "value": 1}, "n": 2}, "list": [1]}'), ("b", "no json"), ("c", None)], "asset_id string, meta string")
    return adapters.flattened(d).select("asset_id", F.to_json("fields").alias("fields"))


def sample_positions(spark, sf_dir):
    """Where a video's frames are taken."""
    return spark.createDataFrame([("a", 100.0), ("b", 0.0)], "asset_id string, duration double").select("asset_id", media.sample_points(F.col("duration")).alias("points"))


sample_positions.sql = "select * from (values ('a', [8.0::double, 28, 50, 72, 92]), ('b', [0.0::double, 1, 2])) v(asset_id, points)"


def graph_kinds(spark, sf_dir):
    """Which chain of stages a file has, by its name."""
    d = spark.createDataFrame([(x,) for x in ("a.JPG", "b.png", "c.docx", "d.pdf", "e", "f.tiff", "g.docm")], "name string")
    return d.select("name", D.graph_kind(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("kind"))


graph_kinds.sql = "select * from (values ('a.JPG', 'image'), ('b.png', 'image'), ('c.docx', 'document'), ('d.pdf', 'generic'), ('e', 'generic'), ('f.tiff', 'image'), ('g.docm', 'document')) v(name, kind)"


def page_display(spark, sf_dir):
    """a page's escaped length and its size in words."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.length(D.html_escaped(F.col("html"))).cast("long").alias("escaped_chars"), D.byte_size(F.octet_length("html") * 300).alias("size"))


page_display.sql = """
with p as (select page_id, html, strlen(html) * 300 n from pages)
select page_id, cast(length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) as bigint) escaped_chars,
 case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) || ' KB' else printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) || ' MB' end size from p
"""


def doc_regions_summary(spark, sf_dir):
    """How many regions a document has, their mean score and how many are high."""
    w = evidence.greedy_windows(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.collect_list((F.col("words") % 101).cast("double")).alias("scores"))
    return w.select("doc_id", D.regions_summary(F.col("scores")).alias("r")).select("doc_id", "r.*")


doc_regions_summary.sql = f"select doc_id, count(*) regions, cast(floor(sum(words % 101) / count(*) + 0.5) as bigint) mean, count(*) filter (words % 101 >= 60) high from ({doc_greedy_windows.sql}) group by doc_id"


def tool_coverage(spark, sf_dir):
    """Share of five tools that had something to look at."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.coverage(k % 2 == 0, k % 3 == 0, F.when(k % 5 > 0, k % 5 == 1), k % 7 == 0, k % 11 < 6).alias("coverage"))


tool_coverage.sql = "select o_orderkey, cast(floor(((o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 1)::int + (o_orderkey % 7 = 0)::int + (o_orderkey % 11 < 6)::int) / 5 * 100 + 0.5) as bigint) coverage from orders"

_CHECKS = {0: ("hash", "metadata"), 1: ("metadata", "text"), 2: ("text", "hash", "provenance"), 3: ("pixels",)}


def check_plans(spark, sf_dir):
    """Checks of several kinds of material as one plan, each where it comes first, and what it can reach."""
    k = F.col("c_custkey")
    lists = [F.when((k / 2**i).cast("long") % 2 == 1, F.array(*map(F.lit, x))).otherwise(F.array().cast("array<string>")) for i, x in _CHECKS.items()]
    p = table(spark, sf_dir, "customer").select("c_custkey", D.plan(F.array(*lists)).alias("plan"))
    return p.select("c_custkey", F.array_join("plan", ",").alias("plan"), D.plan_confidence(F.col("plan")).alias("confidence"))


check_plans.sql = f"""
with a as (select c_custkey, list_concat({", ".join(f"case when (c_custkey // {2 ** i}) % 2 = 1 then {list(x)!r} else []::varchar[] end" for i, x in _CHECKS.items())}) l from customer),
b as (select c_custkey, list_filter(l, lambda x, i: list_position(l, x) = i) p from a)
select c_custkey, array_to_string(p, ',') plan, cast(case when len(p) > 0 then least(92, 34 + 7 * len(p)) else 0 end as bigint) confidence from b
"""


def ranked_signals(spark, sf_dir):
    """Signals of 55 or more, the six strongest of each asset."""
    l = table(spark, sf_dir, "lineitem")
    s = l.select(F.col("l_suppkey").alias("asset_id"), F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 2).cast("double").alias("score"))
    return fusion.ranked_signals(s).withColumn("rank", F.col("rank").cast("int"))


ranked_signals.sql = """
with s as (select l_suppkey asset_id, l_orderkey || '-' || l_linenumber id, cast(l_quantity * 2 as double) score from lineitem)
select asset_id, id, score, cast(r as integer) "rank" from (select *, row_number() over (partition by asset_id order by score desc, id) r from s where score >= 55) where r <= 6
"""


def provider_votes(spark, sf_dir):
    """Votes of outside detectors, given as a table, by verdict."""
    verdict = F.element_at(F.create_map(*map(F.lit, ("click", "ai", "view", "AI", "purchase", "Mixed", "signup", "human", "error", "failed"))), F.col("event_type"))
    return fusion.provider_votes(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), verdict.alias("verdict")))


provider_votes.sql = "select user_id doc_id, count(*) filter (event_type in ('click', 'view')) ai, count(*) filter (event_type = 'purchase') mixed, count(*) filter (event_type = 'signup') human from events group by 1"


def client_estimates(spark, sf_dir):
    """The estimate that is shown for an image."""
    k = F.col("p_partkey")
    share = lambda n, m: ((k * n) % m / m).cast("double")
    d = table(spark, sf_dir, "part").select(
        "p_partkey", (k % 9 == 0).alias("matched"), F.when(k % 2 == 0, "ai").otherwise("human").alias("label"), F.when(k % 4 > 0, share(7, 101) * 100).alias("fused_score"), F.when(k % 3 > 0, "medium").alias("fused_confidence"),
        F.element_at(F.array(*map(F.lit, ("ai", "human", "none"))), (k % 3 + 1).cast("int")).alias("best_class"), F.when(k % 5 == 0, "ai").when(k % 5 == 1, "human").otherwise("none").alias("pair_class"),
        share(3, 10).alias("best_ai"), share(11, 13).alias("best_human"), share(5, 7).alias("pair_ai"), share(2, 9).alias("pair_human"), (share(3, 8) - 0.5).alias("margin"),
        (share(13, 103) * 100).alias("synthetic"), (share(17, 107) * 100).alias("recompression"), (share(19, 109) * 100).alias("copy_move"), F.when(k % 8 > 0, share(3, 11) * 6).alias("noise"), (share(23, 31) * 40).alias("edge"),
        F.when(k % 16 == 4, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("generators"),
    )
    return fusion.client_estimate(d).select("p_partkey", "estimate", "confidence", "shown")


client_estimates.sql = """
with p as (select p_partkey k, k % 9 = 0 m, k % 2 = 0 ai, case when k % 4 > 0 then ((k * 7) % 101 / 101) * 100 end f, k % 3 c, k % 5 q, (k * 3) % 10 / 10 bai, (k * 11) % 13 / 13 bh, (k * 5) % 7 / 7 pai, (k * 2) % 9 / 9 ph, (k * 3) % 8 / 8 - 0.5 mg,
 ((k * 13) % 103 / 103) * 100 s, ((k * 17) % 107 / 107) * 100 e, ((k * 19) % 109 / 109) * 100 cm, case when k % 8 > 0 then ((k * 3) % 11 / 11) * 6 else 3 end n, ((k * 23) % 31 / 31) * 40 ed, k % 16 = 4 g from part),
r as (select *, c = 0 and (bai >= 0.9 or q = 0) la, c = 1 and (bh >= 0.9 or q = 1) lh, greatest(0, least(100, coalesce(f, 0))) fs from p),
t as (select *, case when g then greatest(94, s) else greatest(1, least(99, floor(s * 0.5 + e * 0.18 + cm * 0.14 + least(100, greatest(0, (3 - n) * 18)) * 0.1 + least(100, greatest(0, ed * 3)) * 0.08 + 0.5))) end pl from r),
u as (select *, case when m then case when ai then 100 else 0 end when f is null then pl when la then greatest(fs, least(98, floor(86 + greatest(floor(bai * 100 + 0.5), floor(pai * 100 + 0.5)) - 90 + greatest(0, mg) * 70 + 0.5)))
 when lh then least(case when fs = 0 then 100 else fs end, greatest(1, floor((1 - greatest(bh, ph)) * 100 + 5 + 0.5))) else fs end x from t)
select k p_partkey, cast(x as double) estimate, case when m then 'verified' when f is null then case when g then 'high' when pl >= 70 then 'medium-high' when pl >= 45 then 'medium' else 'low-medium' end when la or lh then 'high' when k % 3 > 0 then 'medium' else 'unknown' end confidence,
 case when x >= 85 then 'strong' when x >= 65 then 'elevated' when x >= 40 then 'mixed' else 'low' end shown from u
"""

QUERIES = (doc_legacy_style, doc_legacy_verdict, doc_final_decision, image_boosts, image_credible_regions, document_chain, tool_adapters, flat_metadata, sample_positions, graph_kinds, page_display, doc_regions_summary, tool_coverage, check_plans, ranked_signals, provider_votes, client_estimates)
