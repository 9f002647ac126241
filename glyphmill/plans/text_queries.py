"""Queries over documents: the driver's names, the DataFrames and DuckDB's SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.functions import text as T
from glyphmill.operators import context, evidence, records
from glyphmill.operators.process import risk

TOKEN = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[''’״׳\-][\p{L}\p{M}\p{N}]+)*"
TOKENS = rf"regexp_extract_all(text, '{TOKEN}')"
LOWER = f"list_transform({TOKENS}, lambda x: lower(x))"
CUT = r"regexp_replace(replace(text, chr(13), ''), '([.!?׃])[ \t\n\f\r]+([\p{L}\p{N}\"''“‘])', '\1' || chr(1) || '\2', 'g')"
SENTENCES = rf"list_filter(list_transform(string_split({CUT}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sized(docs: DataFrame) -> DataFrame:
    """Enough partitions for functions that cost more than reading does; a small file is one split otherwise."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.rdd.getNumPartitions() < n else docs


def _docs(spark, sf_dir, *columns):
    return sized(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def round6(x):
    return F.round(x, 6)


def doc_text_stats(spark, sf_dir):
    """Length, words, sentences, rhythm of the text with white space collapsed."""
    d = _docs(spark, sf_dir).select("doc_id", T.trimmed(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    d = d.withColumns({"w": F.when(F.col("t") != "", F.split("t", " ")).otherwise(F.array().cast("array<string>")), "s": F.filter(F.split("t", r"(?<=[.!?]) "), lambda x: x != "")})
    d = d.withColumns({"lens": F.transform("s", lambda x: F.size(F.split(x, " ")).cast("long")), "low": F.transform("w", lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}'\-]", ""))})
    n = F.size("w")
    return d.select("doc_id", F.length("t").cast("long").alias("characters"), n.cast("long").alias("words"), F.size("s").cast("long").alias("sentences"), F.when(F.col("t") != "", 1).otherwise(0).cast("long").alias("paragraphs"), round6(F.when(F.size("lens") > 0, M.total(F.col("lens")) / F.size("lens")).otherwise(0.0)).alias("mean_words"), round6(M.variation(F.col("lens"))).alias("burstiness"), round6(F.when(n > 0, F.size(F.array_distinct("low")) / n).otherwise(0.0)).alias("unique_ratio"))


doc_text_stats.sql = r"""
with d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents),
e as (select *, case when t <> '' then string_split(t, ' ') else [] end w, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s from d),
f as (select *, list_transform(s, lambda x: len(string_split(x, ' '))) lens, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}''\-]', '', 'g')) low from e),
g as (select *, coalesce(list_sum(lens), 0) ls, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) lq, len(lens) ln from f)
select doc_id, cast(length(t) as bigint) characters, cast(len(w) as bigint) words, cast(len(s) as bigint) sentences, cast(case when t <> '' then 1 else 0 end as bigint) paragraphs,
 round(case when ln > 0 then ls / ln else 0.0 end, 6) mean_words, round(case when ls > 0 then sqrt(cast(ln * lq - ls * ls as double)) / ls else 0.0 end, 6) burstiness,
 round(case when len(w) > 0 then len(list_distinct(low)) / len(w) else 0.0 end, 6) unique_ratio from g
"""


def doc_token_metrics(spark, sf_dir):
    """Tokens, types, type-token and hapax ratio."""
    d = _docs(spark, sf_dir).select("doc_id", F.transform(T.tokens(F.col("text")), F.lower).alias("w"))
    d = d.withColumn("f", M.frequency(F.col("w")))
    return d.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size("f").cast("long").alias("types"), round6(M.distinct_ratio(F.col("w"))).alias("ttr"), round6(F.when(F.size("f") > 0, F.size(F.filter("f", lambda n: n == 1)) / F.size("f")).otherwise(0.0)).alias("hapax_ratio"))


doc_token_metrics.sql = f"""
with t as (select doc_id, unnest({LOWER}) w from documents), c as (select doc_id, w, count(*) n from t group by all),
a as (select doc_id, sum(n) tokens, count(*) types, count(*) filter (n = 1) hapax from c group by doc_id)
select d.doc_id, cast(coalesce(tokens, 0) as bigint) tokens, coalesce(types, 0) types, round(coalesce(types / tokens, 0.0), 6) ttr, round(coalesce(hapax / types, 0.0), 6) hapax_ratio from documents d left join a using (doc_id)
"""


def doc_entropy(spark, sf_dir):
    """A5: Shannon entropy of tokens."""
    return _docs(spark, sf_dir).select("doc_id", round6(M.entropy(M.frequency(F.transform(T.tokens(F.col("text")), F.lower)))).alias("entropy"))


doc_entropy.sql = f"""
with t as (select doc_id, unnest({LOWER}) w from documents), c as (select doc_id, w, count(*) n from t group by all),
a as (select doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) e from c group by doc_id)
select d.doc_id, round(coalesce(e, 0.0), 6) entropy from documents d left join a using (doc_id)
"""


def doc_sentence_rhythm(spark, sf_dir):
    """Sentences, variation of their lengths, repeated openings."""
    d = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    d = d.withColumn("lens", F.filter(F.transform("s", lambda s: T.occurrences(s, T.TOKEN)), lambda n: n > 0))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), round6(M.variation(F.col("lens"))).alias("sentence_cv"), round6(M.starter_repetition(F.col("s"))).alias("starter_repetition"))


doc_sentence_rhythm.sql = rf"""
with d as (select doc_id, {SENTENCES} s from documents),
e as (select *, list_transform(s, lambda x: regexp_extract_all(x, '{TOKEN}')) k from d),
f as (select *, list_filter(list_transform(k, lambda x: len(x)), lambda n: n > 0) lens, list_filter(list_transform(k, lambda x: lower(array_to_string(x[1:3], ' '))), lambda x: x <> '') st from e),
g as (select *, len(lens) n, coalesce(list_sum(lens), 0) s1, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) s2 from f)
select doc_id, cast(len(s) as bigint) sentences, round(case when s1 > 0 then sqrt(cast(n * s2 - s1 * s1 as double)) / s1 else 0.0 end, 6) sentence_cv,
 round(case when len(st) > 0 then 1 - len(list_distinct(st)) / len(st) else 0.0 end, 6) starter_repetition from g
"""


def doc_ngram_repeat(spark, sf_dir):
    """Share of repeated 3-grams and 4-grams."""
    d = _docs(spark, sf_dir).select("doc_id", F.transform(T.tokens(F.col("text")), F.lower).alias("w"))
    return d.select("doc_id", *(round6(M.repeat_ratio(F.col("w"), n)).alias(f"repeat{n}") for n in (3, 4)))


def _repeat_sql(n):
    return f"round(case when len(w) >= {2 * n} then (len(w) - {n - 1} - len(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))))) / (len(w) - {n - 1}) else 0.0 end, 6) repeat{n}"


doc_ngram_repeat.sql = f"with d as (select doc_id, {LOWER} w from documents) select doc_id, {_repeat_sql(3)}, {_repeat_sql(4)} from d"


def doc_punctuation(spark, sf_dir):
    """Variety of marks, and how often each occurs."""
    t = F.col("text")
    marks = {"dot": r"\.", "comma": ",", "semicolon": ";", "colon": ":", "question": r"\?", "exclamation": "!", "em_dash": "—", "en_dash": "–", "open": r"\(", "close": r"\)", "quote": '"'}
    return _docs(spark, sf_dir).select("doc_id", round6(M.punctuation_diversity(t)).alias("diversity"), *(T.occurrences(t, p).alias(k) for k, p in marks.items()))


_MARKS = {"dot": ".", "comma": ",", "semicolon": ";", "colon": ":", "question": "?", "exclamation": "!", "em_dash": "—", "en_dash": "–", "open": "(", "close": ")", "quote": '"'}
doc_punctuation.sql = rf"""
with d as (select doc_id, text, regexp_extract_all(text, '[.,;:!?()—–\-"''“”‘’]') p from documents)
select doc_id, round(case when len(p) > 0 then len(list_distinct(p)) / least(len(p), 12) else 0.0 end, 6) diversity, {", ".join(f"cast(length(text) - length(replace(text, '{m}', '')) as bigint) {k}" for k, m in _MARKS.items())} from d
"""


def doc_adjacent_jaccard(spark, sf_dir):
    """How much neighbouring sentences share."""
    return _docs(spark, sf_dir).select("doc_id", round6(M.adjacent_overlap(T.sentences(F.col("text")))).alias("overlap"))


doc_adjacent_jaccard.sql = rf"""
with d as (select doc_id, list_transform({SENTENCES}, lambda s: list_distinct(list_filter(list_transform(regexp_extract_all(s, '{TOKEN}'), lambda x: lower(x)), lambda x: length(x) > 3))) s from documents),
e as (select doc_id, s[i] a, s[i + 1] b from (select doc_id, s, unnest(range(1, len(s))) i from d)),
f as (select doc_id, len(list_intersect(a, b)) i, len(list_distinct(list_concat(a, b))) u from e),
g as (select doc_id, avg(i / u) o from f where u > 0 group by doc_id)
select d.doc_id, round(coalesce(o, 0.0), 6) overlap from documents d left join g using (doc_id)
"""


def doc_script_language(spark, sf_dir):
    """Letters by script and the language they suggest."""
    d = _docs(spark, sf_dir, "lang").withColumn("c", T.script_counts(F.col("text")))
    return d.select("doc_id", F.col("c.he").alias("he"), F.col("c.latn").alias("latn"), F.col("c.cyrl").alias("cyrl"), T.script_language(F.col("c")).alias("script"), T.panel_language(F.col("text")).alias("panel_language"))


doc_script_language.sql = r"""
with d as (select doc_id, text, len(regexp_extract_all(text, '\p{Hebrew}')) he, len(regexp_extract_all(text, '\p{Arabic}')) ar, len(regexp_extract_all(text, '[\p{Hiragana}\p{Katakana}]')) ja, len(regexp_extract_all(text, '\p{Han}')) zh, len(regexp_extract_all(text, '\p{Cyrillic}')) cyrl, len(regexp_extract_all(text, '\p{Latin}')) latn,
 len(regexp_extract_all(text, '[\x{0590}-\x{05FF}]')) h, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) a, len(regexp_extract_all(text, '[A-Za-z]')) l from documents),
e as (select *, greatest(he, ar, ja, zh, cyrl, latn) m from d)
select doc_id, he, latn, cyrl, case when ja > 0 then 'ja' when m = 0 then 'und' when he = m then 'he' when ar = m then 'ar' when zh = m then 'zh' when cyrl = m then 'cyrl' else 'latn' end script,
 case when h >= a and h >= l then 'he' when a >= h and a >= l then 'ar' else 'en' end panel_language from e
"""

# Texts that have what the tables lack; the same rows on both engines.
NOTES = (
    (1, "moreover the result. Furthermore, overall it is clear; therefore we go on."),
    (2, "As an AI language model I hope this helps.\nUser: hello\nassistant: here is the revised version"),
    (3, "I used ChatGPT for the draft.\nWe have used an AI tool here."),
    (4, "The study said: I used ChatGPT.\nI never used AI, we used Claude not"),
    (5, "הצהרה על שימוש בכלי בינה מלאכותית\nהשימוש נעשה לצורך הגהה\nשורה"),
    (6, "נעזרתי בכלי בינה מלאכותית לכתיבה"),
    (7, "zero​width ‮bidi‬ soft­hyphen nb sp miхed tоken"),
    (8, "Receipt\nItem 12.50\nItem 7.50\nTotal 20.00 USD\n12/05/2024"),
    (9, "Invoice total 99,90 tax 5.00 amount 50.00 subtotal 1.10"),
    (10, "תוכן עניינים\nמבוא ....... 3\nשיטה 5\nפרק ראשון על הנושא\nטקסט רגיל כאן.\nמקורות\nכהן א. (2001). ספר.\n1. נספח ראשון\nהצהרת מקוריות של הכותב"),
    (11, "one two three four five six seven eight nine\none two three four five six seven eight ten"),
    (12, ""),
    (13, "\U0001f600 בנוסף לכך, moreover שָלוֹם"),
    (14, "Однако привет мир и ещё"),
)


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTES, "doc_id long, text string")


def _chr(text: str) -> str:
    """A SQL string of ASCII pieces and code points, so that no engine's escapes matter."""
    return " || ".join(f"chr({ord(c)})" if ord(c) < 32 or c == "'" or ord(c) > 126 else f"'{c}'" for c in text) or "''"


NOTES_SQL = "documents_and_notes as (select doc_id, text from documents union all select * from (values " + ", ".join(f"(cast(-{i} as bigint), {_chr(t)})" for i, t in NOTES) + ") v(doc_id, text))"


def with_notes(spark, sf_dir):
    return _docs(spark, sf_dir).unionByName(notes(spark).withColumn("doc_id", -F.col("doc_id")))


def doc_discourse(spark, sf_dir):
    """transition phrases by the panel's rule and by Unicode word edges."""
    d = with_notes(spark, sf_dir).withColumns({"l": T.panel_language(F.col("text")), "s": T.script_language(T.script_counts(F.col("text")))})
    return d.select("doc_id", T.ascii_discourse_count(F.col("text"), F.col("l")).alias("panel_markers"), T.discourse_count(F.col("text"), F.col("s")).alias("phrases"))


def _edged(phrases):
    # Every match keeps one character on either side; a second search from the next place on finds neighbours.
    return rf"len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\p{{L}}\p{{M}}\p{{N}}])', '\1\1', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}](?:{'|'.join(p.replace(' ', '  ') for p in phrases)})[^\p{{L}}\p{{M}}\p{{N}}]'))"


doc_discourse.sql = rf"""
with {NOTES_SQL}, d as (select doc_id, text, len(regexp_extract_all(text, '[\x{{0590}}-\x{{05FF}}]')) h, len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]')) a, len(regexp_extract_all(text, '[A-Za-z]')) l,
 len(regexp_extract_all(text, '\p{{Hebrew}}')) he, len(regexp_extract_all(text, '\p{{Arabic}}')) ar, len(regexp_extract_all(text, '\p{{Cyrillic}}')) cy, len(regexp_extract_all(text, '\p{{Latin}}')) la from documents_and_notes)
select doc_id, case when h >= a and h >= l then 0 else len(regexp_extract_all(lower(text), '\b(?:{"|".join(T.DISCOURSE["en"])})\b')) end panel_markers,
 case when he > 0 and he >= ar and he >= cy and he >= la then {_edged(T.DISCOURSE["he"])} when ar > 0 and ar > he and ar >= cy and ar >= la then {_edged(T.DISCOURSE["ar"])} else {_edged(T.DISCOURSE["en"])} end phrases from d
"""


def doc_prompt_residue(spark, sf_dir):
    """Phrases that assistants leave, by both lists, and tool names."""
    t = F.col("text")
    return with_notes(spark, sf_dir).select("doc_id", T.residue_count(t).alias("residue"), T.residue_count(t, T.LEGACY_RESIDUE).alias("legacy_residue"), F.array_join(T.tool_names(t), ",").alias("tools"))


def _residue_sql(patterns):
    return " + ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))" for p in patterns)


doc_prompt_residue.sql = f"with {NOTES_SQL} select doc_id, {_residue_sql(T.RESIDUE)} residue, {_residue_sql(T.LEGACY_RESIDUE)} legacy_residue, array_to_string(list_filter([{', '.join(repr(x) for x in T.TOOL_NAMES)}], lambda x: contains(lower(text), x)), ',') tools from documents_and_notes"


def doc_manipulation(spark, sf_dir):
    """invisible marks and mixed scripts."""
    return with_notes(spark, sf_dir).select("doc_id", T.manipulation(F.col("text")).alias("m")).select("doc_id", "m.*")


doc_manipulation.sql = rf"""
with {NOTES_SQL}, d as (select doc_id, len(regexp_extract_all(text, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]')) z, len(regexp_extract_all(text, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]')) b, len(regexp_extract_all(text, '\x{{00A0}}')) n, len(regexp_extract_all(text, '\x{{00AD}}')) s,
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[\x{{0400}}-\x{{04FF}}\x{{0370}}-\x{{03FF}}]'))) m from documents_and_notes)
select doc_id, z zero_width, b bidi_controls, n non_breaking_spaces, s soft_hyphens, m mixed_script_tokens, z + b + s + m evasion_count, case when z + b + s + m > 10 then 'high' when z + b + s + m > 0 then 'review' else 'none' end severity from d
"""


def doc_paragraph_lines(spark, sf_dir):
    """Lines with their places in code points and UTF-16 units."""
    return evidence.paragraph_rows(with_notes(spark, sf_dir)).select("doc_id", F.col("index").cast("long").alias("index"), "start_cp", "end_cp", "start_utf16", "end_utf16")


doc_paragraph_lines.sql = rf"""
with {NOTES_SQL}, d as (select doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) p from documents_and_notes),
e as (select doc_id, unnest(p) t, generate_subscripts(p, 1) i from d),
f as (select *, length(t) n, length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) u from e),
g as (select *, sum(n + 1) over w - n - 1 s, sum(u + 1) over w - u - 1 su from f window w as (partition by doc_id order by i))
select doc_id, row_number() over (partition by doc_id order by i) - 1 index, cast(s as bigint) start_cp, cast(s + n as bigint) end_cp, cast(su as bigint) start_utf16, cast(su + u as bigint) end_utf16 from g where t <> ''
"""


def doc_segments_200(spark, sf_dir):
    """Segments of 200 words."""
    return evidence.segments(_docs(spark, sf_dir)).select("doc_id", F.col("segment").cast("long").alias("segment"), "words", "first_word", "last_word")


doc_segments_200.sql = f"""
with d as (select doc_id, regexp_extract_all(text, '{WORD}') w from documents), e as (select doc_id, unnest(w) x, generate_subscripts(w, 1) - 1 i from d)
select doc_id, cast(i // 200 as bigint) segment, count(*) words, arg_min(x, i) first_word, arg_max(x, i) last_word from e group by doc_id, i // 200
"""


def doc_academic_context(spark, sf_dir):
    """Excluded lines by rule."""
    return context.exclusion_summary(with_notes(spark, sf_dir))


_HEADING = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\x{0591}-\x{05BD}\x{05BF}\x{05C1}-\x{05C2}\x{05C4}-\x{05C5}\x{05C7}]', '', 'g'), '[\"״׳'']', '', 'g'), '^\s+|\s+$', '', 'g'), '^[0-9]+(?:\.[0-9]+)*[.)]?\s*', ''), '[:.\s]+$', '')"
doc_academic_context.sql = rf"""
with {NOTES_SQL}, a as (select doc_id, string_split(text, chr(10)) p from documents_and_notes),
b as (select doc_id, len(p) n, unnest(p) line, generate_subscripts(p, 1) - 1 pos from a),
c as (select *, regexp_replace(line, '^\s+|\s+$', '', 'g') s from b),
d as (select *, {_HEADING} h from c where s <> ''),
e as (select *, case when regexp_matches(h, '{context.TOC}') then 'toc' when regexp_matches(h, '{context.REFERENCES}') then 'references' when regexp_matches(h, '{context.HEADINGS}') then 'body' end m,
 length(s) < 150 and not regexp_matches(s, '[.!?]$') and len(regexp_split_to_array(s, '\s+')) <= 16 and regexp_matches(s, '{context.SECTION}') sec, length(s) < 260 and regexp_matches(s, '{context.TOC_ENTRY}') ent, length(s) < 650 and regexp_matches(s, '{context.DECLARATION}') dec from d),
f as (select *, count(m) over (partition by doc_id order by pos) seg from e),
g as (select *, max(m) over (partition by doc_id, seg) mode from f),
h as (select *, min(case when m is null and ((mode = 'toc' and not ent) or (mode = 'references' and sec)) then pos end) over (partition by doc_id, seg) brk from g),
i as (select *, case when m is not null then 'academic-heading' when mode = 'toc' and (brk is null or pos < brk) then 'table-of-contents' when mode = 'toc' and pos = brk then case when sec then 'academic-heading' end
 when mode = 'references' and (brk is null or pos < brk) then 'bibliography' when sec then 'academic-heading' when dec then 'declaration' end rule from h),
j as (select doc_id, count(*) l, sum(length(line) + case when pos < n - 1 then 1 else 0 end) c, count(*) filter (rule = 'academic-heading') x1, count(*) filter (rule = 'table-of-contents') x2, count(*) filter (rule = 'bibliography') x3, count(*) filter (rule = 'declaration') x4 from i where rule is not null group by doc_id)
select d.doc_id, coalesce(l, 0) excluded_lines, cast(coalesce(c, 0) as bigint) excluded_characters, coalesce(x1, 0) academic_heading, coalesce(x2, 0) table_of_contents, coalesce(x3, 0) bibliography, coalesce(x4, 0) declaration from documents_and_notes d left join j using (doc_id)
"""


def doc_repeated_phrases(spark, sf_dir):
    """Phrases of eight words that a document repeats."""
    return context.repeated_phrases(with_notes(spark, sf_dir)).select("doc_id", "phrase", "count", F.col("rank").cast("long").alias("rank"))


doc_repeated_phrases.sql = rf"""
with {NOTES_SQL}, a as (select doc_id, regexp_split_to_array(text, '[\r\n]+') p from documents_and_notes),
b as (select doc_id, unnest(p) line, generate_subscripts(p, 1) ln from a),
c as (select doc_id, ln, list_transform(regexp_extract_all(line, '{WORD}'), lambda x: lower(regexp_replace(x, '[\x{{0591}}-\x{{05BD}}\x{{05BF}}\x{{05C1}}-\x{{05C2}}\x{{05C4}}-\x{{05C5}}\x{{05C7}}]', '', 'g'))) w from b),
d as (select doc_id, ln, w, unnest(range(1, len(w) - 6)) i from c where len(w) >= 8),
e as (select doc_id, ln, i, w[i:i + 7] g from d),
f as (select doc_id, ln, i, array_to_string(g, ' ') phrase from e where len(list_distinct(list_filter(g, lambda x: not list_contains({context.FUNCTION_WORDS!r}, x)))) >= 5),
h as (select doc_id, phrase, count(*) "count", min((ln, i)) p from f group by doc_id, phrase having count(*) >= 2)
select doc_id, phrase, "count", r "rank" from (select *, row_number() over (partition by doc_id order by "count" desc, p) r from h) where r <= 8
"""


def doc_disclosures(spark, sf_dir):
    """Statements of use and assistants' phrases with their places."""
    return evidence.findings(with_notes(spark, sf_dir)).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "type", "quote", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_KINDS = [("ai_use_disclosure", evidence.DISCLOSURES[0].replace("(?iu)", "(?i)")), ("ai_use_disclosure", evidence.DISCLOSURES[1].replace("(?iu)", "(?i)")), ("ai_use_disclosure", r"(?i)\b(?:I|we)\s+(?:used|have used)\s+(?:an?\s+)?(?:AI|ChatGPT|Claude|Gemini)\b"), ("ai_use_disclosure", evidence.DISCLOSURES[3]), ("assistant_phrase", evidence.ASSISTANT.replace("(?iu)", "(?i)"))]
doc_disclosures.sql = rf"""
with recursive {NOTES_SQL}, a as (select doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) p from documents_and_notes), b as (select doc_id, unnest(p) t, generate_subscripts(p, 1) i from a),
c as (select *, sum(length(t) + 1) over (partition by doc_id order by i) - length(t) - 1 s0 from b), d as (select doc_id, t, s0, row_number() over (partition by doc_id order by i) - 1 paragraph from c where t <> ''),
e as (select *, regexp_matches(t, '["“”«»]') or regexp_matches(t, '(?i)(?:^|\s)(?:לא|ללא|איני|لم|لن)(?:\s|$)|\b(?:not|never|didn''t|without)\b') or regexp_matches(t, '(?i)מחקר|למשל|לדוגמ[הא]|ציטוט|כדוגמה|אמר|שאלון|\b(?:example|quote|questionnaire|said|study)\b') g, coalesce(bool_or(contains(t, '{evidence.SECTION}')) over (partition by doc_id order by paragraph rows between 3 preceding and 1 preceding), false) below from d),
f as ({" union all ".join(f"select doc_id, paragraph, t, s0, '{k}' type, {n} n, regexp_extract_all(t, '{p}') q from e where {'not g' if k == 'ai_use_disclosure' else 'true'}" for n, (k, p) in enumerate(_KINDS))}),
h as (select doc_id, paragraph, type, s0, n, q, 1 j, t rest, 0 gone from f where len(q) > 0 union all select doc_id, paragraph, type, s0, n, q, j + 1, rest[strpos(rest, q[j]) + length(q[j]):], gone + strpos(rest, q[j]) + length(q[j]) - 1 from h where j < len(q)),
k as (select doc_id, paragraph, type, q[j] quote, s0 + gone + strpos(rest, q[j]) - 1 s from h)
select doc_id, paragraph, type, quote, cast(s as bigint) "start", cast(s + length(quote) as bigint) "end" from k
union all select doc_id, paragraph, 'ai_use_disclosure', t, cast(s0 as bigint), cast(s0 + length(t) as bigint) from e where below and regexp_matches(t, '{evidence.SECTION_YES}') and not regexp_matches(t, '{evidence.SECTION_NO}') and not exists (select 1 from k where k.doc_id = e.doc_id and k.paragraph = e.paragraph and k.type = 'ai_use_disclosure')
"""


def doc_verdict(spark, sf_dir):
    """Status and verdict of every document."""
    return evidence.verdicts(with_notes(spark, sf_dir))


_Q = "chr(39)"
_EN = r"(?i)\b(?:I|we)\s+(?:used|have used)\s+(?:an?\s+)?(?:AI|ChatGPT|Claude|Gemini)\b"
doc_verdict.sql = rf"""
with {NOTES_SQL}, a as (select doc_id, list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: x <> '') p from documents_and_notes),
b as (select doc_id, unnest(p) t, generate_subscripts(p, 1) i from a),
c as (select doc_id, t, i, regexp_matches(t, '["“”«»]') or regexp_matches(t, '(?i)(?:^|\s)(?:לא|ללא|איני|لم|لن)(?:\s|$)|\b(?:not|never|didn''t|without)\b') or regexp_matches(t, '(?i)מחקר|למשל|לדוגמ[הא]|ציטוט|כדוגמה|אמר|שאלון|\b(?:example|quote|questionnaire|said|study)\b') g from b),
d as (select *, case when g then 0 else len(regexp_extract_all(t, '{evidence.DISCLOSURES[0].replace("(?iu)", "(?i)")}')) + len(regexp_extract_all(t, '{evidence.DISCLOSURES[1].replace("(?iu)", "(?i)")}')) + len(regexp_extract_all(t, '{_EN}')) + len(regexp_extract_all(t, '{evidence.DISCLOSURES[3]}')) end n,
 len(regexp_extract_all(t, '{evidence.ASSISTANT.replace("(?iu)", "(?i)")}')) a, bool_or(contains(t, '{evidence.SECTION}')) over (partition by doc_id order by i rows between 3 preceding and 1 preceding) below from c),
e as (select doc_id, n + case when n = 0 and coalesce(below, false) and regexp_matches(t, '{evidence.SECTION_YES}') and not regexp_matches(t, '{evidence.SECTION_NO}') then 1 else 0 end d, a from d),
f as (select doc_id, sum(d) d, sum(a) a from e group by doc_id)
select x.doc_id, cast(coalesce(d + a, 0) as bigint) findings, cast(least(coalesce(d + a, 0), 60) as bigint) displayed, case when coalesce(d, 0) > 0 then 'self_reported' when coalesce(a, 0) > 0 then 'content_signal' else 'not_assessed' end status,
 case when coalesce(d, 0) > 0 then 'AI_USE_DISCLOSED' when coalesce(a, 0) > 0 then 'AI_RESIDUE_FOUND' else 'CLASSIFIER_NOT_CONFIGURED' end verdict from documents_and_notes x left join f using (doc_id)
"""


def doc_panel_metrics(spark, sf_dir):
    """The flagship, F10 without compression: metrics, panels and local score."""
    out = M.with_panels(M.measured(_docs(spark, sf_dir), compression=False))
    return out.select("doc_id", "language", "words", "sentences", "paragraphs", *(round6(F.col(k)).alias(k) for k in ("sentence_cv", "paragraph_cv", "ttr", "entropy", "repeat3", "repeat4", "starters", "punctuation")), "markers", "residue", *M.PANELS, "local_score")


doc_panel_metrics.sql = rf"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') text from documents),
e as (select *, {LOWER} w, {SENTENCES} s, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') p,
 len(regexp_extract_all(text, '[\x{{0590}}-\x{{05FF}}]')) h, len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]')) a, len(regexp_extract_all(text, '[A-Za-z]')) l, regexp_extract_all(text, '[.,;:!?()—–\-"''“”‘’]') pu from d),
f as (select *, case when h >= a and h >= l then 'he' when a >= h and a >= l then 'ar' else 'en' end language, list_filter(list_transform(s, lambda x: len(regexp_extract_all(x, '{TOKEN}'))), lambda n: n > 0) lens, list_transform(p, lambda x: len(regexp_extract_all(x, '{TOKEN}'))) pl,
 list_filter(list_transform(s, lambda x: lower(array_to_string(regexp_extract_all(x, '{TOKEN}')[1:3], ' '))), lambda x: x <> '') st from e),
fr as (select doc_id, w x, count(*) n from (select doc_id, unnest(w) w from f) group by doc_id, w),
en as (select doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) en from fr group by doc_id),
g as (select f.*, len(w) words, len(lens) n1, coalesce(list_sum(lens), 0) s1, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) q1, len(pl) n2, coalesce(list_sum(pl), 0) s2, coalesce(list_sum(list_transform(pl, lambda x: x * x)), 0) q2, coalesce(en, 0.0) entropy from f left join en using (doc_id)),
i as (select *, case when s1 > 0 then sqrt(cast(n1 * q1 - s1 * s1 as double)) / s1 else 0.0 end scv, case when s2 > 0 then sqrt(cast(n2 * q2 - s2 * s2 as double)) / s2 else 0.0 end pcv, case when n1 > 0 then s1 / n1 else 0.0 end av, case when words > 0 then len(list_distinct(w)) / words else 0.0 end ttr,
 {_repeat_sql(3).replace("round(", "(").replace(", 6)", ")")}, {_repeat_sql(4).replace("round(", "(").replace(", 6)", ")")},
 case when len(st) > 0 then 1 - len(list_distinct(st)) / len(st) else 0.0 end starters, case when len(pu) > 0 then len(list_distinct(pu)) / least(len(pu), 12) else 0.0 end punctuation,
 case when language = 'he' then 0 else len(regexp_extract_all(lower(text), '\b(?:{"|".join(T.DISCOURSE["en"])})\b')) end markers, {_residue_sql(T.RESIDUE)} residue, len(regexp_extract_all(text, '[!?]')) ex, len(regexp_extract_all(text, '[()]')) pa from g),
k as (select *, least(100, (case when words > 120 and scv < 0.38 then 35 else 0 end) + (case when words > 180 and pcv > 0 and pcv < 0.32 then 25 else 0 end) + (case when av > 17 and av < 30 then 12 else 0 end) + (case when starters > 0.22 then 18 else 0 end)) rhythm,
 least(100, (case when words > 180 and ttr < 0.44 then 28 else 0 end) + (case when words > 180 and entropy < 7.1 then 18 else 0 end) + (case when repeat4 > 0.012 then 24 else 0 end) + (case when repeat3 > 0.025 then 18 else 0 end)) lexical,
 (case when words > 0 and markers / words > 0.009 then 40 else 0 end) + (case when starters > 0.18 then 25 else 0 end) discourse,
 (case when words > 180 and punctuation < 0.4 then 25 else 0 end) + (case when words > 180 and ex = 0 then 12 else 0 end) + (case when words > 180 and pa / words < 0.003 then 10 else 0 end) surface_style,
 (case when repeat3 > 0.02 then 25 else 0 end) + (case when entropy < 6.8 then 18 else 0 end) + (case when scv < 0.32 then 18 else 0 end) predictability, case when residue > 0 then 100 else 0 end ai_residue from i)
select doc_id, language, cast(words as bigint) words, cast(len(s) as bigint) sentences, cast(len(p) as bigint) paragraphs, round(scv, 6) sentence_cv, round(pcv, 6) paragraph_cv, round(ttr, 6) ttr, round(entropy, 6) entropy, round(repeat3, 6) repeat3, round(repeat4, 6) repeat4, round(starters, 6) starters, round(punctuation, 6) punctuation,
 cast(markers as bigint) markers, cast(residue as bigint) residue, cast(rhythm as bigint) rhythm, cast(lexical as bigint) lexical, cast(discourse as bigint) discourse, cast(surface_style as bigint) surface_style, cast(predictability as bigint) predictability, cast(ai_residue as bigint) ai_residue,
 cast(least(100, floor((22 * rhythm + 18 * lexical + 19 * discourse + 10 * surface_style + 21 * predictability + 10 * ai_residue + 50) / 100)) as bigint) local_score from k
"""


def doc_panels(spark, sf_dir):
    """F10 in full, with the compressed size; no SQL, as the ratio depends on the compressor."""
    return M.with_panels(M.measured(_docs(spark, sf_dir))).select("doc_id", round6(F.col("compression")).alias("compression"), *M.PANELS, "local_score")


def doc_gzip_ratio(spark, sf_dir):
    """F12."""
    return _docs(spark, sf_dir).select("doc_id", F.round(M.gzip_ratio("text"), 4).alias("gzip_ratio"))


def doc_greedy_windows(spark, sf_dir):
    """Sentences in buckets of 160 to 260 words."""
    return evidence.greedy_windows(_docs(spark, sf_dir)).select("doc_id", F.col("window").cast("long").alias("window"), "words", "sentences")


doc_greedy_windows.sql = rf"""
with recursive d as (select doc_id, list_transform({SENTENCES}, lambda s: len(regexp_extract_all(s, '{TOKEN}'))) n from documents),
r as (select doc_id, n, cast(1 as bigint) i, cast(0 as bigint) win, cast(n[1] as bigint) words, cast(1 as bigint) sentences from d where len(n) > 0
 union all select doc_id, n, i + 1, case when words >= 160 and words + n[i + 1] > 260 then win + 1 else win end, case when words >= 160 and words + n[i + 1] > 260 then n[i + 1] else words + n[i + 1] end, case when words >= 160 and words + n[i + 1] > 260 then 1 else sentences + 1 end from r where i < len(n))
select doc_id, win "window", arg_max(words, i) words, arg_max(sentences, i) sentences from r group by doc_id, win
"""


def doc_receipt_signals(spark, sf_dir):
    """Receipt words, amounts, dates and their arithmetic."""
    return records.receipts(with_notes(spark, sf_dir))


doc_receipt_signals.sql = rf"""
with {NOTES_SQL}, a as (select doc_id, text, len(list_filter([{", ".join("'" + w + "'" for w in records.RECEIPT_WORDS)}], lambda x: contains(lower(text), x))) words,
 list_filter(list_transform(regexp_extract_all(text, '{records.AMOUNT}', 1), lambda x: cast(replace(x, ',', '.') as double)), lambda x: x > 0 and x < 1e8) a, len(regexp_extract_all(text, '{records.DATE}')[1:12]) dates, regexp_matches(text, '₪|ILS|USD|EUR') cur from documents_and_notes),
b as (select *, words >= 2 or (cur and len(a) >= 3) likely, list_max(a) top from a),
c as (select *, list_position(a, top) k from b),
d as (select *, list_concat(a[1:k - 1], a[k + 1:]) rest from c),
e as (select doc_id, min(abs(list_sum(rest[i:i + n - 1]) - top)) diff from (select doc_id, rest, top, i, unnest(range(1, 9)) n from (select doc_id, rest, top, unnest(range(1, least(len(rest), 12) + 1)) i from d where likely and len(a) >= 3)) where i + n - 1 <= len(rest) group by doc_id)
select d.doc_id, cast(words as bigint) words, cast(len(a) as bigint) amounts, cast(dates as bigint) dates, likely, round(diff, 2) difference, diff <= greatest(0.05, top * 0.01) consistent from d left join e using (doc_id)
"""


def doc_risk_score(spark, sf_dir):
    """Findings by severity summed to a risk."""
    d = _docs(spark, sf_dir).withColumn("m", T.manipulation(F.col("text")))
    found = F.array_compact(F.array(F.when(F.col("text").rlike("(?i)password|token"), "conflict"), F.when(F.contains("text", F.lit("@")), "review"), F.when(F.col("text").rlike("[0-9]"), "info")))
    return risk(d.select("doc_id", F.explode(found).alias("severity")))


doc_risk_score.sql = """
with f as (select doc_id, unnest(list_filter([case when regexp_matches(text, '(?i)password|token') then 35 end, case when contains(text, '@') then 12 end, case when regexp_matches(text, '[0-9]') then 4 end], lambda x: x is not null)) p from documents),
g as (select doc_id, cast(least(sum(p), 100) as bigint) risk, count(*) findings from f group by doc_id)
select *, case when risk >= 60 then 'CONFLICT' when risk >= 20 then 'REVIEW' else 'LOW SIGNAL' end verdict from g
"""

QUERIES = (
    doc_panel_metrics, doc_text_stats, doc_token_metrics, doc_entropy, doc_sentence_rhythm, doc_ngram_repeat, doc_punctuation, doc_adjacent_jaccard, doc_script_language, doc_discourse, doc_prompt_residue, doc_manipulation,
    doc_paragraph_lines, doc_segments_200, doc_academic_context, doc_repeated_phrases, doc_disclosures, doc_verdict, doc_panels, doc_gzip_ratio, doc_greedy_windows, doc_receipt_signals, doc_risk_score,
)
