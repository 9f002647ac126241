"""Column expressions over text: tokens, sentences, paragraphs, scripts, phrases.

All run inside the JVM.  Patterns avoid ``\\b`` and ``\\w``, whose meaning for
letters outside ASCII differs between engines; word edges are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:['’״׳\-][\p{L}\p{M}\p{N}]+)*"
SENTENCE_END = r"(?<=[.!?׃])[ \t\n\f\r]+(?=[\p{L}\p{N}\"'“‘])"
LEGACY_SENTENCE_END = r"(?<=[.!?؟׃])[ \t\n\f\r]+(?=[\p{L}\p{N}\"'“‘])"
PUNCTUATION = r"[.,;:!?()—–\-\"'“”‘’]"
LEGACY_PUNCTUATION = r"[.,;:!?()—–\-\"“”'’،؛؟]"
NIQQUD = r"[֑-ֽֿׁ-ׂׄ-ׇׅ]"

# Scripts in the order in which ties are settled.
SCRIPTS = (
    ("he", r"\p{IsHebrew}"),
    ("ar", r"\p{IsArabic}"),
    ("ja", r"[\p{IsHiragana}\p{IsKatakana}]"),
    ("zh", r"\p{IsHan}"),
    ("cyrl", r"\p{IsCyrillic}"),
    ("latn", r"\p{IsLatin}"),
)

# Transition phrases counted by language.
DISCOURSE = {
    "he": ["בנוסף", "כמו כן", "לפיכך", "לכן", "עם זאת", "בהתאם", "לסיכום", "חשוב לציין", "מכאן", "יתרה מכך"],
    "ar": ["بالإضافة إلى ذلك", "علاوة على ذلك", "ومع ذلك", "في الختام"],
    "en": ["moreover", "furthermore", "additionally", "therefore", "consequently", "in conclusion", "overall", "it is important to note", "on the other hand"],
}

# Phrases that assistants and prompts leave in a text.
RESIDUE = (
    r"(?i)as an ai language model",
    r"(?i)i hope this helps",
    r"(?i)certainly[!,.]?\s+(?:here|below)",
    r"(?i)here(?:'s| is) (?:a|the) (?:revised|polished|improved) version",
    r"(?im)(?:^|\n)\s*(?:assistant|system|user)\s*:",
    r"כמודל שפה של בינה מלאכותית",
    r"בשמחה[,.!]?\s*(?:הנה|להלן)",
    r"מקווה שזה עוזר",
    r"(?m)(?:^|\n)\s*(?:עוזר|מערכת|משתמש)\s*:",
)
LEGACY_RESIDUE = (
    r"(?i)as an ai language model",
    r"(?i)i (?:cannot|can't) (?:browse|access) the internet",
    r"(?i)(?:^|\n)assistant\s*:",
    r"(?i)(?:^|\n)system\s*:",
    r"(?i)(?:^|\n)user\s*:",
    r"(?i)here(?:'s| is) (?:a|the) (?:revised|polished|improved) version",
    r"(?i)certainly[!,.]? (?:here|below)",
    r"(?i)i hope this helps",
    r"(?i)let me know if you(?:'d| would) like",
    r"(?i)would you like me to",
    r"(?i)i can also (?:help|provide|create|draft)",
)

# Names of generating tools.
TOOL_NAMES = ("openai", "chatgpt", "gpt-4", "gpt-5", "gemini", "claude", "anthropic", "copilot", "midjourney", "stable diffusion", "firefly", "dall-e", "sora", "imagen", "veo", "runway", "canva magic")

ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    return found(text, TOKEN)


def words(text: Column) -> Column:
    return found(text, WORD)


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    """Cut after a mark, before a letter, number or opening quote; trimmed, without empty ones."""
    return _pieces(F.split(F.replace(text, F.lit("\r"), F.lit("")), end))


def simple_sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?。！？]+"), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Cut at empty lines."""
    return _pieces(F.split(text, r"\n\s*\n"))


def script_counts(text: Column) -> Column:
    return F.struct(*(occurrences(text, p).alias(k) for k, p in SCRIPTS))


def script_language(counts: Column) -> Column:
    """The most frequent script, ties in order; any kana means Japanese; none at all "und"."""
    top = F.greatest(*(counts[k] for k, _ in SCRIPTS))
    out = F.when(counts["ja"] > 0, "ja").when(top == 0, "und")
    for k, _ in SCRIPTS:
        out = out.when(counts[k] == top, k)
    return out


def panel_language(text: Column) -> Column:
    he, ar, lat = (occurrences(text, p) for p in (r"[\x{0590}-\x{05FF}]", r"[\x{0600}-\x{06FF}]", r"[A-Za-z]"))
    return F.when((he >= ar) & (he >= lat), "he").when((ar >= he) & (ar >= lat), "ar").otherwise("en")


def phrase_pattern(phrases: list[str], edges: str = r"\p{L}\p{M}\p{N}") -> str:
    return rf"(?iu)(?<![{edges}])(?:{'|'.join(phrases)})(?![{edges}])"


def discourse_count(text: Column, language: Column) -> Column:
    """Transition phrases between Unicode word edges, by language (English for any other)."""
    out = F.lit(None).cast("long")
    branch = None
    for k, phrases in DISCOURSE.items():
        n = occurrences(text, phrase_pattern(phrases))
        branch = F.when(language == k, n) if branch is None else branch.when(language == k, n)
    return F.coalesce(branch.otherwise(occurrences(text, phrase_pattern(DISCOURSE["en"]))), out)


def ascii_discourse_count(text: Column, language: Column) -> Column:
    """The panel's own count: edges of ASCII words only, so that Hebrew phrases never count."""
    edges = "0-9A-Za-z_"
    return F.when(language == "he", F.lit(0).cast("long")).otherwise(occurrences(text, phrase_pattern(DISCOURSE["en"], edges)))


def residue_count(text: Column, patterns: tuple[str, ...] = RESIDUE) -> Column:
    return sum((occurrences(text, p) for p in patterns[1:]), occurrences(text, patterns[0]))


def tool_names(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, TOOL_NAMES)), lambda x: F.contains(low, x))


def manipulation(text: Column) -> Column:
    """Invisible and direction marks, and tokens that mix Latin with Cyrillic or Greek letters."""
    mixed = F.filter(F.split(text, r"\s+"), lambda x: x.rlike("[A-Za-z]") & x.rlike(r"[\x{0400}-\x{04FF}\x{0370}-\x{03FF}]"))
    zero, bidi, nbsp, shy, n = occurrences(text, ZERO_WIDTH), occurrences(text, BIDI), occurrences(text, r"\x{00A0}"), occurrences(text, r"\x{00AD}"), F.size(mixed).cast("long")
    total = zero + bidi + shy + n
    severity = F.when(total > 10, "high").when(total > 0, "review").otherwise("none")
    return F.struct(zero.alias("zero_width"), bidi.alias("bidi_controls"), nbsp.alias("non_breaking_spaces"), shy.alias("soft_hyphens"), n.alias("mixed_script_tokens"), total.alias("evasion_count"), severity.alias("severity"))


def repaired_filename(name: Column) -> Column:
    """A name whose bytes were read as Latin-1 is read anew as UTF-8, if that loses nothing."""
    raw = F.encode(name, "ISO-8859-1")
    suspect = name.rlike(r"[\x{00C2}-\x{00DF}\x{00E0}-\x{00EF}×][\x{0080}-\x{00BF}]") & ~name.rlike(r"[^\x{0000}-\x{00FF}]")
    return F.when(suspect & F.is_valid_utf8(F.decode(raw, "ISO-8859-1")), F.coalesce(F.try_validate_utf8(raw.cast("string")), name)).otherwise(name)


def entities_decoded(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tag_text(xml: Column, name: str) -> Column:
    """Text of the first element of that local name, inner tags left out; null if there is none."""
    inner = F.regexp_extract(xml, rf"(?is)<(?:[A-Za-z0-9_]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[A-Za-z0-9_]+:)?{name}\s*>", 1)
    there = xml.rlike(rf"(?is)<(?:[A-Za-z0-9_]+:)?{name}(?:\s[^>]*)?>.*?</(?:[A-Za-z0-9_]+:)?{name}\s*>")
    return F.when(there, entities_decoded(trimmed(F.regexp_replace(inner, r"<[^>]+>", ""))))
