"""Older style features and the ladders that turn scores into verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.functions import text as T

# Formulaic expressions of the older count, by language.
FORMULAS = {
    "en": r"(?i)(?<![0-9A-Za-z_])(?:moreover|furthermore|additionally|consequently|in conclusion|in summary|overall|it is important to note|it is worth noting|on the other hand|this highlights|this underscores|in today's (?:rapidly )?(?:evolving|changing)|multifaceted|nuanced|seamless(?:ly)?|robust|leverag(?:e|ing)|transformative|foster(?:ing|s)?|landscape|delve|key considerations|not only(?![0-9A-Za-z_])[^.!?]{0,100}(?<![0-9A-Za-z_])but also)(?![0-9A-Za-z_])",
    "he": "חשוב לציין|ראוי לציין|בנוסף לכך|יתר על כן|מנגד|לסיכום|באופן כללי|בהתאם לכך|במילים אחרות|יש להדגיש|תמונה מורכבת|מגוון רחב|מנקודת מבט|בהקשר זה",
    "ar": "بالإضافة إلى ذلك|علاوة على ذلك|في الختام|من المهم الإشارة|من ناحية أخرى|بشكل عام|في هذا السياق|تجدر الإشارة|بعبارة أخرى",
}
CONTRACTION = r"(?i)(?<![0-9A-Za-z_])[0-9A-Za-z_]+['’](?:t|s|re|ve|ll|d|m)(?![0-9A-Za-z_])"


def share_language(text: Column) -> Column:
    """Hebrew or Arabic from 45 % of the letters of the first 30,000 code points on, else English."""
    t = F.substring(text, 1, 30_000)
    en, he, ar = (T.occurrences(t, p) for p in ("[A-Za-z]", r"[\x{0590}-\x{05FF}]", r"[\x{0600}-\x{06FF}]"))
    n = F.greatest(en + he + ar, F.lit(1))
    return F.when(he / n > 0.45, "he").when(ar / n > 0.45, "ar").otherwise("en")


def style_features(docs: DataFrame, text: str = "text", compression: bool = True) -> DataFrame:
    """docs with the older metrics, five panels, residue and regularity."""
    t = F.col("__t")
    d = docs.withColumn("__t", T.trimmed(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumns({"__w": F.transform(T.tokens(t), F.lower), "__s": T.sentences(t, T.LEGACY_SENTENCE_END), "__p": T.paragraphs(t), "language": share_language(t)})
    d = d.withColumns({"__lens": F.filter(F.transform("__s", lambda s: T.occurrences(s, T.TOKEN)), lambda n: n > 0), "__plens": F.transform("__p", lambda p: T.occurrences(p, T.TOKEN)), "__f": M.frequency(F.col("__w"))})
    n, s = F.size("__w"), F.size("__s")
    formulas = F.when(F.col("language") == "he", T.occurrences(t, FORMULAS["he"])).when(F.col("language") == "ar", T.occurrences(t, FORMULAS["ar"])).otherwise(T.occurrences(t, FORMULAS["en"]))
    per = lambda k, of: F.when(of > 0, k / F.nullif(of, F.lit(0))).otherwise(0.0)
    ratio = F.when(F.octet_length(t) >= 80, M.gzip_ratio(t)) if compression else F.lit(None).cast("double")
    d = d.withColumns(
        {
            "words": n.cast("long"), "sentences": s.cast("long"), "paragraphs": F.size("__p").cast("long"), "sentence_cv": M.variation(F.col("__lens")), "paragraph_cv": M.variation(F.col("__plens")),
            "ttr": M.distinct_ratio(F.col("__w")), "hapax": per(F.size(F.filter("__f", lambda k: k == 1)), F.size("__f")), "entropy": M.entropy(F.col("__f")), "repeat3": M.repeat_ratio(F.col("__w"), 3), "repeat4": M.repeat_ratio(F.col("__w"), 4),
            "starters": M.starter_repetition(F.col("__s")), "punctuation": M.punctuation_diversity(t, T.LEGACY_PUNCTUATION, 14), "adjacency": M.adjacent_overlap(F.col("__s")), "formulas": per(formulas, n), "contractions": per(T.occurrences(t, CONTRACTION), n),
            "questions": per(T.occurrences(t, "[?؟]"), s), "exclaims": per(T.occurrences(t, "!"), s), "colons": per(T.occurrences(t, ":"), s), "quotes": per(T.occurrences(t, '["“”]'), n), "compression": ratio, "residue": T.residue_count(t, T.LEGACY_RESIDUE),
        }
    ).drop("__t", "__w", "__s", "__p", "__lens", "__plens", "__f")
    c, w, some = F.col, F.col("words"), F.col("sentences") >= 8
    long = w >= 180
    panels = {
        "rhythm": M.points(((w >= 120) & (c("sentence_cv") < 0.31), 48), ((w >= 120) & (c("sentence_cv") >= 0.31) & (c("sentence_cv") < 0.40), 30), ((c("paragraphs") >= 4) & (c("paragraph_cv") > 0) & (c("paragraph_cv") < 0.24), 28), ((c("starters") > 0.28) & some, 22)),
        "lexical": M.points((long & (c("ttr") < 0.39), 28), (long & (c("hapax") < 0.48), 18), (long & (c("entropy") < 6.25), 18), (c("repeat4") > 0.018, 22), (c("repeat3") > 0.035, 14)),
        "discourse": M.points(((w >= 120) & (c("formulas") > 0.012), 42), ((w >= 120) & (c("formulas") > 0.006) & (c("formulas") <= 0.012), 24), ((c("adjacency") > 0.16) & some, 26), ((c("questions") < 0.01) & (c("exclaims") < 0.01) & (w > 250), 10), ((c("colons") > 0.22) & some, 10)),
        "surface": M.points((long & (c("punctuation") < 0.26), 36), ((c("language") == "en") & long & (c("contractions") < 0.0015), 22), ((c("quotes") == 0) & (w > 500), 8)),
        "predictability": M.points((long & (c("compression") < 0.48), 30), (c("repeat4") > 0.025, 25), ((c("sentence_cv") < 0.34) & (c("adjacency") > 0.13), 24)),
    }
    d = d.withColumns({k: F.least(F.lit(100), v).cast("long") for k, v in panels.items()})
    mean = sum((F.col(k) for k in panels), F.lit(0)) / 5
    d = d.withColumn("regularity", F.round(F.least(F.lit(100.0), mean + F.when(F.col("residue") > 0, 22).otherwise(0)), 1))
    band = F.when(F.col("regularity") >= 68, "strong").when(F.col("regularity") >= 45, "moderate").otherwise("weak")
    strong = sum(((F.col(k) >= 55).cast("int") for k in panels), F.lit(0))
    return d.withColumns({"band": band, "strong_panels": strong, "panel_mean": mean})


def local_ensemble(styled: DataFrame) -> DataFrame:
    """styled (with evasion, generators, process_reviews) with the ensemble's score, confidence and verdict."""
    c = F.col
    score = c("panel_mean") + F.when(c("strong_panels") >= 3, 12).otherwise(0) + F.when(c("residue") > 0, 25).otherwise(0) + F.least(F.lit(12), c("evasion")) + F.when(c("generators") > 0, 20).otherwise(0) + F.when(c("process_reviews") > 0, 8).otherwise(0)
    d = styled.withColumn("ensemble", F.round(M.clamped(score), 1))
    confidence = F.when((c("words") >= 650) & (c("strong_panels") >= 3), "medium-high").when((c("words") >= 280) & (c("strong_panels") >= 2), "medium").when(c("words") >= 140, "low-medium").otherwise("low")
    verdict = F.when(c("residue") > 0, "AI_RESIDUE").when(c("ensemble") >= 72, "STRONG_LOCAL_AI_SIGNAL").when(c("ensemble") >= 54, "MODERATE_LOCAL_AI_SIGNAL").when(c("ensemble") >= 38, "WEAK_LOCAL_AI_SIGNAL").otherwise("NO_STRONG_LOCAL_AI_SIGNAL")
    return d.withColumns({"ensemble_confidence": confidence, "ensemble_verdict": verdict})


def consensus(rows: DataFrame) -> DataFrame:
    """rows (ensemble, its verdict, votes ai, mixed, human, and verified) with the consensus verdict."""
    c = F.col
    for_ai = c("ai") + c("mixed")
    verdict = (
        F.when(c("verified"), "VERIFIED_AI_PROVENANCE")
        .when((for_ai >= 2) & (c("human") == 0), F.when(c("mixed") > 0, "AI_OR_AI_ASSISTED").otherwise("HIGH_AI_SIGNAL"))
        .when((for_ai >= 1) & (c("ensemble") >= 72) & (c("human") == 0), "HIGH_AI_SIGNAL")
        .when((for_ai >= 1) & (c("human") >= 1), "INCONCLUSIVE")
        .when(for_ai == 1, F.when(c("mixed") > 0, "AI_ASSISTED_SIGNAL").otherwise("AI_SIGNAL"))
        .when(c("ensemble_verdict") == "AI_RESIDUE", "AI_RESIDUE_FOUND")
        .when(c("ensemble") >= 72, "STRONG_LOCAL_AI_SIGNAL")
        .when(c("ensemble") >= 54, "MODERATE_LOCAL_AI_SIGNAL")
        .when(c("human") >= 2, "NO_AI_SIGNAL_FROM_ENSEMBLE")
        .otherwise("INCONCLUSIVE")
    )
    return rows.withColumn("consensus", verdict)


def final_decision(rows: DataFrame) -> DataFrame:
    """rows (local_score, predictability, repeat3, residue, process, generators, verified) with verdict and confidence."""
    c = F.col
    s, p = c("local_score"), c("process")
    ladder = (
        (c("verified"), "VERIFIED_AI_PROVENANCE", F.lit("verified")),
        (c("generators") > 0, "AI_TOOL_METADATA_FOUND", F.lit("high")),
        (c("residue") > 0, "AI_RESIDUE_FOUND", F.when(s >= 55, "high").otherwise("medium-high")),
        ((p >= 80) & (c("predictability") >= 55) & (c("repeat3") >= 0.04), "STRONG_GENERATIVE_ASSEMBLY_SIGNAL", F.lit("medium-high")),
        ((s >= 70) & (p >= 45), "STRONG_AI_AUTHORSHIP_SIGNAL", F.lit("medium-high")),
        (s >= 68, "STRONG_AI_STYLE_SIGNAL", F.lit("medium")),
        ((s >= 48) | (p >= 60), "AI_OR_ASSEMBLY_SIGNAL", F.lit("low-medium")),
    )
    verdict, confidence = F.lit("INCONCLUSIVE"), F.lit("low")
    for rule, name, sure in reversed(ladder):
        verdict, confidence = F.when(rule, name).otherwise(verdict), F.when(rule, sure).otherwise(confidence)
    return rows.withColumns({"verdict": verdict, "confidence": confidence})


def display_band(score: Column, cuts: tuple[int, int, int] = (75, 55, 35)) -> Column:
    high, medium, low = cuts
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("minimal")


def boosted(rows: DataFrame) -> DataFrame:
    """An image's origin score after container markers and perceptual matches (class, best_ai, best_human, margin)."""
    c = F.col
    marked = F.when(F.size("markers") > 0, F.greatest(F.lit(98.0), c("score"))).otherwise(c("score").cast("double"))
    up = F.floor(82 + (F.least(F.lit(1.0), c("best_ai")) - 0.90) * 140 + F.greatest(F.lit(0.0), c("margin") - 0.045) * 120 + 0.5)
    down = F.greatest(F.lit(1.0), F.floor((1 - c("best_human")) * 100 + 6 + 0.5).cast("double"))
    score = F.when(~c("matched") & (c("class") == "ai") & (c("best_ai") >= 0.90), F.greatest(marked, F.least(F.lit(98.0), up.cast("double")))).when(~c("matched") & (c("class") == "human") & (c("best_human") >= 0.90), F.least(marked, down)).otherwise(marked)
    return rows.withColumn("score", score)


def credible_regions(rows: DataFrame) -> DataFrame:
    """Regions that enough core channels support, for images (score, agreement, generators, verified) with regions to show."""
    c = F.col
    core = F.array(*map(F.lit, ("noise", "flat_noise", "cfa", "channel_residual", "jpeg_phase", "edge_noise", "laplacian", "grid")))
    votes = lambda least: F.size(F.filter("dominant", lambda x: F.array_contains(core, x["signal"]) & (x["strength"] >= least)))
    direct = (c("generators") > 0) | (c("score") >= 95)
    open_ = direct | ((c("score") >= 45) & (c("agreement") >= 35))
    enough = (votes(1.35) >= F.when(c("score") >= 65, 2).otherwise(3)) & (c("region_score") >= F.when(c("score") >= 65, 65).otherwise(75)) & ((c("score") >= 55) | (votes(2.0) >= 2))
    ceiling = F.least(F.lit(92), F.floor(c("score") + 18 + c("agreement") * 0.16 + 0.5))
    shown = F.when(direct, c("region_score")).otherwise(F.least(c("region_score"), ceiling))
    return rows.where(~c("verified") & open_ & (direct | enough)).withColumns({"shown": shown, "votes": votes(1.35)})


def document_stages(rows: DataFrame) -> DataFrame:
    """A file's chain of stages: known identity, package, editing sessions, regions, assembly."""
    c = F.col
    stage = lambda i, status, score: F.struct(F.lit(i).alias("id"), status.alias("status"), F.floor(M.clamped(score) + 0.5).cast("long").alias("score"))
    sessions = F.least(F.lit(100.0), c("coverage") * 0.55 + F.when(c("sessions") > 1, 25).otherwise(5) + F.when(c("tracked") > 0, 20).otherwise(0))
    chain = F.array(
        F.when(c("matched"), stage("known_identity", F.lit("verified"), F.lit(100))),
        stage("package", F.when(c("anomaly") >= 70, "strong_assembly").when(c("anomaly") >= 35, "review").otherwise("ordinary"), c("anomaly")),
        stage("editing_sessions", F.when(c("coverage") >= 35, "retained").otherwise("sparse"), sessions),
        stage("authorship_regions", F.when(c("document_signal").isNotNull(), "mapped").otherwise("unavailable"), c("document_signal")),
        stage("assembly", F.coalesce("process_status", F.lit("observed")), c("process")),
    )
    return rows.select("asset_id", F.posexplode(F.array_compact(chain)).alias("position", "s")).select("asset_id", "position", "s.*")
