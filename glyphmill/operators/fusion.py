"""From features to scores: heat maps, regions, signal fusion, media origin, lineage stages, boosts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.metrics import clamped

SCORED = ("high_pass", "edge", "chroma", "chroma_std", "entropy", "std", "grid8", "saturation", "flat_noise", "diag", "orientation", "cfa", "red_green_std", "blue_green_std", "laplacian", "jpeg_phase")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def tile_scores(tiles: DataFrame) -> DataFrame:
    """Score and channels of each tile from robust deviations within its grid."""
    grid = ["asset_id", "columns"]
    t = tiles.where("columns > 1")
    med = t.groupBy(*grid).agg(*(F.median(k).alias(f"m_{k}") for k in SCORED))
    j = t.join(med, grid)
    mad = j.groupBy(*grid).agg(*(F.greatest(F.median(F.abs(F.col(k) - F.col(f"m_{k}"))), F.lit(1e-6)).alias(f"d_{k}") for k in SCORED))
    j = j.join(mad, grid)
    z = {k: (F.col(k) - F.col(f"m_{k}")) / (1.4826 * F.col(f"d_{k}") + 1e-6) for k in SCORED}
    a = {k: F.abs(v) for k, v in z.items()}
    channels = {"noise": a["high_pass"], "edge": a["edge"], "chroma": a["chroma"] + a["chroma_std"] * 0.5, "entropy": a["entropy"], "grid": F.greatest(F.lit(0.0), z["grid8"]), "flat_noise": a["flat_noise"], "orientation": a["orientation"], "edge_noise": F.abs(z["edge"] - z["high_pass"]), "cfa": a["cfa"], "channel_residual": (a["red_green_std"] + a["blue_green_std"]) / 2, "laplacian": a["laplacian"], "jpeg_phase": a["jpeg_phase"]}
    weights = {"noise": 10, "edge": 7, "chroma": 7, "entropy": 5, "grid": 6, "flat_noise": 9, "orientation": 4, "edge_noise": 10, "cfa": 10, "channel_residual": 7, "laplacian": 6, "jpeg_phase": 8}
    score = sum((channels[k] * w for k, w in weights.items()), F.lit(5.0)) + a["diag"] * 4
    return j.select("asset_id", "columns", "gx", "gy", "x0", "y0", "x1", "y1", half_up(clamped(score)).alias("score"), F.map_from_arrays(F.array(*map(F.lit, channels)), F.array(*(F.round(v, 2) for v in channels.values()))).alias("channels"))


def heat_map(scores: DataFrame, sizes: DataFrame, columns: int = 20) -> DataFrame:
    """A row a cell of a common grid: mean score of the tiles, the first of each grid, that hold its middle."""
    rows = F.greatest(F.lit(12), F.round(F.lit(columns) * F.col("height") / F.col("width"))).cast("int")
    cells = sizes.select("asset_id", "width", "height", rows.alias("rows")).withColumn("gy", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    cells = cells.withColumns({"cx": (F.col("gx") + 0.5) / columns * F.col("width"), "cy": (F.col("gy") + 0.5) / F.col("rows") * F.col("height")})
    t = scores.select("asset_id", "columns", F.col("gx").alias("tx"), F.col("gy").alias("ty"), "x0", "y0", "x1", "y1", "score")
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1"))
    first = cells.join(t, "asset_id").where(inside).groupBy("asset_id", "gx", "gy", "rows", "columns").agg(F.min_by("score", F.struct("ty", "tx")).alias("score"))
    return first.groupBy("asset_id", "gx", "gy", "rows").agg(half_up(F.avg("score")).alias("score"))


def thresholds(heat: DataFrame) -> DataFrame:
    med = heat.groupBy("asset_id").agg(F.median("score").alias("m"))
    mad = heat.join(med, "asset_id").groupBy("asset_id").agg(F.first("m").alias("m"), F.greatest(F.median(F.abs(F.col("score") - F.col("m"))), F.lit(1e-6)).alias("d"))
    return mad.select("asset_id", F.greatest(F.lit(54), half_up(F.col("m") + 1.15 * 1.4826 * F.col("d"))).alias("threshold"))


REGIONS = "asset_id string, region int, x int, y int, x2 int, y2 int, cells int, score long, adhesion double"


def _regions(frame: pd.DataFrame) -> pd.DataFrame:
    """Groups of touching cells at or above the threshold, two cells at least; an image's grid is small."""
    score = {(x, y): s for x, y, s in zip(frame["gx"], frame["gy"], frame["score"])}
    least, asset = frame["threshold"].iloc[0], frame["asset_id"].iloc[0]
    open_ = {c for c, s in score.items() if s >= least}
    out = []
    while open_:
        group, edge = set(), [min(open_)]
        open_.discard(edge[0])
        while edge:
            x, y = edge.pop()
            group.add((x, y))
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & open_
            open_ -= near
            edge += near
        if len(group) < 2:
            continue
        xs, ys = [c[0] for c in group], [c[1] for c in group]
        box = (min(xs), min(ys), max(xs), max(ys))
        inner = [s for (x, y), s in score.items() if box[0] <= x <= box[2] and box[1] <= y <= box[3]]
        ring = [s for (x, y), s in score.items() if box[0] - 1 <= x <= box[2] + 1 and box[1] - 1 <= y <= box[3] + 1 and not (box[0] <= x <= box[2] and box[1] <= y <= box[3])]
        adhesion = max(0.0, sum(inner) / len(inner) - sum(ring) / len(ring)) if ring else 0.0
        out.append((asset, *box, len(group), int(sum(score[c] for c in group) / len(group) + 0.5), adhesion))
    out.sort(key=lambda r: (-r[6], r[2], r[1]))
    return pd.DataFrame([(a, k, *r) for k, (a, *r) in enumerate(out[:18])], columns=[c.split()[0] for c in REGIONS.split(", ")])


def regions(heat: DataFrame) -> DataFrame:
    """Connected regions of each image, the 18 strongest."""
    return heat.join(thresholds(heat), "asset_id").groupBy("asset_id").applyInPandas(_regions, REGIONS)


def boundary_adhesion(found: DataFrame) -> DataFrame:
    return found.groupBy("asset_id").agg(half_up(clamped(F.avg("adhesion") * 1.6)).alias("boundary"))


CAMERA = ("make", "model", "lens", "exposure_time", "f_number", "iso", "focal_length", "taken_at")


def camera_score(meta: str = "meta") -> Column:
    """From a map of metadata fields: how much of a camera's trace is there."""
    there = {k: F.coalesce(F.try_element_at(F.col(meta), F.lit(k)) != "", F.lit(False)) for k in CAMERA}
    n = sum((v.cast("int") for v in there.values()), F.lit(0))
    return F.least(F.lit(100), n * 9 + F.when(there["make"] & there["model"], 14).otherwise(0) + F.when(there["exposure_time"] & there["iso"], 10).otherwise(0))


def generative_prior() -> Column:
    """From a whole image's tile statistics."""
    c = F.col
    rules = (((c("high_pass") < 2.1) & (c("edge") > 6), 20), ((c("flat_noise") < 1.4) & (c("edge") > 7), 15), (c("orientation") < 0.06, 6), (c("chroma_std") < 18, 6), ((c("entropy") > 4.5) & (c("entropy") < 4.95), 5), (c("grid8") > c("edge") * 1.22, 7), (c("cfa") < 0.015, 10), ((c("red_green_std") < 12) & (c("blue_green_std") < 12), 7), (c("jpeg_phase") > 0.24, 8), ((c("laplacian_bias") < 0.18) & (c("laplacian") > 3), 5))
    return F.least(F.lit(100), sum((F.when(x, p).otherwise(0) for x, p in rules), F.lit(14)))


def fused(signals: str = "signals", camera: str = "camera", generators: str = "generators") -> dict[str, Column]:
    """score, agreement and confidence of an array of (id, score, weight, kind) signals."""
    own = F.filter(signals, lambda s: s["kind"] != "counter")
    fold = lambda f: F.aggregate(own, F.lit(0.0), lambda t, s: t + f(s))
    mean = fold(lambda s: s["score"] * s["weight"]) / F.nullif(fold(lambda s: s["weight"]), F.lit(0.0))
    named = F.size(generators) > 0
    raw = F.coalesce(mean, F.lit(0.0)) - F.col(camera) * 0.13
    score = half_up(clamped(F.when(named, F.greatest(raw, F.lit(97.0))).otherwise(raw)))
    agreement = half_up(F.size(F.filter(own, lambda s: s["score"] >= 55)) / F.greatest(F.size(own), F.lit(1)) * 100)
    return {"score": score, "agreement": agreement, "confidence": F.when(named, "very high").when(agreement >= 60, "high").when(agreement >= 40, "medium").otherwise("low-medium")}


def image_signals() -> Column:
    """The ten signals of an image from a row of its scores."""
    c = F.col
    sensor = half_up(clamped((1 - F.least(F.lit(1.0), c("cfa") * 18)) * 65 + c("camera") * 0.35))
    spectral = half_up(clamped(c("jpeg_phase") * 170 + F.greatest(F.lit(0.0), 2 - c("high_pass")) * 12))
    rows = (
        ("provenance_generator", F.when(F.size("generators") > 0, 100).otherwise(0), 0.28, "origin"), ("global_generative_prior", generative_prior(), 0.15, "origin"), ("sensor_pattern_consistency", 100 - sensor, 0.10, "origin"),
        ("spectral_lattice_anomaly", spectral, 0.09, "origin"), ("existing_local_forensics", c("synthetic"), 0.10, "origin"), ("regional_inconsistency", c("region_strength"), 0.12, "localization"),
        ("boundary_adhesion", c("boundary"), 0.06, "localization"), ("recompression", c("recompression"), 0.05, "edit"), ("copy_move", c("copy_move"), 0.03, "edit"), ("camera_counterevidence", c("camera"), 0.07, "counter"),
    )
    return F.array(*(F.struct(F.lit(i).alias("id"), s.cast("double").alias("score"), F.lit(w).alias("weight"), F.lit(k).alias("kind")) for i, s, w, k in rows))


def blended(layers: str = "layers", prior: float = 38) -> Column:
    """Layers (score, weight, available) against a prior: more weight moves it further, to 88 % at most; 1..99."""
    on = F.filter(layers, lambda x: x["available"] & (x["weight"] > 0))
    w = F.aggregate(on, F.lit(0.0), lambda s, x: s + x["weight"])
    s = F.aggregate(on, F.lit(0.0), lambda t, x: t + x["score"] * x["weight"]) / F.nullif(w, F.lit(0.0))
    b = F.least(F.lit(0.88), 0.28 + w / 12)
    return F.when(F.size(on) > 0, half_up(clamped(prior * (1 - b) + s * b, 1, 99))).otherwise(half_up(clamped(F.lit(float(prior)), 1, 99)))


def layer(id_: str, score: Column, weight: float, available: Column | None = None) -> Column:
    return F.struct(F.lit(id_).alias("id"), half_up(clamped(score, 1, 99)).alias("score"), F.lit(float(weight)).alias("weight"), F.coalesce(available, F.lit(False)).alias("available") if available is not None else F.lit(True).alias("available"))


def media_layers(kind: str) -> Column:
    """Evidence layers of an image, sound or video from a row of its features; ``meta_text`` is its metadata, lower-cased."""
    c, m = F.col, F.col("meta_text")
    if kind == "image":
        camera = m.rlike("iphone|samsung|pixel|canon|nikon|sony|fujifilm|olympus|panasonic|leica|huawei|xiaomi")
        return F.array(
            layer("generator_metadata", F.when(F.size("generators") > 0, 99).otherwise(18), 3), layer("existing_local_forensics", F.greatest(F.lit(8), c("synthetic")), 2),
            layer("noise_residual", F.when((c("noise") < 1.8) & (c("edge") > 8), 78).when(c("noise") < 3, 58).otherwise(34), 1.2, c("noise").isNotNull()), layer("entropy_texture", F.when(c("entropy") > 7.7, 42).when(c("entropy") < 5.2, 63).otherwise(48), 0.7, c("entropy").isNotNull()),
            layer("jpeg_recompression", F.greatest(F.lit(15), F.coalesce("recompression", F.lit(45))), 0.8, c("recompression").isNotNull()), layer("copy_move", F.when(c("copy_move") >= 70, 68).when(c("copy_move") >= 35, 53).otherwise(35), 0.7, c("copy_move").isNotNull()),
            layer("capture_pipeline", F.when(camera, 18).when(m.rlike("photoshop|lightroom|gimp|affinity"), 41).otherwise(48), 1),
        )
    if kind == "audio":
        n, ok = c("identical_blocks"), c("available")
        return F.array(
            layer("generator_metadata", F.when(m.rlike("openai|elevenlabs|suno|udio|descript|adobe|synthetic|tts|voice clone"), 94).otherwise(35), 2), layer("waveform_repetition", F.when(n > 1, 72).when(n == 1, 55).otherwise(38), 1.2, ok),
            layer("clipping_profile", F.when(c("clipped") == 0, 48).when(c("clipped") < 0.01, 43).otherwise(35), 0.5, ok), layer("dc_profile", F.when(F.abs("dc") < 0.00005, 52).otherwise(39), 0.5, ok),
        )
    if kind == "video":
        n, e = c("noise_range"), c("edge_range")
        return F.array(
            layer("generator_metadata", F.when(m.rlike("openai|sora|veo|runway|pika|luma|kling|synthetic|ai generated"), 96).otherwise(36), 2), layer("temporal_noise_consistency", F.when(n < 0.35, 67).when(n < 1, 53).when(n.isNotNull(), 38).otherwise(45), 1.1, n.isNotNull()),
            layer("temporal_edge_consistency", F.when(e < 0.8, 61).when(e < 2, 50).when(e.isNotNull(), 38).otherwise(45), 0.8, e.isNotNull()), layer("sampling_coverage", F.when(c("frames") >= 5, 50).otherwise(42), 0.3, c("frames") > 0),
        )
    if kind == "pdf":
        text = c("document_signal")
        return F.array(
            layer("document_ai_text", F.coalesce(F.nullif(text, F.lit(0)), F.lit(38)), 1.6, text.isNotNull()), layer("incremental_structure", F.when(c("structure_ok"), 40).otherwise(58), 0.6),
            layer("ocr_only", F.when((c("ocr_pages") > 0) & (c("digital_chars") < 120), 46).otherwise(38), 0.4), layer("receipt_consistency", F.when(c("receipt") & ~c("consistent"), 58).otherwise(42), 0.5, c("receipt")),
        )
    text, images, process = c("document_signal"), c("best_image"), c("process")
    return F.array(layer("document_text", F.coalesce(F.nullif(text, F.lit(0)), F.lit(38)), 2, text.isNotNull()), layer("embedded_media", F.coalesce(images, F.lit(38)), 1, images.isNotNull()), layer("file_process", F.coalesce(F.nullif(process, F.lit(0)), F.lit(38)), 1, process.isNotNull()))


PRIORS = {"image": 42, "audio": 40, "video": 41, "pdf": 39, "office": 40}


def media_origin(rows: DataFrame, kind: str) -> DataFrame:
    """rows with layers, origin score and its confidence."""
    out = rows.withColumn("layers", media_layers(kind)).withColumn("origin", blended("layers", PRIORS[kind]))
    n = F.size(F.filter("layers", lambda x: x["available"]))
    plain = F.when(n >= 5, "medium").when(n >= 3, "low-medium").otherwise("low")
    if kind != "image":
        return out.withColumn("confidence", plain)
    strong = (F.size("generators") > 0) | (F.col("synthetic") >= 65)
    out = out.withColumn("confidence", F.when(strong & (n >= 4), "high").when(strong, "medium-high").otherwise(plain))
    return out.withColumn("label", F.when(F.col("origin") >= 75, "high_ai_likelihood").when(F.col("origin") >= 55, "elevated_ai_likelihood").when(F.col("origin") >= 35, "mixed_evidence").otherwise("low_ai_likelihood"))


def synthetic_score() -> Column:
    """Rules over generators, recompression, copied patches, noise and edges."""
    return F.least(F.lit(100), F.when(F.size("generators") > 0, 65).otherwise(0) + F.when(F.col("recompression") >= 65, 12).otherwise(0) + F.when(F.col("copy_move") >= 70, 10).otherwise(0) + F.when((F.col("noise") < 1.8) & (F.col("edge") > 8), 8).otherwise(0))


def cell_score(channels: str = "channels", score: str = "score") -> Column:
    """A cell's score from its channels alone, where that is more."""
    at = lambda k: F.coalesce(F.try_element_at(F.col(channels), F.lit(k)), F.lit(0.0))
    rules = (("cfa", 18), ("channel_residual", 15), ("flat_noise", 13), ("jpeg_phase", 12), ("edge_noise", 12), ("laplacian", 8), ("noise", 7))
    return F.greatest(sum((F.when(at(k) >= 1.2, p).otherwise(0) for k, p in rules), F.lit(12)), F.col(score))


def recalibrated(cells: DataFrame, origin: DataFrame) -> DataFrame:
    """origin (asset_id, score, camera, generators) with the consensus of absolute cell scores."""
    a = cells.withColumn("absolute", cell_score()).groupBy("asset_id").agg(F.median("absolute").alias("m"), F.avg((F.col("absolute") >= 65).cast("int")).alias("high"))
    j = origin.join(a, "asset_id").withColumn("consensus", half_up(clamped(F.col("m") * 0.72 + F.col("high") * 28)))
    named = F.size("generators") > 0
    base = half_up(clamped(F.col("score") * 0.72 + F.col("consensus") * 0.28 - F.col("camera") * 0.04))
    j = j.withColumn("score", F.when(named, F.greatest(base, F.lit(98))).otherwise(base))
    return j.withColumn("whole_image", named | ((F.col("score") >= 78) & (F.col("m") >= 55) & (F.col("high") >= 0.42)) | (F.col("score") >= 88))


def stages(rows: DataFrame) -> DataFrame:
    """An image's chain of stages: known identity, container, capture, edit, origin; in order, absent ones left out."""
    c = F.col
    stage = lambda i, status, score: F.struct(F.lit(i).alias("id"), status.alias("status"), half_up(clamped(score)).alias("score"))
    named = F.size("generators") > 0
    edit = half_up(c("region_strength") * 0.55 + c("boundary") * 0.25 + c("recompression") * 0.2)
    chain = F.array(
        F.when(c("matched"), stage("known_identity", F.lit("verified"), F.lit(100))),
        stage("container", F.when(named, "strong").otherwise("observed"), F.when(named, 100).otherwise(F.least(F.lit(65), c("container_score") + 20))),
        stage("capture", F.when(c("camera") >= 55, "camera_evidence").when(c("camera") > 0, "partial").otherwise("unknown"), c("camera")),
        stage("edit", F.when(edit >= 65, "strong").when(edit >= 40, "possible").otherwise("weak"), edit),
        stage("origin", F.when(c("score") >= 75, "strong").when(c("score") >= 50, "possible").otherwise("weak"), c("score")),
    )
    return rows.select("asset_id", F.posexplode(F.array_compact(chain)).alias("position", "s")).select("asset_id", "position", "s.*")


def client_estimate(rows: DataFrame) -> DataFrame:
    """rows with estimate and its confidence: what the reader of a page is shown for an image.

    rows: matched, label, fused_score, fused_confidence, best_class (ai, human or
    none), pair_class, best_ai, best_human, pair_ai, pair_human, margin, and for
    images without a fused score synthetic, recompression, copy_move, noise, edge
    and generators.
    """
    c = F.col
    zero = lambda k: F.coalesce(c(k), F.lit(0.0))
    ai = (c("best_class") == "ai") & ((zero("best_ai") >= 0.90) | (c("pair_class") == "ai"))
    human = (c("best_class") == "human") & ((zero("best_human") >= 0.90) | (c("pair_class") == "human"))
    ai, human = F.coalesce(ai, F.lit(False)), F.coalesce(human, F.lit(False))
    fused = clamped(zero("fused_score"))
    near = F.greatest(half_up(zero("best_ai") * 100), half_up(zero("pair_ai") * 100))
    up = F.greatest(fused, F.least(F.lit(98.0), half_up(86 + near - 90 + F.greatest(F.lit(0.0), zero("margin")) * 70).cast("double")))
    original = F.greatest(F.lit(1.0), half_up((1 - F.greatest(zero("best_human"), zero("pair_human"))) * 100 + 5).cast("double"))
    down = F.least(F.when(fused == 0, 100.0).otherwise(fused), original)
    known = F.size("generators") > 0
    noise, edge = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (3 - F.coalesce("noise", F.lit(3.0))) * 18)), F.least(F.lit(100.0), F.greatest(F.lit(0.0), zero("edge") * 3))
    mixed = half_up(zero("synthetic") * 0.50 + zero("recompression") * 0.18 + zero("copy_move") * 0.14 + noise * 0.10 + edge * 0.08).cast("double")
    plain = F.when(known, F.greatest(F.lit(94.0), zero("synthetic"))).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(99.0), mixed)))
    settled = F.coalesce(c("matched"), F.lit(False))
    estimate = F.when(settled & (c("label") == "ai"), 100.0).when(settled & (c("label") == "human"), 0.0).when(c("fused_score").isNull(), plain).when(ai, up).when(human, down).otherwise(fused)
    band = F.when(plain >= 70, "medium-high").when(plain >= 45, "medium").otherwise("low-medium")
    sure = F.when(settled & c("label").isin("ai", "human"), "verified").when(c("fused_score").isNull(), F.when(known, "high").otherwise(band)).when(ai | human, "high").otherwise(F.coalesce("fused_confidence", F.lit("unknown")))
    shown = F.when(c("estimate") >= 85, "strong").when(c("estimate") >= 65, "elevated").when(c("estimate") >= 40, "mixed").otherwise("low")
    return rows.withColumns({"estimate": estimate, "confidence": sure}).withColumn("shown", shown)


def provider_votes(results: DataFrame) -> DataFrame:
    """doc_id and votes by verdict, from results of outside detectors given as a table."""
    v = F.upper("verdict")
    return results.groupBy("doc_id").agg(F.count_if(v == "AI").alias("ai"), F.count_if(v == "MIXED").alias("mixed"), F.count_if(v == "HUMAN").alias("human"))


def ranked_signals(signals: DataFrame, most: int = 6, least: float = 55) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("score"), "id"))
    return signals.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= most)
