"""Queries over inline fixtures: office files, media, claims, cohorts.  No table has such inputs, so sf_dir is not read."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import cohort, context, evidence, fusion, process, records
from glyphmill.sources import media, ooxml

from . import fixtures as X


def word_parts(spark, sf_dir):
    """Admission of packages and their parts."""
    return ooxml.parts(X.assets(spark)).select("asset_id", "status", "name", "bytes", "dos_epoch", F.col("xml").isNotNull().alias("readable"))



def word_paragraphs(spark, sf_dir):
    """Paragraphs without deleted and hidden runs."""
    return ooxml.paragraphs(ooxml.parts(X.assets(spark)))


def word_text(spark, sf_dir):
    """A file's text with its parts in order, and by the simple reader."""
    parts = ooxml.parts(X.assets(spark))
    return ooxml.documents(ooxml.paragraphs(parts)).join(ooxml.office_text(parts).withColumnRenamed("text", "plain"), "asset_id")


def word_structure(spark, sf_dir):
    """Properties, revisions, sessions, external targets."""
    parts = ooxml.parts(X.assets(spark))
    return ooxml.structure(parts).join(ooxml.properties(parts), "asset_id")


def word_revisions(spark, sf_dir):
    """Tracked changes."""
    return ooxml.revisions(ooxml.parts(X.assets(spark)))


def word_process(spark, sf_dir):
    """Process score of each file."""
    parts = ooxml.parts(X.assets(spark))
    return process.process_scores(ooxml.structure(parts), ooxml.properties(parts))


def word_lineage(spark, sf_dir):
    """Lineage anomaly."""
    parts = ooxml.parts(X.assets(spark))
    return process.lineage(parts, ooxml.structure(parts), ooxml.properties(parts))


def word_run_candidates(spark, sf_dir):
    """Runs that look edited, merged."""
    runs = ooxml.runs(ooxml.parts(X.assets(spark)))
    return process.merged_candidates(process.run_candidates(runs)).join(process.session_coverage(runs), "asset_id")


def _origin(spark):
    parts = ooxml.parts(X.assets(spark))
    paragraphs = ooxml.paragraphs(parts)
    return process.origin_map(paragraphs, ooxml.documents(paragraphs), process.process_scores(ooxml.structure(parts), ooxml.properties(parts)), process.run_candidates(ooxml.runs(parts)))


def word_origin_map(spark, sf_dir):
    """Origin score of each paragraph."""
    return _origin(spark)


def word_origin_summary(spark, sf_dir):
    """A file's paragraphs by label and its document signal."""
    return process.origin_summary(_origin(spark))


def word_verdict(spark, sf_dir):
    """a file's verdict after its process is known, one of the files with a trusted claim."""
    parts = ooxml.parts(X.assets(spark))
    texts = ooxml.documents(ooxml.paragraphs(parts))
    v = evidence.verdicts(texts, "asset_id").join(process.process_scores(ooxml.structure(parts), ooxml.properties(parts)).select("asset_id", F.col("status").alias("process_status")), "asset_id")
    return evidence.with_source_claim(evidence.with_process_verdict(v).withColumns({"trusted": F.col("asset_id") == "linked", "ai_declared": F.col("asset_id") != "made"}))


def file_identity(spark, sf_dir):
    """Kind, hash, entropy and first bytes of files."""
    return media.identity(X.containers(spark)).drop("content")


def image_containers(spark, sf_dir):
    """Segments, chunks and container score."""
    return media.container_scores(X.containers(spark))


def mail_headers(spark, sf_dir):
    """Headers and body of mail."""
    return media.mail(X.mail(spark)).select("asset_id", F.to_json("headers").alias("headers"), "body")


def signed_claims(spark, sf_dir):
    """What a manifest store says and whether to trust it."""
    return media.claims(X.stores(spark)).drop("store")


def image_gray_features(spark, sf_dir):
    """Statistics, copied patches and hashes of grey images."""
    return media.gray_features(X.images(spark))


def image_tiles(spark, sf_dir):
    """S18, A37, W-free tiling: statistics of tiles over four grids."""
    return media.tiles(X.images(spark)).groupBy("asset_id", "columns").agg(F.count("*").alias("tiles"), *(F.round(F.avg(k), 4).alias(k) for k in media.TILE))


def _heat(spark):
    images = X.images(spark)
    return fusion.heat_map(fusion.tile_scores(media.tiles(images)), images.select("asset_id", "width", "height"))


def image_heat_map(spark, sf_dir):
    """Heat map over a common grid."""
    return _heat(spark)


def image_regions(spark, sf_dir):
    """Connected regions and their edges."""
    return fusion.regions(_heat(spark))


def _image_rows(spark):
    images = X.images(spark)
    tiles = media.tiles(images)
    regions = fusion.regions(fusion.heat_map(fusion.tile_scores(tiles), images.select("asset_id", "width", "height")))
    strength = regions.where("region < 6").groupBy("asset_id").agg(fusion.half_up(F.avg("score")).alias("region_strength"))
    whole = tiles.where("columns = 1").select("asset_id", *media.TILE)
    gray = media.gray_features(images).select("asset_id", "noise", F.col("edge").alias("gray_edge"), F.col("entropy").alias("gray_entropy"), F.least(F.lit(100), F.round(F.col("copied_pairs") / 20 * 100)).alias("copy_move"))
    meta = F.when(F.col("asset_id") == "noisy", F.create_map(*map(F.lit, ("make", "Canon", "model", "R5", "iso", "100", "exposure_time", "1/60")))).otherwise(F.create_map(F.lit("software"), F.lit("editor")))
    j = whole.join(gray, "asset_id").join(strength, "asset_id", "left").join(fusion.boundary_adhesion(regions), "asset_id", "left").na.fill(0, ["region_strength", "boundary"])
    j = j.withColumns({"meta": meta, "generators": F.when(F.col("asset_id") == "patched", F.array(F.lit("midjourney"))).otherwise(F.array().cast("array<string>")), "recompression": F.lit(0)})
    return j.withColumn("camera", fusion.camera_score()).withColumn("synthetic", fusion.synthetic_score())


def image_fusion(spark, sf_dir):
    """Signals of an image fused."""
    d = _image_rows(spark).withColumn("signals", fusion.image_signals())
    return d.select("asset_id", "camera", "synthetic", *(v.alias(k) for k, v in fusion.fused().items()), F.to_json("signals").alias("signals"))


def image_recalibrated(spark, sf_dir):
    """Scores after the consensus of absolute cell scores."""
    images = X.images(spark)
    cells = fusion.tile_scores(media.tiles(images)).where("columns = 17").select("asset_id", "score", "channels")
    origin = _image_rows(spark).withColumn("signals", fusion.image_signals()).select("asset_id", fusion.fused()["score"].alias("score"), "camera", "generators")
    return fusion.recalibrated(cells, origin).drop("generators")


def image_origin(spark, sf_dir):
    """Layers and origin score of images."""
    d = _image_rows(spark).withColumn("meta_text", F.lower(F.to_json("meta")))
    return fusion.media_origin(d.drop("edge", "entropy").withColumnsRenamed({"gray_edge": "edge", "gray_entropy": "entropy"}), "image").select("asset_id", "origin", "confidence", "label", F.to_json("layers").alias("layers"))


def image_stages(spark, sf_dir):
    """The chain of stages of an image."""
    d = _image_rows(spark).withColumn("signals", fusion.image_signals())
    return fusion.stages(d.withColumns({"score": fusion.fused()["score"], "matched": F.col("asset_id") == "smooth", "container_score": F.lit(10)}))


def sound_stats(spark, sf_dir):
    """Waveform statistics of WAV files."""
    return media.sound_features(X.sound(spark))


def sound_origin(spark, sf_dir):
    """Layers and origin score of sound."""
    return fusion.media_origin(media.sound_features(X.sound(spark)).withColumn("meta_text", F.col("asset_id")), "audio").select("asset_id", "origin", "confidence")


def video_origin(spark, sf_dir):
    """Ranges over sampled frames and the origin score."""
    frames = media.gray_features(X.images(spark)).select(F.when(F.col("asset_id") == "copied", "w").otherwise("v").alias("asset_id"), "noise", "edge")
    return fusion.media_origin(media.frame_ranges(frames).withColumn("meta_text", F.lit("")), "video").select("asset_id", "frames", "noise_range", "edge_range", "origin")


def pdf_office_origin(spark, sf_dir):
    """Origin scores of PDF and office files from their signals."""
    d = spark.createDataFrame([("a", 60, True, 0, 500, True, False, 70, 80), ("b", None, False, 2, 50, False, None, None, None)], "asset_id string, document_signal int, structure_ok boolean, ocr_pages int, digital_chars int, receipt boolean, consistent boolean, best_image int, process int")
    return fusion.media_origin(d, "pdf").select("asset_id", F.col("origin").alias("pdf_origin")).join(fusion.media_origin(d, "office").select("asset_id", F.col("origin").alias("office_origin")), "asset_id")


def hebrew_cohort(spark, sf_dir):
    """Cohort score of Hebrew texts."""
    return cohort.scored(X.hebrew(spark), X.cohort_model()).select("doc_id", "cohort.status", F.round("cohort.score", 6).alias("score"), "cohort.windows")


def hebrew_profile(spark, sf_dir):
    """Prose profile of masked texts."""
    from .text_queries import notes

    return context.profile(context.masked(X.hebrew(spark).unionByName(notes(spark)))).select("doc_id", "words", "distinct_words", "sentence_lengths.*", F.col("marks.dot").alias("dots"), "niqqud")


def stored_snapshot(spark, sf_dir):
    """K1, K2, K7: what may be stored of a profile, as JSON."""
    d = X.hebrew(spark).select("doc_id", "text", F.struct(F.length("text").alias("chars"), F.array(F.col("text")).alias("repeated_phrases")).alias("profile"))
    return records.snapshot(d).select("doc_id", F.to_json("profile").alias("profile"))


def repaired_names(spark, sf_dir):
    """File names read with the wrong encoding."""
    d = spark.createDataFrame([(1, "×©×××.docx".encode("latin-1", "ignore").decode("latin-1")), (2, "שלום.docx"), (3, "plain.docx"), (4, "Ã©tÃ©.txt"), (5, "été.txt")], "id long, name string")
    return d.withColumn("repaired", T.repaired_filename(F.col("name")))


def office_embedded_media(spark, sf_dir):
    """A package's first six media parts, the images among them scored by their containers."""
    files = spark.createDataFrame(X.office_files(), "asset_id string, content binary")
    return media.office_media(ooxml.embedded_media(files))


office_embedded_media.sql = "select 'media' asset_id, 6::bigint entries, 5::bigint images, 18::bigint best_image"


def image_recompression(spark, sf_dir):
    """Difference of grey images from others in their place, from fewer pixels, and from none."""
    rows = [("same", bytes([10, 20, 30]), bytes([10, 20, 30])), ("near", bytes([10, 20, 30, 40]), bytes([12, 18, 30, 44])), ("fewer", bytes([0, 255, 7]), bytes([0, 155])), ("none", b"", b""), ("null", None, b"")]
    d = spark.createDataFrame(rows, "asset_id string, gray binary, again binary")
    return d.select("asset_id", media.recompression("gray", "again").alias("r")).select("asset_id", "r.*")


image_recompression.sql = "select * from (values ('same', 0.0::double, 0.0::double, 0, 0), ('near', 2.0, 1.414, 4, 11), ('fewer', 50.0, 50.0, 100, 100), ('none', 0.0, 0.0, 0, 0), ('null', null, null, null, null)) v(asset_id, mean, std, largest, score)"


QUERIES = (
    word_parts, word_paragraphs, word_text, word_structure, word_revisions, word_process, word_lineage, word_run_candidates, word_origin_map, word_origin_summary, word_verdict, file_identity, image_containers, mail_headers, signed_claims,
    image_gray_features, image_tiles, image_heat_map, image_regions, image_fusion, image_recalibrated, image_origin, image_stages, sound_stats, sound_origin, video_origin, pdf_office_origin, hebrew_cohort, hebrew_profile, stored_snapshot, repaired_names, office_embedded_media, image_recompression,
)
