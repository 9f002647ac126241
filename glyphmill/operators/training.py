"""A small logistic model over a fixed feature list: split, training, metrics, registry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The model's features, in order.
FEATURES = (
    "processScore documentSignalScore rhythm lexical discourse surfaceStyle predictability aiResidue fingerprintCoverage rsidCount trackedChanges metadataLifetimeMinutes "
    "zipUniqueTimes imageOriginScore visionAgreement regionStrength boundaryAdhesion sensorPatternAnomaly spectralLatticeAnomaly globalGenerativePrior containerSignalScore "
    "cameraEvidenceScore recompressionScore copyMoveScore cfaParity jpegPhaseContrast flatNoise highPass edgeEnergy chromaStd entropy audioGeneratorScore audioRepeatBlocks "
    "videoNoiseConsistency videoEdgeConsistency provenanceVerified groundTruthExact"
).split()
RATE, DECAY, EPOCHS = 0.035, 0.003, 1800
LEAST_PER_CLASS = 10
#: Rows that a training run takes to the driver, about; of a larger set so many, drawn by hash.
MOST_ROWS = 1_000_000


class TooFew(ValueError):
    """Not enough examples of one class."""


def eligible(rows: DataFrame) -> DataFrame:
    """Approved rows of trust tier 2 and more with a usable label, and that label y."""
    y = F.when(F.col("proposed_label") == "ai", 1).when(F.col("proposed_label") == "human", 0)
    return rows.withColumn("y", y).where((F.col("review_status") == "approved") & (F.col("trust_tier") >= 2) & F.col("y").isNotNull())


def split(rows: DataFrame, label: str = "y", by: str = "asset_sha256") -> DataFrame:
    """rows with part: within each class, in order of hash, every fifth from the first on is test.

    Ranks within a class need one order over it; rows are numbered within hash
    ranges and the ranges' counts added, so no class has to be one task.
    """
    prefix = F.substring(by, 1, 3)
    number = F.row_number().over(Window.partitionBy(label, prefix).orderBy(by)) - 1
    sizes = rows.groupBy(label, prefix.alias("__p")).agg(F.count("*").alias("__n"))  # 4,096 ranges a class at most
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(label, "__p", before.alias("__before"))
    ranked = rows.withColumns({"__p": prefix, "__k": number}).join(starts, [label, "__p"])
    return ranked.withColumn("part", F.when((F.col("__k") + F.col("__before")) % 5 == 0, "test").otherwise("train")).drop("__p", "__k", "__before")


def vector(features: str = "features"):
    """The feature list's values from a map, 0 where there is none."""
    get = lambda k: F.coalesce(F.try_element_at(F.col(features), F.lit(k)), F.lit(0.0))
    return F.array(*(F.when(F.isnan(get(k)), 0.0).otherwise(get(k)) for k in FEATURES))


def column_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean, sd (population; 1 where 0)."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s")).select("feature", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("sd"))


def descend(x: np.ndarray, y: np.ndarray, rate: float = RATE, epochs: int = EPOCHS, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent of the logistic loss, decay on weights only."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(max(500, min(5000, epochs))):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -35, 35))) - y
        w -= rate * (x.T @ e / len(y) + decay * w)
        b -= rate * e.mean()
    return w, b


def confusion(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """n, tp, tn, fp, fn and rates at threshold .5; one row."""
    yes, hit = F.col(y) == 1, F.col(p) >= 0.5
    c = scored.agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"))
    safe = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    out = c.withColumns({"n": tp + tn + fp + fn, "pr": safe(tp, tp + fp), "re": safe(tp, tp + fn), "sp": safe(tn, tn + fp)})
    r4 = lambda x: F.round(x, 4)
    return out.select("n", "tp", "tn", "fp", "fn", r4(safe(tp + tn, F.col("n"))).alias("accuracy"), r4(F.col("pr")).alias("precision"), r4(F.col("re")).alias("recall"), r4(F.col("sp")).alias("specificity"), r4(safe(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re"))).alias("f1"), r4((F.col("re") + F.col("sp")) / 2).alias("balanced_accuracy"))


def train(rows: DataFrame, rate: float = RATE, epochs: int = EPOCHS) -> dict:
    """A model and its metrics from candidate rows (features as a map); raises TooFew below ten of a class."""
    data = split(eligible(rows))
    n = data.count()
    if n > MOST_ROWS:
        data = data.where(F.pmod(F.xxhash64("asset_sha256"), F.lit(n)) < MOST_ROWS)
    p = data.select("y", "part", vector().alias("x")).toPandas()
    x, y, test = np.array(p["x"].tolist(), float).reshape(-1, len(FEATURES)), p["y"].to_numpy(int), (p["part"] == "test").to_numpy()
    if min((y == 1).sum(), (y == 0).sum()) < LEAST_PER_CLASS:
        raise TooFew(f"need {LEAST_PER_CLASS} of each class; there are {(y == 1).sum()} and {(y == 0).sum()}")
    mean, sd = x[~test].mean(0), x[~test].std(0)
    sd[sd == 0] = 1
    w, b = descend((x[~test] - mean) / sd, y[~test], rate, epochs)
    w, b = w.round(8), round(float(b), 8)

    def rates(k):
        hit, yes = ((x[k] - mean) / sd @ w + b) >= 0, y[k] == 1
        return {"n": int(k.sum()), "tp": int((hit & yes).sum()), "tn": int((~hit & ~yes).sum()), "fp": int((hit & ~yes).sum()), "fn": int((~hit & yes).sum())}

    return {"family": "local_multimodal_logistic", "features": list(FEATURES), "weights": w.tolist(), "bias": b, "mean": mean.round(8).tolist(), "sd": sd.round(8).tolist(), "threshold": 0.5, "train": rates(~test), "test": rates(test)}


def predicted(rows: DataFrame, model: dict, x: str = "x") -> DataFrame:
    """rows with p, the model's probability; weights are literals of the plan."""
    lit = lambda xs: F.array(*(F.lit(float(v)) for v in xs))
    z = F.zip_with(F.zip_with(x, lit(model["mean"]), lambda a, m: a - m), lit(model["sd"]), lambda a, s: a / s)
    dot = F.aggregate(F.zip_with(z, lit(model["weights"]), lambda a, w: a * w), F.lit(float(model["bias"])), lambda s, v: s + v)
    return rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), dot)))))


def may_promote(metrics: DataFrame):
    """Eight held-out rows and a balanced accuracy of .75 at least."""
    return metrics.where((F.col("n") >= 8) & (F.col("balanced_accuracy") >= 0.75))


def promoted(registry: DataFrame, version: str, at: str) -> DataFrame:
    """registry after version becomes the active model of its language and domain, and the active one before it retired."""
    chosen = registry.where((F.col("version") == version) & (F.col("status") == "shadow")).select(F.col("language").alias("l"), F.col("domain").alias("d")).limit(1)
    joined = registry.join(F.broadcast(chosen), (F.col("language") == F.col("l")) & (F.col("domain") == F.col("d")), "left")
    same = F.col("l").isNotNull()
    status = F.when(same & (F.col("version") == version), "active").when(same & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    when = F.when(same & (F.col("version") == version), F.to_timestamp(F.lit(at))).otherwise(F.col("activated_at"))
    return joined.withColumns({"activated_at": when, "status": status}).drop("l", "d")


def registry_row(spark: SparkSession, model: dict, language: str, domain: str, at: str) -> DataFrame:
    """A shadow row for a trained model, with its artifact's hash and a version from the time."""
    import json

    text = json.dumps(model, sort_keys=True)
    row = spark.createDataFrame([(language, domain, text)], "language string, domain string, artifact string")
    stamp = F.date_format(F.to_timestamp(F.lit(at)), "yyyyMMddHHmmss")
    return row.select(F.concat_ws("-", "language", "domain", stamp).alias("version"), "language", "domain", F.sha2("artifact", 256).alias("artifact_sha256"), F.lit("shadow").alias("status"), F.lit(None).cast("timestamp").alias("activated_at"), "artifact")
