"""Likeness of a Hebrew text to a reference cohort, by a frozen linear model given as a row of JSON.

The score says how alike a text and the cohort are; it is no probability of authorship.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T

FEATURES, WINDOW = 111, 350
LEAST_WORDS, MOST_MARKED = 500, 0.05
HEBREW = re.compile("[א-ת]+")


class InvalidModel(ValueError):
    """The artifact is not one that may score."""


def validated(model: dict) -> dict:
    """The model itself, or InvalidModel: any doubt means no score."""
    finite = lambda xs: isinstance(xs, list) and len(xs) == FEATURES and all(isinstance(x, (int, float)) and math.isfinite(x) for x in xs)
    words = [model.get(k) for k in ("function_words", "phrases", "prefixes")]
    ok = (
        model.get("version") == "hebrew-cohort-logistic-v1" and len(model.get("features") or ()) == FEATURES and model.get("window") == WINDOW
        and (model.get("report") or {}).get("training_performed") is True and model["report"].get("is_generic_ai_accuracy") is False
        and all(finite(model.get(k)) for k in ("mean", "scale", "coefficients")) and min(model["scale"]) > 0
        and math.isfinite(model.get("intercept", math.nan)) and 0 < model.get("threshold", 0) < 1
        and all(isinstance(w, list) and all(isinstance(x, str) and len(x) <= 80 for x in w) for w in words) and 17 + sum(map(len, words)) == FEATURES
        and isinstance(model.get("train_source_ids"), list) and all(isinstance(x, str) and len(x) == 36 for x in model["train_source_ids"])
    )
    if not ok:
        raise InvalidModel("not a cohort model")
    return model


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin: early, late and half way."""
    low = min(100, max(0, n - WINDOW))
    high = max(low, int(n * 0.8) - WINDOW)
    return sorted({low, (low + high) // 2, high})


def features(words: list[str], model: dict) -> np.ndarray:
    """Length, variety and frequency features of one window."""
    n, count = len(words), Counter(words)
    size = np.array([len(w) for w in words])
    p = np.array(list(count.values())) / n
    shape = [size.mean(), size.std() / max(size.mean(), 1), len(count) / n, -(p * np.log(p)).sum() / math.log(max(n, 2)), sum(c == 1 for c in count.values()) / n]
    text = " " + " ".join(words) + " "
    phrases = [len(re.findall(f"(?= {re.escape(x)} )", text)) / n for x in model["phrases"]]
    return np.array([*shape, *((size == k).mean() for k in range(1, 13)), *(count[w] / n for w in model["function_words"]), *phrases, *(sum(w.startswith(x) and len(w) > 1 for w in words) / n for x in model["prefixes"])])


SCORE = "status string, score double, reference_like boolean, windows int, top array<struct<feature:string,contribution:double>>"


def scored(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with cohort: status and score; without a valid model, or for texts out of its range, only a status."""
    original = T.words(F.col(text))
    hebrew = F.filter(original, lambda w: w.rlike("[א-ת]"))
    n, marked = F.size(hebrew), F.size(F.filter(hebrew, lambda w: w.rlike(T.NIQQUD)))
    gate = F.when(n < LEAST_WORDS, "insufficient_text").when(marked / n > MOST_MARKED, "unsupported_niqqud_tokenization").otherwise("scored")
    try:
        model = validated(model) if model is not None else None
    except InvalidModel:
        return docs.withColumn("cohort", F.struct(F.lit("invalid_artifact").alias("status"), F.lit(None).cast("double").alias("score")))
    if model is None:
        return docs.withColumn("cohort", F.struct(F.lit("not_configured").alias("status"), F.lit(None).cast("double").alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(json.dumps(model))

    @F.pandas_udf(SCORE)
    def score(texts: pd.Series, status: pd.Series) -> pd.DataFrame:
        m = json.loads(shared.value)
        mean, scale, weight = (np.array(m[k], float) for k in ("mean", "scale", "coefficients"))
        rows = []
        for t, s in zip(texts, status):
            words = HEBREW.findall(t or "") if s == "scored" else []
            if len(words) < LEAST_WORDS:
                rows.append(("insufficient_text" if s == "scored" else s, None, None, 0, None))
                continue
            at = starts(len(words))
            x = np.mean([features(words[k : k + WINDOW], m) for k in at], 0)
            part = (x - mean) / scale * weight
            p = 1 / (1 + math.exp(-max(-700, min(700, m["intercept"] + part.sum()))))
            top = [{"feature": m["features"][i], "contribution": float(part[i])} for i in np.argsort(-np.abs(part), kind="stable")[:8]]
            rows.append(("scored", p, p >= m["threshold"], len(at), top))
        return pd.DataFrame(rows, columns=["status", "score", "reference_like", "windows", "top"])

    return docs.withColumn("cohort", score(F.col(text), gate))
