"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled 1; unlabelled text is any text of the training
folds, whatever its label.  With p the estimated share of positives, the risk of
a score f is p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): the second part, the
risk on negatives written without any negative, must not go below 0, and where it
does, the step goes the other way (Kiryo et al., 2017).  A network with one
hidden layer is trained on shape features of the text: nothing but the text
takes part in a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_key
from .textscan import Words, slabs, tidied

#: Bounds of the samples that the network is trained on; drawn by hash of doc_id.
POSITIVES = 6000
UNLABELLED = 10000

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "stop_mark", "symbol", "bar", "bang", "line_breaks", "non_ascii",
    "word_bytes", "word_bytes_sd", "short_words", "long_words", "distinct_words", "top_word", "marked_words", "upper_words",
    "distinct_pairs", "distinct_shingles", "distinct_lines", "mean_gap_alike",
)

_CLASS = np.zeros(256, np.uint8)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"#$%&*@^~=+<>/\\_{}[]", b"|", b"!", b"\n"), 1):
    _CLASS[list(_chars)] = _name
_CLASS[128:192] = 9  # not a code point's first byte
_CLASS[192:] = 8


def _share(a, b):
    return a / max(b, 1)


def features(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slab; an empty text's are 0."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    pairs, pair_first = w.shingles(2)
    shingles, shingle_first = w.shingles(5)
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 10 + classes, minlength=10 * n).reshape(n, 10)
    size = w.end - w.start
    last = classes[w.end - 1]
    marked = (last == 4) | (last == 5) | (last == 6)
    upper = classes[w.start] == 1
    upper &= np.where(size > 1, classes[np.minimum(w.start + 1, len(classes) - 1)] == 1, False)
    out = np.zeros((n, len(FEATURES)))
    for k in range(n):
        text = data[offsets[k] : offsets[k + 1]]
        if not text:
            continue
        c, m = counts[k], len(text)
        lo, hi = w.first[k], w.first[k + 1]
        words = hi - lo
        s = size[lo:hi]
        _, often = np.unique(w.hashes[lo:hi], return_counts=True)
        p, q = pairs[pair_first[k] : pair_first[k + 1]], shingles[shingle_first[k] : shingle_first[k + 1]]
        lines = [x for x in text.split(b"\n") if x]
        out[k] = (
            np.log1p(m), np.log1p(words), _share(c[1], m), _share(c[2], m), _share(c[3], words), _share(c[4], m), _share(c[5], m), _share(c[6], m), _share(c[7], words), _share(c[8], m),
            s.mean() if words else 0, s.std() if words else 0, _share((s <= 3).sum(), words), _share((s > 14).sum(), words), _share(len(often), words), _share(often.max(initial=0), words), _share(marked[lo:hi].sum(), words), _share(upper[lo:hi].sum(), words),
            _share(len(np.unique(p)), len(p)), _share(len(np.unique(q)), len(q)), _share(len(set(lines)), len(lines)), _share((w.hashes[lo + 1 : hi] == w.hashes[lo : hi - 1]).sum(), words),
        )
    return out


class Scorer:
    """A network with one hidden layer over standardised features."""

    def __init__(self, width: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        d = len(FEATURES)
        self.mean, self.sd = np.zeros(d), np.ones(d)
        self.p = {"a": r.standard_normal((d, width)) / np.sqrt(d), "b": np.zeros(width), "c": r.standard_normal(width) / np.sqrt(width), "d": np.zeros(1)}
        self.trained = False

    def _forward(self, x):
        h = np.tanh(x @ self.p["a"] + self.p["b"])
        return h, h @ self.p["c"] + self.p["d"]

    def _standard(self, x):
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; without training 0.5."""
        if not self.trained:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._forward(self._standard(x))[1], -30, 30)))

    def _descend(self, x: np.ndarray, slope, steps: int, rate: float, decay: float) -> None:
        """Adam steps; slope(f): derivative of the risk by each row's f."""
        m = {k: np.zeros_like(y) for k, y in self.p.items()}
        v = {k: np.zeros_like(y) for k, y in self.p.items()}
        for step in range(1, steps + 1):
            h, f = self._forward(x)
            g = slope(1 / (1 + np.exp(-np.clip(f, -30, 30))))
            dh = np.outer(g, self.p["c"]) * (1 - h * h)
            grad = {"a": x.T @ dh + decay * self.p["a"] / 10, "b": dh.sum(0), "c": h.T @ g + decay * self.p["c"] / 10, "d": np.array([g.sum()])}
            for k, y in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * y
                v[k] = 0.99 * v[k] + 0.01 * y * y
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.trained = True

    def _joined(self, positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
        x = np.concatenate([positive, unlabelled])
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        return self._standard(x)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Non-negative risk, with the smooth loss l(f) = 1 / (1 + exp(f)), which does not grow with a score."""
        n, k = len(positive), len(unlabelled)

        def slope(s):
            ds = s * (1 - s)
            if s[n:].mean() - prior * s[:n].mean() >= 0:
                return np.concatenate([-2 * prior * ds[:n] / n, ds[n:] / k])
            return np.concatenate([prior * ds[:n] / n, -ds[n:] / k])

        self._descend(self._joined(positive, unlabelled), slope, steps, rate, decay)

    def tell_apart(self, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> None:
        """Positives from unlabelled text, with the logistic loss."""
        n, k = len(positive), len(unlabelled)
        self._descend(self._joined(positive, unlabelled), lambda s: np.concatenate([(s[:n] - 1) / n, s[n:] / k]), steps, 0.01, 1e-3)


def tail_ratio(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Least ratio of the shares of unlabelled and of positive scores above a threshold.

    Above one that only positives pass, it is the share of positives in the
    unlabelled; thresholds that few pass are held back by the bound on the shares'
    errors, which holds with probability 1 - sure.
    """
    cuts = np.unique(positive)
    p, u = (1 - np.searchsorted(np.sort(s), cuts) / len(s) for s in (positive, unlabelled))
    error = sum(np.sqrt(np.log(4 / sure) / 2 / len(s)) for s in (positive, unlabelled))
    best = np.argmin((u + error) / p)
    return float(u[best] / p[best])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text, from these two only: a network tells one half of both apart, the other half's scores are compared.

    Both halves take either part; the mean counts, kept away from 0 and 1.
    """
    found = []
    for k in (0, 1):
        if not min(len(positive[k::2]), len(positive[1 - k :: 2]), len(unlabelled[k::2]), len(unlabelled[1 - k :: 2])):
            continue
        judge = Scorer(seed=11 + k)
        judge.tell_apart(positive[k::2], unlabelled[k::2])
        found.append(tail_ratio(judge.score(positive[1 - k :: 2]), judge.score(unlabelled[1 - k :: 2])))
    return min(max(float(np.mean(found)) if found else 0.5, 0.05), 0.95)


def held_out(doc_id="doc_id"):
    """Rows that are not trained on: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 3 == 1, F.lit(False))


def _featured(names):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(x.tolist(), pa.list_(pa.float64()))], [*names, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Trained on bounded samples of the training folds; untrained if they hold no positive or no text."""
    mine = labels.select("doc_id", "quality").where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    positive = mine.where("quality = 1").select("doc_id").distinct().orderBy(*by_hash).limit(POSITIVES).withColumn("positive", F.lit(1))
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out() & F.col("doc_id").isNotNull()).orderBy(*by_hash).limit(UNLABELLED).withColumn("positive", F.lit(0))
    sample = F.broadcast(positive.unionByName(other.distinct()))
    # Of rows that repeat a doc_id one, so that the sample keeps its bound.
    one = with_key(docs).join(sample, "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text"))
    drawn = one.select("positive", "text").mapInArrow(tidied(_featured(["positive"])), "positive int, x array<double>")
    rows = drawn.toArrow()
    flag = rows["positive"].to_numpy()
    x = np.array(rows["x"].combine_chunks().flatten(), float).reshape(-1, len(FEATURES)) if len(flag) else np.zeros((0, len(FEATURES)))
    scorer = Scorer()
    if (flag == 1).any() and (flag == 0).any():
        # In no order that the distribution over tasks decides.
        parts = [x[flag == k] for k in (1, 0)]
        parts = [p[np.lexsort(p.T)] for p in parts]
        scorer.fit(*parts, estimated_prior(*parts))
    return scorer


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs; null texts are empty, other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text")):
                s = shared.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])

    return with_key(docs).select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op3_quality returns: a row for every row of docs; repeated rows repeat with one score.

    Null and empty texts have features of 0 and a score like any other; without
    labels, or text, of the training folds every score is 0.5.
    """
    return scored(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; see ``digest``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slabs(batch.column("text").cast(pa.binary())):
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.score(features(data, offsets)) >= 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
