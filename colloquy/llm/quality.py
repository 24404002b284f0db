"""Quality classifier learned from positive and unlabelled texts.

Trusted positives are labelled good texts; unlabelled texts are web texts of unknown quality. With the
class prior p, the risk of a scorer g over all text is p*E+[l(g)] + E_u[l(-g)] - p*E+[l(-g)]; the last
two terms estimate the risk of bad text and cannot be negative, so the non-negative estimator steps
back whenever a batch makes them so. The scorer is a linear model on standardised features.

The class prior comes from the same two samples: above any score there are at least as many unlabelled texts
as the positives among them make up, so the least ratio of the two shares bounds the prior from above, and
comes close to it where some scores are reached by positives alone. Labels of bad texts are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bound_batches, utf8

#: Bounds of the training sample, in rows: trusted positives and unlabelled texts.
MAX_POSITIVES, MAX_UNLABELLED = 4000, 8000

FEATURES = (
    "upper", "digits", "other_ascii", "marks", "pipes", "marked_words", "shouted_words", "bare_words",
    "repeated_next", "distinct_words", "distinct_pairs", "distinct_lines", "word_length", "sentence_ends",
    "commas", "lower_starts", "most_common", "long_runs",
)

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_PLAIN = b" \t\r\n.,;:'\"()-?"
_NOT_MARKS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b in _PLAIN)
_END = frozenset(b"!#$%&*+<=>@[\\]^_`{|}~/")


def features(text: bytes) -> list[float]:
    """Shape of a text: shares of letters, marks and repeated parts; a text without words is all 0."""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    size = len(text)
    upper = size - len(text.translate(None, _UPPER))
    lower = size - len(text.translate(None, _LOWER))
    marks = text.translate(None, _NOT_MARKS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    some = max(n - 1, 1)
    marked = sum(w[-1] in _END for w in words)
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    return [
        upper / (upper + lower + 1), (size - len(text.translate(None, _DIGIT))) / size,
        sum(b < 32 and b not in b"\t\r\n" for b in marks) / size, len(marks) / size,
        text.count(b"|") / n, marked / n, shouted / n, sum(not w.isalnum() and len(w) == 1 for w in words) / n,
        same / some, len(counts) / n ** 0.75 if n > 1 else 1.0, len(pairs) / some, len(set(lines)) / max(len(lines), 1),
        min(size / n, 40.0) / 10, (text.count(b".") + text.count(b"?")) / n, text.count(b",") / n,
        sum(97 <= x.lstrip()[0] <= 122 for x in lines) / max(len(lines), 1), max(counts.values()) / n,
        float(np.log1p(max(map(len, words)))) / 5,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Linear scorer; None weights (no trusted positives or no unlabelled text) score 0.5 throughout."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), 0.5)
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(
    positives: np.ndarray, unlabelled: np.ndarray, prior: float,
    steps: int = 1500, rate: float = 0.05, decay: float = 1e-4, seed: int = 11,
) -> QualityModel:
    """Minimises the non-negative risk by Adam on batches."""
    width = len(FEATURES)
    if len(positives) == 0 or len(unlabelled) == 0:
        return QualityModel(np.zeros(width), np.ones(width), None, 0.0, prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positives, unlabelled))
    random = np.random.default_rng(seed)
    theta = np.zeros(width + 1)
    m = v = np.zeros(width + 1)

    def grad(x: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        z = sign * (x @ theta[:-1] + theta[-1])
        slope = -sign / (1 + np.exp(np.clip(z, -40, 40)))
        loss = np.logaddexp(0, -z).mean()
        return loss, np.append(x.T @ slope, slope.sum()) / len(x)

    for step in range(1, steps + 1):
        bp = p[random.integers(0, len(p), min(512, len(p)))]
        bu = u[random.integers(0, len(u), min(1024, len(u)))]
        _, gp = grad(bp, 1.0)
        lp_bad, gp_bad = grad(bp, -1.0)
        lu_bad, gu_bad = grad(bu, -1.0)
        bad = lu_bad - prior * lp_bad
        g = prior * gp + (gu_bad - prior * gp_bad) if bad >= 0 else -(gu_bad - prior * gp_bad)
        g = g + decay * np.append(theta[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return QualityModel(mean, scale, theta[:-1], float(theta[-1]), prior)


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """Share of positives among the unlabelled: the least ratio of shares above a score, within [0.05, 0.95].

    One half of the samples trains the scorer, the other half is counted; scores that fewer than `least` of
    the positives reach are left out, as their shares are too rough. The least of many ratios is rather too
    low than too high, which is the safer side: a prior above the truth makes the risk of bad texts vanish
    early, and the scorer lets them pass. Without samples it is 0.5.
    """
    if len(positives) < 2 or len(unlabelled) < 2:
        return 0.5
    model = fit(positives[0::2], unlabelled[0::2], 0.5)
    good, any_ = np.sort(model.score(positives[1::2])), np.sort(model.score(unlabelled[1::2]))
    at = np.unique(good)
    reach_good = 1 - np.searchsorted(good, at) / len(good)
    reach_any = 1 - np.searchsorted(any_, at) / len(any_)
    kept = reach_good >= least
    p, u = reach_good[kept], reach_any[kept]
    return float(min(max((u / p).min(), 0.05), 0.95))


def risk(model: QualityModel, positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The non-negative risk of a scorer on both samples, with the logistic loss."""
    z_good, z_any = (-np.log(1 / np.clip(model.score(x), 1e-12, 1 - 1e-12) - 1) for x in (positives, unlabelled))
    bad = np.logaddexp(0, z_any).mean() - model.prior * np.logaddexp(0, z_good).mean()
    return float(model.prior * np.logaddexp(0, -z_good).mean() + max(bad, 0.0))


def held_out(doc_id: str = "doc_id"):
    """Rows that never teach: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": [features(utf8(t)) for t in batch["text"]]})

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "row array<double>")


def _matrix(docs: DataFrame) -> np.ndarray:
    # At most MAX_POSITIVES or MAX_UNLABELLED rows of 18 numbers.
    rows = [r["row"] for r in _feature_rows(docs).collect()]
    rows.sort()
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def _shuffled(rows: np.ndarray) -> np.ndarray:
    """The rows, which come sorted, in a fixed random order."""
    return rows[np.random.default_rng(5).permutation(len(rows))]


def train(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Fits on bounded samples of rows that are not held out, chosen by a hash of the id.

    Trusted positives are labelled 1; unlabelled texts are any of docs, their labels unseen. The prior is
    estimated from both. Of rows that repeat an id the text with the smallest hash is taken, so the bounds
    hold for rows as well.
    """
    bound_batches(docs.sparkSession)
    trusted = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & ~held_out())

    def sample(ids: DataFrame, most: int) -> DataFrame:
        key = F.xxhash64(F.col("doc_id"), F.lit(5))
        return F.broadcast(ids.select(F.col("doc_id").cast("long")).distinct().orderBy(key, "doc_id").limit(most))

    def rows(ids: DataFrame, most: int) -> np.ndarray:
        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
        found = found.join(sample(ids, most), "doc_id", "left_semi")
        return _matrix(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))

    good = rows(trusted, positives)
    other = rows(docs.where(F.col("doc_id").isNotNull() & ~held_out()), unlabelled)
    return fit(good, other, estimate_prior(_shuffled(good), _shuffled(other)))


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Adds the score of each whole text, 0 to 1, higher for better text.

    Only the text counts. A null text scores as an empty one; equal texts score alike. Other columns
    stay; an existing column called `name` is replaced. No shuffle.
    """

    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array([features(utf8(t)) for t in batch], dtype=float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(rows))

    return docs.withColumn(name, run(F.col("text").cast("string")))
