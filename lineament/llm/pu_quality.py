"""Quality classifier learned from positives and unlabelled text.

Trusted positives are labelled quality 1; unlabelled text is any of the
documents, its labels unread. The class prior is estimated from a first
classifier of positives against unlabelled: the least ratio, over its score
thresholds, of unlabelled to positive text above the threshold. The scorer then
minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss, so its sigmoid estimates the probability of quality 1.

Learning reads rows of the training folds only (crc32 of doc_id as text, modulo
5, is not 0), from the documents with the smallest keyed hashes: at most
``MOST_POSITIVES`` and ``MOST_UNLABELLED``. Inputs are the text's own
measurements; labels, lang, source and doc_id are not among them. Every whole
text is scored.

Null and empty texts have all measurements zero and are scored like any other.
Several labels of one document count as positive only if all are. Repeated rows
are scored each by itself; rows with a null doc_id are scored and never learnt
from (held_out is false). Without a single positive the prior is the least
allowed and the score says so. Very long texts are measured whole. An empty table
gives no rows. Kept columns stay, whatever their names; a column ``score`` among them
makes the new one ``_score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from .quality import repeated_words
from .shared import enrich, table

MOST_POSITIVES = 3000
MOST_UNLABELLED = 6000
THRESHOLD = 0.3
MARKS = b"#*$%&|<>!?.,;:-_\"'()[]{}=+/@~"
FEATURES = 15 + len(MARKS)


def measurements(text: str | None) -> np.ndarray:
    """FEATURES numbers of a whole text, none of which grows with its length but one logarithm."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, m = max(1, len(words)), max(1, len(lines))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size = len(raw)
    points = size - c[128:192].sum()
    upper, lower, digits = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    blank = c[9:14].sum() + c[32]
    seen = len(set(words))
    share = c / size
    share = share[share > 0]
    out[:15] = (
        np.log1p(len(words)) / 5,
        (points - blank) / n / 10,
        upper / max(1, upper + lower),
        digits / points,
        (size - points) / size,
        blank / points,
        min(1.0, m / n * 10),
        1 - len(set(lines)) / m,
        repeated_words(words) / n,
        seen / n,
        seen / np.sqrt(n) / 10,
        -(share * np.log2(share)).sum() / 8,
        c[0:9].sum() / size,
        float(len(words) < 50),
        float(len(words) < 15),
    )
    out[15:] = np.minimum(2.0, c[np.frombuffer(MARKS, np.uint8)] / n)
    return out


@dataclass(frozen=True)
class Scorer:
    """One hidden layer over standardised measurements."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05, most: float = 0.95) -> float:
    """Least ratio of unlabelled to positive scores above a threshold that half of the positives pass."""
    if not len(positive) or not len(unlabelled):
        return least
    at = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    ratios = [(unlabelled >= t).mean() / max(1e-9, (positive >= t).mean()) for t in at]
    return float(np.clip(min(ratios), least, most))


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 8, rounds: int = 200, rate: float = 0.02, decay: float = 5.0, seed: int = 11) -> Scorer:
    """Estimate the prior, then minimise the non-negative risk (Adam on whole batches).

    ``decay`` shrinks the weights as if it were so many rows' worth of risk."""
    both = np.vstack((positive, unlabelled)) if len(positive) + len(unlabelled) else np.zeros((1, FEATURES))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))

    def train(prior: float | None, zp: np.ndarray, zu: np.ndarray) -> list[np.ndarray]:
        shrink = decay / max(1, len(zp) + len(zu))
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 0.3, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        for step in range(1, rounds + 1):
            hp, hu = np.tanh(zp @ p[0] + p[1]), np.tanh(zu @ p[0] + p[1])
            sp, su = sigmoid(hp @ p[2] + p[3]), sigmoid(hu @ p[2] + p[3])
            np_, nu = max(1, len(zp)), max(1, len(zu))
            if prior is None:
                gp, gu = (sp - 1) / np_, su / nu
            else:
                # Losses: positive as 1: -log s; as 0: -log(1 - s), which is raw + (-log s).
                negative = (-np.log1p(-np.minimum(su, 1 - 1e-12))).mean() - prior * (-np.log1p(-np.minimum(sp, 1 - 1e-12))).mean() if nu and len(zp) else 0.0
                if negative >= 0:
                    gp, gu = prior * ((sp - 1) - sp) / np_, su / nu
                else:
                    gp, gu = prior * sp / np_, -su / nu
            grads = [np.zeros_like(x) for x in p]
            for z, h, g in ((zp, hp, gp), (zu, hu, gu)):
                back = g[:, None] * p[2][None, :] * (1 - h * h)
                grads[0] += z.T @ back
                grads[1] += back.sum(axis=0)
                grads[2] += h.T @ g
                grads[3] += g.sum()
            for k in range(4):
                g = grads[k] + shrink * p[k] * (k in (0, 2))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return p

    def scorer(p: list[np.ndarray], prior: float) -> Scorer:
        return Scorer(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior)

    # The prior comes from rows that the first classifier has not learnt from.
    first = scorer(train(None, zp[::2], zu[::2]), 0.5)
    prior = estimated_prior(first.raw(positive[1::2]), first.raw(unlabelled[1::2]))
    return scorer(train(prior, zp, zu), prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = MOST_POSITIVES, unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of the bounded samples: two top-k of ids, then one pass that reads their texts.

    Of rows that share an id one text is taken, so the bound on ids is one on rows."""
    order = F.xxhash64("doc_id", F.lit("pu"))
    good = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    chosen_p = good.orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    every = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id")
    chosen_u = every.distinct().orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("kind"))
    chosen = chosen_p.union(chosen_u).groupBy("doc_id").agg(F.max(F.col("kind")).alias("p"), F.max(1 - F.col("kind")).alias("u"))
    # At most positives + unlabelled rows of three numbers: safe to broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p", "u").agg(F.min("text").alias("text"))

    def factory():
        def work(values):
            return [pa.array([measurements(t).tolist() for t in values], pa.list_(pa.float64()))]

        return work

    rows = enrich(texts, "text", factory, [StructField("x", ArrayType(DoubleType()))], ["p", "u", "doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    pick = lambda k: np.array([r.x for r in rows if r[k]]).reshape(-1, FEATURES)
    return pick("p"), pick("u")


def scored(docs: DataFrame, scorer: Scorer, keep: list[str], text: str = "text") -> DataFrame:
    def factory():
        def work(values):
            x = np.array([measurements(t) for t in values]).reshape(-1, FEATURES)
            return [pa.array(scorer.score(x))]

        return work

    return enrich(docs, text, factory, [StructField("score", DoubleType())], keep)


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = fit(*training_rows(docs, labels))
    return scored(docs, scorer, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
