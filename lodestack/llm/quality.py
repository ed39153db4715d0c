"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are described by a few counts of style that hold for any
language. The share of positives in the unlabelled text is estimated from a first, plain model; the
second minimises  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), whose clipped part keeps the model
from fitting the unlabelled sample below what negatives can cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most trusted positives, and most unlabelled rows, that a model is fitted on.
FIT_ROWS = 20_000

_SYMBOLS = "#*$%&|<>{}[]~^=_\\@"


def style(text: str | None) -> list[float]:
    """Counts of style of a whole text, as shares; zeros for a null or empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STYLE)
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n) / 10,
        sum(map(text.count, _SYMBOLS)) / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        min(chars / n, 30) / 10,
        sum(map(text.count, "0123456789")) / chars,
        (text.count(".") + text.count(",")) / n,
        min(n / len(lines), 200) / 100,
        sum(map(str.istitle, words)) / n,
        max(map(len, words)) / 100 if n else 0.0,
    ]


STYLE = ("length", "symbols", "exclamations", "capitals", "echoes", "repeats", "line_repeats", "word_length", "digits", "stops", "line_length", "titles", "longest")


def bent(x: np.ndarray) -> np.ndarray:
    """Shares (n x k) with square roots and steep starts, so that a linear model can bend."""
    x = np.clip(x, 0, 5)
    return np.hstack([x, np.sqrt(x), np.minimum(x, 0.05) * 20, np.minimum(x, 0.3)])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((bent(x) - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two samples' shares over score regions.

    A region holds positives of both samples alike, and the unlabelled may add negatives; so the ratio is
    at least the prior, and near it where negatives are rare. Regions hold a fifth of the positives or more.
    """
    best = 1.0
    for q in np.linspace(0.2, 0.9, 29):
        cut = np.quantile(positive, 1 - q)
        p, u = np.mean(positive >= cut), np.mean(unlabelled >= cut)
        slack = math.sqrt(u * (1 - u) / max(1, len(unlabelled)) + p * (1 - p) / max(1, len(positive)))
        best = min(best, (u + slack) / max(p, 1e-9))
    return float(np.clip(best, 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 800, decay: float = 1e-3) -> Model:
    """Model of style rows of trusted positives and of unlabelled texts. Without either, every score is the prior."""
    k = bent(np.zeros((1, len(STYLE)))).shape[1]
    if not len(positive) or not len(unlabelled):
        prior = 1.0 if len(positive) else 0.0
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 30.0 * (2 * prior - 1), prior)
    p, u = bent(positive), bent(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = (np.hstack([(x - mean) / scale, np.ones((len(x), 1))]) for x in (p, u))

    def shrink(w: np.ndarray, by: float = decay) -> np.ndarray:
        return by * np.r_[w[:-1], 0]

    def plain(w: np.ndarray) -> np.ndarray:
        # shrunk more: trusted positives mustn't score above those of the unlabelled just for being fitted on
        return p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + shrink(w, 10 * decay)

    first = _adam(plain, k + 1, steps // 2)
    prior = estimate_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up = p.T @ (sp - 1) / len(p)  # loss of positives as positives
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        negative = -np.mean(np.log1p(-np.minimum(su, 1 - 1e-12))) + prior * np.mean(np.log1p(-np.minimum(sp, 1 - 1e-12)))
        # a negative part below zero is over-fitted: step back along it
        return (prior * up + down if negative >= 0 else -down) + shrink(w)

    w = _adam(risk, k + 1, steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def styles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, style array<double>) of every row, or (id, score double) by a model."""
    id_type = docs.schema[id_col].dataType.simpleString()
    name, kind = ("style", "array<double>") if model is None else ("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [style(t.as_py()) for t in batch.column(1)]
            values = pa.array(rows, pa.list_(pa.float64())) if model is None else pa.array(model.score(np.array(rows).reshape(-1, len(STYLE))))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[id_col, name])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {name} {kind}")


def train(docs: DataFrame, labels: DataFrame, fold: F.Column, rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` trusted positives of labels(doc_id, quality) and `rows` of docs(doc_id, text) where fold holds.

    Both samples are those of the smallest hashes of doc_id. Negative labels are not used at all; of
    several labels of a document, one positive is enough.
    """
    dealt = F.xxhash64("doc_id")
    trusted = labels.where((F.col("quality") == 1) & fold).select("doc_id").distinct().orderBy(dealt, "doc_id").limit(rows)
    web = docs.where(fold & F.col("doc_id").isNotNull()).select("doc_id").orderBy(dealt, "doc_id").limit(rows)
    picked = trusted.withColumn("kind", F.lit(1)).unionByName(web.withColumn("kind", F.lit(0)))
    picked = picked.groupBy("doc_id").agg(F.max(F.col("kind") == 1).alias("p"), F.max(F.col("kind") == 0).alias("u"))
    picked = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 x rows ids
    got = _styles_of_samples(picked).collect()  # at most 2 x rows short arrays
    p = np.array([r["style"] for r in got if r["p"]]).reshape(-1, len(STYLE))
    u = np.array([r["style"] for r in got if r["u"]]).reshape(-1, len(STYLE))
    return fit(p, u)


def _styles_of_samples(picked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [style(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["style", "p", "u"])

    return picked.select("text", "p", "u").mapInArrow(run, "style array<double>, p boolean, u boolean")


def scorer(model: Model):
    """An Arrow-batched function of a text column that gives its score, for filtering rows where they stand."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([style(t.as_py()) for t in text]).reshape(-1, len(STYLE))))

    return scored


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row of docs; null and empty texts are scored like any other.

    Equal texts get equal scores, rows with the same id each a row; an empty table gives none; other
    columns are ignored.
    """
    return styles(docs, id_col, text_col, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
