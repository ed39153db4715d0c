"""Toxicity: a linear classifier regularised by counterfactual swaps of identity terms.

A document is the set of its words; a word counts by itself and by its first letters, so that forms of
one stem share what is learnt. Besides fitting the labels, training penalises the change of the score
between a labelled text and its counterfactual copies: each identity term in it swapped for others of
its kind and taken out, and, where it has none, one put in. So a neutral mention of a group does not
move the score, whichever label its text has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most labelled rows of each class that a model is fitted on, and most words, each counted once a row, that both have together.
FIT_ROWS, FIT_WORDS = 4_000, 2_000_000
#: Terms that an identity term is swapped for.
SWAPS = 3
#: Features a document may have in more than this many rows are kept; rarer ones tell nothing.
LEAST_ROWS = 3
SLOTS = 1 << 20
_STRIP = ".,;:!?\"'()[]{}|#*$%&<>-_"

# Kinds of identity terms, each a group that may be mentioned neutrally.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual", "lgbt"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "catholic", "atheist", "muslims", "jews", "christians"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "indian", "chinese", "mexican", "arab"),
    ("immigrant", "immigrants", "refugee", "refugees", "migrant", "migrants", "foreigner", "foreigners"),
    ("old", "young", "elderly", "teenager", "disabled", "blind", "deaf", "autistic"),
    ("femmes", "hommes", "juifs", "musulmans", "noirs", "blancs", "immigrés", "arabes"),
    ("frauen", "männer", "juden", "muslime", "schwarze", "weiße", "ausländer", "türken"),
    ("mujeres", "hombres", "judíos", "musulmanes", "negros", "blancos", "inmigrantes", "gitanos"),
)


def tokens(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def features(token: str) -> list[int]:
    """Slots of a word: the word, and its beginnings of four to six letters."""
    word = token.strip(_STRIP)
    if not word:
        return []
    names = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in names]


class Recent(dict):
    """What make(key) gives, of recently used keys: a full table becomes the old one, whose entries move up when used."""

    def __init__(self, make, entries: int = 200_000):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > 64:
                return got
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    table: Recent | None = field(default=None, repr=False)

    def score(self, text: str | None) -> float:
        if self.table is None:
            get = self.weights.get
            self.table = Recent(lambda t: sum(get(f, 0.0) for f in features(t)))
        z = self.bias + math.fsum(map(self.table.__getitem__, tokens(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.weights, self.bias, self.table = *state, None


_KIND = {t: k for k, kind in enumerate(IDENTITY_TERMS) for t in kind}


def swaps(words: set[str], number: int) -> list[tuple[list[str], list[str]]]:
    """(words out, words in) of a text's counterfactual copies; number: the text's, which turns what is swapped in."""
    bare = {w.strip(_STRIP): w for w in words}
    out = []
    for term in sorted(bare.keys() & _KIND.keys()):
        kind = IDENTITY_TERMS[_KIND[term]]
        out.append(([bare[term]], []))
        at = kind.index(term)
        for k in range(min(SWAPS, len(kind) - 1)):
            other = kind[(at + 1 + (number + k) % (len(kind) - 1)) % len(kind)]
            out.append(([bare[term]], [] if other in bare else [other]))
    if not out:
        terms = list(_KIND)
        out.append(([], [terms[number * 7919 % len(terms)]]))
    return out


def fit(texts: list[list[str]], labels: np.ndarray, penalty: float = 10.0, decay: float = 1e-5, sparse: float = 2e-2, steps: int = 150, rate: float = 0.1, share: float | None = None) -> Model:
    """Minimise the log loss + decay |w|^2 + sparse / sqrt(rows) |w| + penalty * mean squared change of the probability from texts to their copies.

    texts: the words of each labelled text. The absolute term keeps the many words that tell nothing at
    zero, so that a long document is judged like a short one. share: the positives' share where labels
    come from, if the texts hold another.
    """
    positive, n = float(np.sum(labels == 1)), len(texts)
    if not n or positive in (0.0, float(n)):
        share = positive / n if n else 0.0
        return Model({}, math.log((share + 1e-6) / (1 - share + 1e-6)))
    known = Recent(lambda t: np.array(features(t), np.int64))
    rows = [np.concatenate([known[t] for t in words]) if words else np.zeros(0, np.int64) for words in texts]
    flat = np.concatenate(rows)
    kept, counts = np.unique(flat, return_counts=True)
    kept = kept[counts >= LEAST_ROWS]
    copies = [(i, out, inn) for i, words in enumerate(texts) for out, inn in swaps(set(words), i)]
    kept = np.union1d(kept, np.concatenate([known[t] for _, out, inn in copies for t in out + inn]))
    number = np.full(SLOTS, -1, np.int64)
    number[kept] = np.arange(len(kept))
    at = number[flat]
    row = np.repeat(np.arange(n), [len(r) for r in rows])[at >= 0]
    at = at[at >= 0]
    k = len(kept)
    drawn = positive / n
    share = drawn if share is None else share
    weight = np.where(labels == 1, share / drawn, (1 - share) / (1 - drawn)) / n
    steps_of = [[(f, s) for t, s in [*((t, -1) for t in out), *((t, 1) for t in inn)] for f in number[known[t]]] for _, out, inn in copies]
    copy_at = np.array([f for c in steps_of for f, _ in c], np.int64)
    copy_sign = np.array([s for c in steps_of for _, s in c], float)
    copy_id = np.repeat(np.arange(len(copies)), [len(c) for c in steps_of])
    copy_row = np.array([i for i, *_ in copies])
    copy_weight = 1 / np.bincount(copy_row, minlength=n)[copy_row] / n
    sparse /= math.sqrt(n)
    w, bias = np.zeros(k), 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], n) + bias
        p, swapped = _sigmoid(z), _sigmoid(z[copy_row] + np.bincount(copy_id, w[copy_at] * copy_sign, len(copies)))
        before, after = (p * (1 - p))[copy_row], swapped * (1 - swapped)
        change = 2 * penalty * copy_weight * (swapped - p[copy_row])
        g = (p - labels) * weight + np.bincount(copy_row, change * (after - before), n)
        gw = np.bincount(at, g[row], k) + 2 * decay * w + np.bincount(copy_at, (change * after)[copy_id] * copy_sign, k)
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        pace = rate / (np.sqrt(v / c2) + 1e-4)
        w -= pace * (m / c1)
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
        bias -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return Model({int(f): float(x) for f, x in zip(kept, w) if x}, bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fold: F.Column, rows: int = FIT_ROWS, most: int = FIT_WORDS, **options) -> Model:
    """Fit on at most `rows` of each class of labels(doc_id, toxic) where fold holds: those of the smallest hashes of doc_id,
    as far as their words come to `most // 2`; so what the driver gets is bounded, and a text with more words isn't fitted on.

    A document labelled twice counts as toxic if one label says so; null labels are left out.
    """
    dealt = F.xxhash64("doc_id")
    known = labels.where(F.col("toxic").isNotNull() & fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    picked = known.where("toxic = 1").orderBy(dealt, "doc_id").limit(rows).unionByName(known.where("toxic <> 1").orderBy(dealt, "doc_id").limit(rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 x rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(tokens(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.string())), pa.array(map(len, sets), pa.int64())], names=["doc_id", "toxic", "words", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, f"doc_id {kind}, toxic int, words array<string>, n long")
    got = written(got, "labelled")
    so_far = F.sum("n").over(Window.partitionBy(F.col("toxic") == 1).orderBy(dealt, "doc_id"))  # rows of a class, some repeated, without their words
    fits = got.select("doc_id", "toxic", "n").where(F.col("n") <= most // 2).withColumn("so_far", so_far).where(F.col("so_far") <= most // 2).select("doc_id").distinct()
    took = got.join(F.broadcast(fits), "doc_id").select("doc_id", "toxic", "words").dropDuplicates(["doc_id", "words"]).orderBy(dealt, "doc_id", "words").select("toxic", "words").toArrow()
    return fit(took.column("words").to_pylist(), took.column("toxic").to_numpy(), share=share, **options)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row of docs; a null or empty text has no words and the bias for a score.

    Equal texts get equal scores, rows with the same id each a row; an empty table gives none; other
    columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(model.score, batch.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
