r"""Toxicity scores by a factorization machine over hashed terms.

    logit(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

Terms are the lower-cased words (runs of letters) of a text and the proper beginnings
of 4 to 8 letters of longer words (``achl|ich...``), so that compounds of a word count
with it; each is hashed to one of ``DIM`` places.  x_i is log(1 + count) over the whole
text, not divided by its length: one insult in a long text weighs what it weighs in a
short one.  The pairwise part is what an additive model lacks: an insult *with* a group
mention, or the same insult twice.

*Terms kept.*  Of the sample, every place's documents are counted by label, and the
``max_terms`` places with the largest chi-square (at least ``min_chi2``) are the model's
terms; all others have no weight, so that a long clean text gathers none by chance.

*Bounds.*  Training reads at most ``max_per_class`` different texts of each label, those
of smallest hash (a documented bound; labels are counted in full, and the sample's rows
weigh so that classes keep their shares).  The ids wanted are at most a few times that
many, so texts of other rows never move.  The model is ``max_terms`` x (2 + rank) numbers
and is sent to the tasks once; scoring is one pass without a shuffle.

Defined cases: null and empty texts and texts without a letter hold no term and get the
score of the bias; null labels teach nothing; of several labels of one id the largest
counts; rows of one id are scored each; with one label or none in the training rows the
score is that label's smoothed share, or 0 without labels; very long texts are counted
in pieces cut between words; other columns are ignored and can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import stored

DIM = 1 << 20
PREFIXES = range(4, 9)
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 20  # characters taken apart at once
_CACHE = 400_000  # words remembered by a worker


def places(word: str) -> list[int]:
    """Hashed places of a word and of its proper beginnings."""
    terms = [word] + [word[:k] + "\0" for k in PREFIXES if k < len(word)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % DIM for t in terms]


def word_counts(text: str | None) -> Counter:
    """Counts of the lower-cased words of a whole text."""
    out, text, a = Counter(), text or "", 0
    while a < len(text):
        b = min(len(text), a + _PIECE)
        while b < len(text) and text[b].isalpha():
            b += 1
        out.update(_WORD.findall(text[a:b].lower()))
        a = b
    return out


def counted(text: str | None) -> dict[int, int]:
    """{place: count} of a text."""
    out: dict[int, int] = {}
    for w, c in word_counts(text).items():
        for p in places(w):
            out[p] = out.get(p, 0) + c
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """terms: {place: column}; b, w (n), v (n, rank)."""

    def __init__(self, terms: list[int], b: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.b, self.w, self.v = {p: i for i, p in enumerate(terms)}, b, w, v
        self.known: dict[str, tuple] = {}

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Rows of log counts -> logits, pairs by the sum-of-squares identity."""
        return self.b + x @ self.w + 0.5 * (np.square(x @ self.v) - np.square(x) @ np.square(self.v)).sum(1)

    def columns(self, word: str) -> tuple:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= _CACHE:
                self.known = {}
            got = self.known[word] = tuple(self.terms[p] for p in places(word) if p in self.terms)
        return got

    def row(self, text: str | None) -> np.ndarray:
        counts = np.zeros(len(self.terms))
        for w, c in word_counts(text).items():
            for i in self.columns(w):
                counts[i] += c
        return np.log1p(counts)

    def scores(self, texts: list) -> np.ndarray:
        return _sigmoid(self.logit(np.stack([self.row(t) for t in texts]))) if texts else np.zeros(0)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: int = 8, steps: int = 400, rate: float = 0.05,
        l2: float = 1e-4, seed: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss with weighted rows by Adam on full batches; deterministic."""
    n = x.shape[1]
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(n), np.random.RandomState(seed).normal(0, 0.05, (n, rank))]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    weight, square = weight / weight.sum(), np.square(x)
    for t in range(1, steps + 1):
        b, w, v = theta
        xv = x @ v
        z = b[0] + x @ w + 0.5 * (np.square(xv) - square @ np.square(v)).sum(1)
        g = weight * (_sigmoid(z) - y)
        grads = [np.array([g.sum()]), x.T @ g + l2 * w, x.T @ (g[:, None] * xv) - (square.T @ g)[:, None] * v + l2 * v]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * np.square(d)
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_per_class: int = 4000, max_terms: int = 1024, min_chi2: float = 12.0, rank: int = 8) -> Model:
    """Fit on labelled documents (rows of ``docs`` whose id ``labels`` marks 0 or 1)."""
    spark = docs.sparkSession
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("lid"))
             .agg(F.max((F.col(label_col) > 0).cast("int")).alias("y")).withColumn("h", F.xxhash64("lid")))
    held = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    # A share of each class by hash, about three times the ids wanted; the ranks below make the bound exact.
    near = F.lit(False)
    for y, n in held.items():
        near = near | ((F.col("y") == y) & (F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, (3 * max_per_class + 64) / n) * (1 << 30))))
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(F.broadcast(marks.where(near).select("lid", "y", "h")), F.col("id") == F.col("lid")))
    by = Window.partitionBy("y").orderBy("th")
    sample = (texts.withColumn("th", F.xxhash64("text")).groupBy("y", "th").agg(F.min("text").alias("text"))
              .withColumn("k", F.row_number().over(by)).where(F.col("k") <= max_per_class).select("y", "k", "text"))

    def terms(batches):
        for b in batches:
            for y, k, text in zip(*(b.column(c).to_pylist() for c in ("y", "k", "text"))):
                got = counted(text)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(got), pa.int32()), pa.array([k] * len(got), pa.int32()),
                                                      pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.int64())], names=["y", "k", "place", "n"])
    sample = stored(sample, "labelled")
    held_terms = stored(sample.mapInArrow(terms, "y int, k int, place int, n long"), "terms")
    rows = sample.select("y", "k").orderBy("y", "k").toPandas()  # at most 2 x max_per_class rows
    y = rows["y"].to_numpy(np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        b = 0.0 if not len(y) else np.log((n1 + 0.5) / (n0 + 0.5))
        return Model([], b if len(y) else -60.0, np.zeros(0), np.zeros((0, rank)))
    # chi-square of (place occurs, label), over the sample
    a, b = F.col("pos"), F.col("neg")
    chi2 = (n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (F.greatest((a + b) * (n1 + n0 - a - b), F.lit(1e-9)) * n1 * n0)
    best = (held_terms.groupBy("place").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.sum(1.0 - F.col("y")).alias("neg"))
            .withColumn("chi2", chi2).where(F.col("chi2") >= min_chi2).orderBy(F.desc("chi2"), "place").limit(max_terms)
            .select("place").collect())
    kept = sorted(r["place"] for r in best)
    places_df = spark.createDataFrame([(p, i) for i, p in enumerate(kept)], "place int, at int")
    cells = held_terms.join(F.broadcast(places_df), "place").select("y", "k", "at", "n").toPandas()  # within the sample's rows x max_terms
    x = np.zeros((len(rows), len(kept)))
    nr = {key: i for i, key in enumerate(zip(rows["y"].tolist(), rows["k"].tolist()))}
    x[[nr[key] for key in zip(cells["y"].tolist(), cells["k"].tolist())], cells["at"].to_numpy()] = np.log1p(cells["n"].to_numpy())
    weight = np.where(y > 0, held[1] / n1, held[0] / n0)
    return Model(kept, *fit(x, y, weight, rank))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for a in range(0, len(texts), 512):
                out.append(m.scores(texts[a:a + 512]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
            .select(F.col("id").alias(id_col), "score"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
