"""Language identification by hierarchical discrimination with linear SVMs.

First the language family is predicted (one linear SVM per family against the
rest), then, inside the family, one-versus-one linear SVMs between its languages
vote; ties go to the larger sum of margins.  Features are hashed counts of
character 1- to 3-grams of the lower-cased text (square roots, unit length), taken
over the whole text with numpy inside Arrow batches; long texts are counted in
chunks, never cut.

Training reads at most ``max_per_lang`` different labelled texts per language and
``max_rows`` in all (those of smallest hash; the bound is a parameter of ``train``;
copies count once, so a language of few texts in many copies is learned from all of them)
and fits on the driver; the model is languages^2 x ``DIM`` numbers at most and is
sent to the tasks once.  Prediction is one pass without a shuffle.

Defined cases: null text and texts without a letter are ``und`` with score 0; null
labels are not learned from; with one learned language that one is predicted, with
none every text is ``und``; repeated rows are predicted each; other columns pass
through ``predict`` untouched inside one struct, so names can't clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 1 << 13
_CHUNK = 1 << 18  # characters counted at once

# Families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi fo",
    "romance": "fr es it pt ro ca gl oc rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur mr gu pa ne si or as",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = re.compile(r"[^\W\d_]+")  # also numerals such as a half, which are no letters


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def has_letter(text: str | None) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _LETTERS.finditer(text or ""))


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted hashed n-gram counts; zero for an empty text."""
    counts = np.zeros(DIM)
    low = text.lower()
    for a in range(0, max(len(low), 1), _CHUNK):
        # two characters of overlap, so that no n-gram is lost at a chunk's end
        cp = np.frombuffer(low[max(0, a - 2):a + _CHUNK].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        new = min(a, 2)
        h1 = cp * np.uint64(0x9E3779B97F4A7C15)
        grams = [h1[new:]]
        if len(cp) > 1:
            h2 = (h1[:-1] ^ (h1[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
            grams.append(h2[max(0, new - 1):])
        if len(cp) > 2:
            h3 = (h2[:-1] ^ (h1[2:] >> np.uint64(11))) * np.uint64(0x165667B19E3779F9)
            grams.append(h3)
        for h in grams:
            counts += np.bincount((h >> np.uint64(64 - 13)).astype(np.int64), minlength=DIM)
    v = np.sqrt(counts)
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, passes: int = 30) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; the last weight is the bias.

    Both classes weigh the same in total.  Deterministic.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    n_pos, n_neg = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    cap = np.where(y > 0, c * len(y) / (2 * n_pos), c * len(y) / (2 * n_neg))
    alpha, w, q = np.zeros(len(y)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x)
    rng = np.random.RandomState(0)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cap[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


class Model:
    """families: {family: [languages]}; over: {family: w}; pairs: {(a, b): w}, a before b."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = sorted(set(langs))
        self.families = {}
        for lang in names:
            self.families.setdefault(family(lang), []).append(lang)
        lab, fam = np.array(langs, object), np.array([family(s) for s in langs], object)
        fams = list(self.families)
        self.over = {f: svm(x, np.where(fam == f, 1, -1)) for f in fams} if len(fams) > 1 else {}
        self.pairs = {}
        for group in self.families.values():
            for i, a in enumerate(group):
                for b in group[i + 1:]:
                    rows = (lab == a) | (lab == b)
                    self.pairs[a, b] = svm(x[rows], np.where(lab[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """Languages and scores (0.5 to 1: logistic of the deciding margins)."""
        if not self.families:
            return ["und"] * len(x), [0.0] * len(x)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        fams = list(self.families)
        sure = np.ones(len(x))
        if self.over:
            m = np.stack([x @ self.over[f] for f in fams], 1)
            pick = m.argmax(1)
            top = np.sort(m, 1)
            sure = 1 / (1 + np.exp(-np.clip(2 * (top[:, -1] - top[:, -2]), 0, 60)))
        else:
            pick = np.zeros(len(x), int)
        out, score = [None] * len(x), sure.copy()
        for k, f in enumerate(fams):
            rows, group = np.flatnonzero(pick == k), self.families[f]
            if not len(rows):
                continue
            votes, margin = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            for i, a in enumerate(group):
                for j in range(i + 1, len(group)):
                    m = x[rows] @ self.pairs[a, group[j]]
                    votes[:, i] += m > 0
                    votes[:, j] += m <= 0
                    margin[:, i] += m
                    margin[:, j] -= m
            best = (votes + 1e-3 * np.tanh(margin / max(1, len(group)))).argmax(1)
            for r, b in zip(rows, best):
                out[r] = group[b]
            if len(group) > 1:
                score[rows] *= 1 / (1 + np.exp(-np.clip(2 * margin[np.arange(len(rows)), best] / (len(group) - 1), -60, 60)))
        return out, np.clip(score, 0, 1).tolist()


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang",
          max_per_lang: int = 300, max_rows: int = 3000) -> Model:
    """Fit on a bounded sample of different labelled texts: per language those of smallest hash."""
    base = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "lang IS NOT NULL AND lang <> 'und' AND text RLIKE '[\\\\p{L}]'").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in base.select("lang", "h").distinct().groupBy("lang").count().limit(max_rows + 1).collect()}
    if len(counts) > max_rows:
        raise ValueError("more languages than max_rows")
    each = max(1, min(max_per_lang, max_rows // max(1, len(counts))))
    # A share of each language by hash first, so that only few rows are sorted; the rank then makes the bound exact.
    near = F.lit(False)
    for lang, n in counts.items():
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, 4 * each / n + 64 / n) * (1 << 30))))
    first = Window.partitionBy("lang").orderBy("h", F.length("text"))
    texts = base.where(near).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = texts.withColumn("k", F.row_number().over(first)).where(F.col("k") <= each)

    def vectors(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["lang", "x"])
    got = sample.select("lang", "text").mapInArrow(vectors, "lang string, x binary").toPandas()
    got = got.sort_values(["lang", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), DIM) if len(got) else np.zeros((0, DIM), np.float32)
    return Model(x, got["lang"].tolist())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score): ``row`` holds all columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column(0).field(at_text).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for a in range(0, len(texts), 512):
                at = [i for i in range(a, min(a + 512, len(texts))) if has_letter(texts[i])]
                if at:
                    p, s = m.predict(np.stack([features(texts[i]) for i in at]))
                    for i, x, y in zip(at, p, s):
                        lang[i], score[i] = x, y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["row", "lang_pred", "score"])

    at_text = docs.columns.index(text_col)
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
