"""Batch text embedding.

``embed`` runs an embedder inside an iterator pandas UDF: the model is built
once per Python worker and fed Arrow batches of ``batch_size`` texts, so the
batching/concurrency of the original per-service loops becomes Spark's task
parallelism.  The default embedder is offline feature hashing; a hosted or
ONNX model plugs in through the same two-method protocol.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclink.functions.templates import compose_text
from reclink.functions.vectors import blend, l2_normalize

# token pattern shared with the SQL oracle: runs of letters and digits
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# tokens whose bucket a worker remembers (some 25 MB); the frequent ones come first
_CACHED_TOKENS = 1 << 17


class HashingEmbedder:
    """Bag of lower-cased word tokens hashed into ``dim`` buckets (md5), L2-normalised.

    Deterministic, needs no model files; the bucket of a token is
    ``int(md5(token)[:8], 16) % dim``.
    """

    name = "hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self):
        import re
        # letters and digits: [^\W_] is the same class as [\p{L}\p{N}]
        self._findall = re.compile(r"[^\W_]+").findall
        self._cache: dict = {}
        # of the first 256 characters, those that are in no token become spaces
        self._apart = bytes(i if self._findall(chr(i)) else 32 for i in range(256))
        return self

    def _tokens(self, text: str) -> list:
        """Tokens of a lower-cased text; as Latin-1 bytes where they are all of those characters, which is faster."""
        try:
            return text.encode("latin-1").translate(self._apart).split()
        except UnicodeEncodeError:
            return self._findall(text)

    def _bucket(self, tok) -> int:
        text = tok.decode("latin-1") if isinstance(tok, bytes) else tok
        b = int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        if len(self._cache) < _CACHED_TOKENS:
            self._cache[tok] = b
        return b

    def __call__(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        known, bucket = self._cache.get, self._bucket
        for i, t in enumerate(texts):
            if t is None:
                continue
            tokens = self._tokens(t.lower())
            b = list(map(known, tokens))
            if None in b:
                b = [bucket(x) if c is None else c for x, c in zip(tokens, b)]
            if b:
                out[i] = np.bincount(b, minlength=self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return out / n


def embed(df: DataFrame, text_col, embedder=None, out_col: str = "vec", batch_size: int = 1000,
          partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = embedding of ``text_col`` (array<float>).

    Inference costs far more per row than moving the row: ``partitions`` spreads an
    input that is too coarsely split (e.g. one big unsplittable file).  Building
    the frame runs nothing and changes no setting; ``batch_size`` is what the model
    gets at once.
    """
    embedder = embedder or HashingEmbedder()
    if partitions:
        df = df.repartition(partitions)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for s in batches:
            out: list = []
            for a in range(0, len(s), batch_size):
                out.extend(model(s[a:a + batch_size].tolist()).astype(np.float32))
            yield pd.Series(out, dtype=object)

    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return df.withColumn(out_col, _embed(c))


def by_budget(sizes: list, most: int | None, budget: int | None) -> Iterator[tuple]:
    """(start, end) runs of at most ``most`` texts and ``budget`` tokens; a text beyond the budget goes alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and ((most and i - start >= most) or (budget and total + n > budget)):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def count_words(text) -> int:
    """Tokens of a text for a batch budget, where the model names no counter of its own."""
    return len(text.split()) if text else 0


def embed_distinct(df: DataFrame, text_col: str, embedder=None, out_col: str = "vec", batch_size: int = 1000,
                   batch_tokens: int | None = None, count_tokens=count_words, partitions: int | None = None) -> DataFrame:
    """E1 where texts repeat or a model limits tokens a request: every different text is embedded once.

    Texts are told apart by md5, spread over ``partitions`` tasks (default: the larger of
    the session's parallelism and its shuffle partitions) however the input is split, and
    packed into requests of at most ``batch_size`` texts and ``batch_tokens`` tokens.  The
    vectors are joined back to the rows; a text of many rows is a skewed join key, which
    AQE splits.  Null is a text of its own and goes to the model as null.  An existing
    ``out_col`` is replaced.
    """
    embedder = embedder or HashingEmbedder()
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for s in batches:
            texts, out = s.tolist(), []
            for a, b in by_budget([count_tokens(t) for t in texts], batch_size, batch_tokens):
                out.extend(model(texts[a:b]).astype(np.float32))
            yield pd.Series(out, dtype=object)

    key = F.coalesce(F.md5(F.col(text_col)), F.lit(""))
    vecs = (df.select(key.alias("_text_key"), F.col(text_col).alias("_text")).repartition(n, "_text_key")
              .dropDuplicates(["_text_key"]).select("_text_key", _embed("_text").alias("_vec")))
    rows = df.drop(out_col).withColumn("_row_key", key)
    return (rows.join(vecs, F.col("_row_key") == F.col("_text_key")).withColumnRenamed("_vec", out_col)
                .drop("_row_key", "_text_key"))


def embed_records(df: DataFrame, template, embedder=None, out_col: str = "vec", batch_size: int = 1000,
                  **cols) -> DataFrame:
    """Render each record with a template (e.g. an instruction prefix), then embed."""
    return embed(df.withColumn("_doc", compose_text(template, **cols)), "_doc", embedder, out_col,
                 batch_size).withColumnRenamed("_doc", "doc")


def blend_stores(a: DataFrame, b: DataFrame, wa: float = 0.2, wb: float = 0.8, *, key: str = "id",
                 vec: str = "vec") -> DataFrame:
    """Join two stores on id, blend the vectors, re-normalise."""
    from reclink.operators.relational import join_stores
    j = join_stores(a.select(key, vec), b.select(key, vec), key)
    return j.select(key, l2_normalize(blend(f"{vec}_a", f"{vec}_b", wa, wb)).alias(vec))


def normalize_store(store: DataFrame, vec: str = "vec") -> DataFrame:
    """Unit-length copy of a store."""
    return store.withColumn(vec, l2_normalize(vec))
