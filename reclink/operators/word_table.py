"""Spark ML's Word2VecModel with its vectors in a table (S14): none of them is on the driver.

The library's model holds every word and vector on the driver, once more as doubles for a broadcast, and once more for
each loaded copy.  Here the vectors stay the Parquet table of the saved form (word, vector), which is the library's own,
so either reads what the other wrote.  ``transform`` packs rows into blocks of about ``_BLOCK`` tokens, joins the terms of
each block with their vectors, and adds a row's vectors up in the order of its tokens, as the library does.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclink.session import materialize, scratch_path, shuffles_freed

_BLOCK, _TOGETHER = 1 << 21, 1 << 16  # tokens of a block, and those whose vectors are added up at once


def one_word(spark: SparkSession, tokens: str, min_count: int) -> DataFrame:
    """The least input that Word2Vec fits; a model of it has the parameters, its only vector is not used."""
    return spark.range(1).select(F.array_repeat(F.lit(""), max(min_count, 1)).alias(tokens))


class _Writer(MLWriter):
    def __init__(self, model: TableWord2VecModel):
        super().__init__()
        self.model = model

    def save(self, path: str) -> None:
        if self.shouldOverwrite and path.rstrip("/") == self.model.path.rstrip("/"):  # over itself
            copy = scratch_path(self.sparkSession, f"word2vec-{uuid.uuid4().hex}")
            self.model.vectors().write.parquet(f"{copy}/data")
            self.model.path = copy
        super().save(path)

    def saveImpl(self, path: str) -> None:
        self.model._to_java().write().save(path)
        self.model.vectors().write.mode("overwrite").parquet(f"{path}/data")


class TableWord2VecModel(Word2VecModel):
    """A Word2VecModel over the table ``path``/data."""

    def __init__(self, model: Word2VecModel, path: str):
        super().__init__(model._java_obj.copy(model._empty_java_param_map()))
        model._copyValues(self)
        self.path = path

    def vectors(self) -> DataFrame:
        return SparkSession.active().read.schema("word string, vector array<float>").parquet(f"{self.path}/data")

    def getVectors(self) -> DataFrame:
        return self.vectors().select("word", array_to_vector("vector").alias("vector"))

    def findSynonyms(self, word, num: int) -> DataFrame:
        if num <= 0:
            raise ValueError("Number of similar words should > 0")
        to, others = word, self.vectors()
        if isinstance(word, str):
            row = others.where(F.col("word") == word).first()
            if row is None:
                raise ValueError(f"{word} not in vocabulary")
            to, others = row["vector"], others.where(F.col("word") != word)
        to = np.array(to.toArray() if hasattr(to, "toArray") else to, float)
        norm = float(np.sqrt(to @ to))
        both = F.transform("vector", lambda x: x.cast("double"))
        dot = F.aggregate(F.zip_with(both, F.array(*map(F.lit, (to / (norm or 1.0)).tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        size = F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x))
        return others.select("word", F.when(size > 0, dot / size).otherwise(0.0).alias("similarity")).orderBy(F.col("similarity").desc()).limit(num)

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    def transform(self, dataset: DataFrame, params: dict | None = None) -> DataFrame:
        return self.copy(params)._transform(dataset) if params else self._transform(dataset)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows with the mean vector of their tokens; words without a vector count as zero, null or empty lists are zero."""
        spark, dim, tokens, out = dataset.sparkSession, self.getVectorSize(), self.getInputCol(), self.getOutputCol()
        at = dataset.columns.index(tokens)
        with shuffles_freed(spark):
            blocks = materialize(dataset.mapInArrow(lambda batches: _pack(batches, at), "block long, rows binary, terms array<string>"))
        n = blocks.count()
        terms = blocks.select(F.col("block").alias("nblock"), F.posexplode("terms").alias("place", "word"))
        needs = terms.join(self.vectors(), "word").select("nblock", "place", "vector")

        def means(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = []
            for rows in left.column("rows"):
                with pa.ipc.open_stream(rows.as_buffer()) as found:
                    table = found.read_all().combine_chunks()
                m = _means(table.column(at).chunk(0), right, dim)
                ends = pa.array(np.arange(len(m) + 1) * dim, pa.int32())
                parts.append(table.append_column("_mean", pa.ListArray.from_arrays(ends, pa.array(m.ravel()))))
            return pa.concat_tables(parts)
        schema = T.StructType([*dataset.schema.fields, T.StructField("_mean", T.ArrayType(T.DoubleType()))])
        if not n:
            return dataset.withColumn(out, array_to_vector(F.array().cast("array<double>")))
        found = (blocks.select("block", "rows").repartition(4 * n, "block").groupBy("block")
                 .cogroup(needs.repartition(4 * n, "nblock").groupBy("nblock")).applyInArrow(means, schema))
        return found.withColumn("_mean", array_to_vector("_mean")).withColumnRenamed("_mean", out)


def _lists(column) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(batches, at: int):
    """Batches of rows -> rows of (block, the rows as an Arrow stream, the terms of column ``at``), cut every ``_BLOCK`` tokens."""
    first, made = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        total = np.cumsum(_lists(b.column(at))[1])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(_BLOCK, total[-1] + 1, _BLOCK)) + 1, [b.num_rows]])) if b.num_rows else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            part, sink = b.slice(i, j - i), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(part)
            words = _lists(part.column(at))[0].drop_null().dictionary_encode().dictionary
            terms = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            yield pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), terms],
                                             names=["block", "rows", "terms"])
            made += 1


def _means(lists: pa.Array, right: pa.Table, dim: int) -> np.ndarray:
    """Mean vector of each list; ``right`` has the places of the known terms and their vectors."""
    words, sizes = _lists(lists)
    row, known = np.repeat(np.arange(len(sizes)), sizes), words.is_valid().to_numpy(zero_copy_only=False)
    encoded = words.drop_null().dictionary_encode()
    place = right.column("place").to_numpy()
    vectors = right.column("vector").combine_chunks()
    at = np.full(len(encoded.dictionary), -1)
    at[place] = np.arange(len(place))
    vectors = (vectors.flatten() if len(place) else pa.array([], pa.float32())).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ids, row = at[encoded.indices.to_numpy()], row[known]
    ids, row = ids[ids >= 0], row[ids >= 0]
    out = np.zeros((len(sizes), dim))
    for i in range(0, len(ids), _TOGETHER):
        v, r = vectors[ids[i:i + _TOGETHER]].astype(np.float64), row[i:i + _TOGETHER]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        v[0] += out[r[0]]  # a list that began in the rows before
        out[r[starts]] = np.add.reduceat(v, starts)
    return out * (1.0 / np.maximum(sizes, 1))[:, None]


def load(spark: SparkSession, path: str) -> TableWord2VecModel:
    """A saved Word2VecModel, this module's or the library's; only its parameters are read."""
    meta = DefaultParamsReader.loadMetadata(path, spark)
    params = {**meta["defaultParamMap"], **meta["paramMap"]}
    w2v = Word2Vec(**params)
    model = TableWord2VecModel(w2v.fit(one_word(spark, w2v.getInputCol(), w2v.getMinCount())), path)
    DefaultParamsReader.getAndSetParams(model, meta)
    return model._resetUid(meta["uid"])
