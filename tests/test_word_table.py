"""Word2VecModel over a table (F4): the same vectors as Spark ML's model, and none on the driver."""

import tempfile

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec, Word2VecModel

from reclink.operators import topics as tp
from reclink.operators import word_table


def docs_of(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, [words[j] if j < 40 else None for j in rng.integers(0, 41, n)] + ["rare"] * (i == 2)) for i, n in enumerate([0, 1, 700, 30, 2, 90] * 5)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.fixture
def saved(spark):
    """A model that Spark ML fitted and saved."""
    docs = docs_of(spark)
    model = Word2Vec(vectorSize=5, minCount=6, seed=1, inputCol="tokens", outputCol="_dv").fit(docs.selectExpr("id", "filter(tokens, x -> x is not null) tokens"))
    path = tempfile.mkdtemp(prefix="reclink-w2v-") + "/m"
    model.save(path)
    return docs, model, path


def rows_of(df):
    return sorted((r["id"], r["tokens"], r["_dv"].toArray().tolist()) for r in df.collect())


def test_vectors_equal_those_of_the_library(spark, saved, monkeypatch):
    docs, model, path = saved
    want = rows_of(model.transform(docs))
    for block, together in ((1 << 20, 1 << 16), (50, 7)):
        monkeypatch.setattr(word_table, "_BLOCK", block)
        monkeypatch.setattr(word_table, "_TOGETHER", together)
        again = tp.load_model(Word2VecModel, path)
        assert isinstance(again, Word2VecModel) and again.uid == model.uid and again.extractParamMap().keys() == model.extractParamMap().keys()
        assert (again.getVectorSize(), again.getMinCount(), again.getOutputCol()) == (5, 6, "_dv")
        assert rows_of(again.transform(docs)) == want
    near = again.findSynonyms("w1", 4).collect()
    assert [(r["word"], pytest.approx(r["similarity"], abs=1e-5)) for r in model.findSynonyms("w1", 4).collect()] == [(r["word"], r["similarity"]) for r in near]
    assert again.transform(docs.where("id < 0")).count() == 0
    null = again.transform(spark.createDataFrame([(1, None)], "id long, tokens array<string>")).collect()
    assert null[0]["_dv"].toArray().tolist() == [0.0] * 5


def test_saved_form_is_the_library_s(spark, saved):
    docs, model, path = saved
    again, other = tp.load_model(Word2VecModel, path), tempfile.mkdtemp(prefix="reclink-w2v-") + "/n"
    tp.save_model(again, other)
    tp.save_model(again, path)  # over itself
    want = rows_of(model.transform(docs))
    for p in (other, path):
        assert rows_of(Word2VecModel.load(p).transform(docs)) == want == rows_of(tp.load_model(Word2VecModel, p).transform(docs))
    assert rows_of(again.transform(docs)) == want


def test_no_vector_is_on_the_driver(spark):
    """the library's model holds all words and vectors on the driver, once a copy."""
    docs = docs_of(spark)
    model, path = tp.fit_doc2vec(docs, dim=6, passes=1), tempfile.mkdtemp(prefix="reclink-w2v-") + "/m"
    tp.save_model(model, path)
    for m in (model, tp.load_model(Word2VecModel, path)):
        assert m._java_obj.getVectors().count() == 1 and m.getVectors().count() == 40
    a, b = (sorted((r["id"], r["vec"]) for r in tp.doc_vectors(docs, m).collect()) for m in (model, tp.load_model(Word2VecModel, path)))
    assert a == b and len(a) == 30 and any(any(v) for _, v in a)
