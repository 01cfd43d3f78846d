"""Training of fit_doc2vec in blocks of documents (F1): steps against plain Python, packing, passes."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import IllegalArgumentException

from reclink.operators import doc2vec
from reclink.operators import topics as tp


def plain(word, context, ids, doc, noise_w, rng, rates, window, negatives):
    """The same steps, one pair at a time."""
    starts = rng.permutation(np.arange(0, len(ids), doc2vec._STEP))
    mass = [sum(noise_w[:i + 1]) for i in range(len(noise_w))]
    for s, at in enumerate(starts):
        rate = rates[0] + (rates[1] - rates[0]) * s / len(starts)
        drawn = [next(i for i, m in enumerate(mass) if m > u * mass[-1]) for u in rng.random(doc2vec._SHARED)]
        old, sums, weights = [m.tolist() for m in (word, context)], [np.zeros_like(m) for m in (word, context)], np.zeros((2, len(word)))
        for i in range(at, min(at + doc2vec._STEP, len(ids))):
            for j in range(max(i - window, 0), min(i + window + 1, len(ids))):
                if i == j or doc[i] != doc[j]:
                    continue
                c = ids[i]
                weights[0][c] += 1
                for o, label, weight in [(ids[j], 1.0, 1.0)] + [(d, 0.0, negatives / doc2vec._SHARED) for d in drawn]:
                    g = weight * (label - 1 / (1 + math.exp(-sum(x * y for x, y in zip(old[0][c], old[1][o])))))
                    weights[1][o] += weight
                    sums[0][c] += g * np.array(old[1][o])
                    sums[1][o] += g * np.array(old[0][c])
        for m, total, n in zip((word, context), sums, weights):
            m += rate * total / np.sqrt(np.maximum(n, 1))[:, None]


@pytest.mark.parametrize("window", [1, 5])
def test_steps_equal_plain_python(monkeypatch, window):
    """Several steps, the last one short; a frequent term; documents of one token and of several steps."""
    monkeypatch.setattr(doc2vec, "_STEP", 32)
    monkeypatch.setattr(doc2vec, "_SHARED", 4)
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(107) < 0.4, 3, rng.integers(0, 9, 107))
    doc = np.repeat([0, 1, 2, 3, 4], [1, 6, 70, 2, 28])
    word, context = rng.normal(size=(2, 9, 3)).astype(np.float32)
    w, c, noise_w = word.astype(float), context.astype(float), rng.random(9)
    plain(w, c, ids, doc, noise_w, np.random.default_rng(1), (0.05, 0.01), window, 5)
    doc2vec.train(word, context, ids, doc, noise_w, np.random.default_rng(1), (0.05, 0.01), window, 5)
    assert np.allclose(word, w, atol=1e-4) and np.allclose(context, c, atol=1e-4)


def test_blocks_hold_every_token_in_order(spark, monkeypatch):
    """Texts stay whole, but for those beyond two blocks; null texts and tokens are left out."""
    rng = random.Random(4)
    texts = [[rng.choice("uvwxyz") if rng.random() < 0.9 else None for _ in range(n)] for n in (3, 0, 9, 70, 1, 8, 14, 2)]
    rows = [(t,) for t in texts[:4]] + [(None,)] + [(t,) for t in texts[4:]]
    df = spark.createDataFrame(rows, "tokens array<string>").coalesce(1)
    batches = df.toArrow().to_batches(max_chunksize=3)
    monkeypatch.setattr(doc2vec, "_BLOCK", 10)
    monkeypatch.setattr(doc2vec, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 1})())}))
    out = [b.to_pylist()[0] for b in doc2vec.pack(batches)]
    got, pieces = [], []
    for b in out:
        codes, ends = np.frombuffer(b["codes"], np.int32), np.frombuffer(b["ends"], np.int64)
        assert len(codes) == ends[-1] <= 20 and np.bincount(codes).tolist() == b["n"] and len(set(b["terms"])) == len(b["terms"])
        got += [b["terms"][i] for i in codes]
        pieces += [x for x in np.diff(ends, prepend=0).tolist() if x]
    known = [[x for x in t if x] for t in texts]
    assert got == [x for t in known for x in t] and len({b["block"] for b in out}) == len(out)
    cut = len(known[3])
    want = [len(t) for t in known if t]
    assert [x for x in pieces if x in want] and sum(pieces) == sum(want) and len(pieces) <= len(want) + cut // 20 + 1


def test_documents_are_not_trained_by_one_loop_of_the_library(spark, monkeypatch):
    """Spark ML's trainer took most of saved_model's time; it now sees one row, and all documents train in blocks."""
    rng = random.Random(1)
    words = [[f"{g}{i}" for i in range(20)] for g in "abc"]
    docs = spark.createDataFrame([(i, rng.choices(words[i % 3], k=60) + ["rare"] * (i < 9)) for i in range(150)], "id long, tokens array<string>")
    fitted, fit = [], tp.Word2Vec.fit
    monkeypatch.setattr(tp.Word2Vec, "fit", lambda self, data: fitted.append(data.count()) or fit(self, data))
    monkeypatch.setattr(doc2vec, "_BLOCK", 2_000)
    model = tp.fit_doc2vec(docs, dim=7, passes=30)
    assert fitted == [1] and isinstance(model, tp.Word2VecModel)
    assert (model.getVectorSize(), model.getMinCount(), model.getMaxIter(), model.getInputCol()) == (7, tp.DOC2VEC_MIN_COUNT, 30, "tokens")
    vecs = {r["word"]: np.array(r["vector"]) for r in model.getVectors().collect()}
    assert set(vecs) == {w for g in words for w in g}  # "rare" occurs 9 times
    unit = {w: v / np.linalg.norm(v) for w, v in vecs.items()}
    for a in unit:  # the 19 nearest of a word are those of its group
        assert {b[0] for b in sorted(unit, key=lambda b: -unit[a] @ unit[b])[:20]} == {a[0]}
    one = doc2vec.word_vectors(docs, "tokens", 7, 10, 42, 1).collect()
    assert sorted(one) == sorted(doc2vec.word_vectors(docs, "tokens", 7, 10, 42, 1).collect())


def test_no_term_is_an_error_as_before(spark):
    docs = spark.createDataFrame([(["once"],), ([],)], "tokens array<string>")
    with pytest.raises(IllegalArgumentException, match="vocabulary"):
        tp.fit_doc2vec(docs, dim=4, passes=1)
