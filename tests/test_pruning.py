"""Pruned and multi-probe kNN against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reclink.operators.knn import calibrate_probes, knn_join, knn_multiprobe, sign_planes
from reclink.operators.pivots import distances, fit_pivots, knn_pruned

SCHEMA = "id long, vec array<double>"


def brute(queries, store, k, exclude_self=False):
    out = {}
    for qid, q in queries:
        near = sorted((round(float(((np.array(q) - np.array(v)) ** 2).sum()), 9), sid) for sid, v in store
                      if not (exclude_self and sid == qid))
        out[qid] = [sid for _, sid in near[:k]]
    return out


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append(r.sid)
    return out


def clusters(n, groups, dim=8, spread=0.2, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 10
    return [(i, (centres[i % groups] + rng.normal(size=dim) * spread).tolist()) for i in range(n)]


def test_clusters_are_pruned_and_nothing_is_lost(spark):
    rows = clusters(900, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    pj = knn_pruned(df, df, 5, exclude_self=True, pivots=30)
    assert lists(pj.hits) == brute(rows, rows, 5, True)
    v = pj.visits.agg(F.sum("candidates").alias("c"), F.sum("store").alias("s"), F.count("qid").alias("n")).first()
    assert v.n == 900 and v.c < 0.2 * v.s


def test_hot_cell_of_copies_and_neighbours_across_cells(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0]) for i in range(300)]                                # a third are copies: split into blocks
    rows += [(1000 + i, [float(x) for x in rng.uniform(-2, 2, 2)]) for i in range(600)]   # no gaps between cells
    df = spark.createDataFrame(rows, SCHEMA)
    pj = knn_pruned(df, df, 7, pivots=20, q_block_rows=50, s_block_rows=50)
    assert lists(pj.hits) == brute(rows, rows, 7)


def test_fewer_stored_rows_than_k_and_odd_vectors(spark):
    good = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 9.0])]
    odd = [(4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [None, 1.0])]
    df = spark.createDataFrame(good + odd, SCHEMA)
    assert lists(knn_pruned(df, df, 5).hits) == brute(good, good, 5)
    none = df.where("id > 100")
    for q, s in ((df, none), (none, df), (none, none), (df, df.where("id = 4"))):
        pj = knn_pruned(q, s, 5)
        assert pj.hits.count() == 0 and pj.hits.columns == ["qid", "sid", "rank", "dist"]
    with pytest.raises(ValueError):
        knn_pruned(df, df, 0)


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b")], SCHEMA + ", tag string")
    r = knn_pruned(df.withColumnRenamed("tag", "q"), df.withColumnRenamed("tag", "s"), 1, exclude_self=True, q_carry=("q",), s_carry=("s",))
    assert sorted(map(tuple, r.hits.select("qid", "q", "s").collect())) == [(1, "a", "b"), (2, "b", "a")]


def test_pivots_of_copies():
    same = np.ones((50, 3))
    assert len(fit_pivots(same, 8)) == 1
    assert distances(same, fit_pivots(same, 8)).max() == 0


def test_multiprobe_recall_and_share(spark):
    rows = clusters(1200, 24, dim=16, spread=0.5, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = brute(rows, rows, 10, True)
    planes = sign_planes(16, 1, 6)
    probes = calibrate_probes(df, df, 10, planes, exclude_self=True)
    got = lists(knn_multiprobe(df, df, 10, dim=16, probes=probes, exclude_self=True))
    found = sum(len(set(got.get(q, [])) & set(e)) for q, e in exact.items())
    assert found >= 0.9 * sum(map(len, exact.values()))
    assert probes < 32                                   # under half of the buckets on clustered data


def test_every_bucket_probed_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for tables in (1, 2):
        got = lists(knn_multiprobe(df, df, 4, dim=8, tables=tables, bits=3, probes=8 * tables, exclude_self=True))
        assert got == brute(rows, rows, 4, True)
    assert lists(knn_join(df, df, 4, exclude_self=True)) == got
    assert calibrate_probes(df.limit(0), df, 4, sign_planes(8, 1, 3)) == 1
