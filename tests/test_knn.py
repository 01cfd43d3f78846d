"""kNN join equals brute force (K1/K2/K4), LSH recall floor (K5), single query (K3)."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reclink.operators.knn import knn_join, knn_lsh, nearest


def brute(q, s, k, metric="l2sq", exclude_self=False, q_key=None, s_key=None):
    out = []
    for i, qv in enumerate(q):
        rows = []
        for j, sv in enumerate(s):
            if exclude_self and i == j:
                continue
            if q_key is not None and q_key[i] != s_key[j]:
                continue
            a, b = np.asarray(qv, float), np.asarray(sv, float)
            if metric == "l2sq":
                d = float(((a - b) ** 2).sum())
            elif metric == "dot":
                d = -float(a @ b)
            else:
                d = 1 - float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b))
            rows.append((round(d, 9), j, d))
        rows.sort()
        out += [(i, j, r + 1) for r, (_, j, _) in enumerate(rows[:k])]
    return sorted(out)


def frame(spark, vecs, keys=None):
    pdf = pd.DataFrame({"id": np.arange(len(vecs), dtype=np.int64), "vec": [list(map(float, v)) for v in vecs]})
    if keys is not None:
        pdf["grp"] = keys
    return spark.createDataFrame(pdf)


def got(df):
    return sorted((r.qid, r.sid, r.rank) for r in df.select("qid", "sid", "rank").collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
def test_knn_matches_bruteforce_with_split_blocks(spark, metric):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(37, 5))
    s = rng.normal(size=(53, 5))
    # tiny block sizes force several store blocks, i.e. the window merge path
    r = knn_join(frame(spark, q), frame(spark, s), 4, metric=metric, q_block_rows=8, s_block_rows=7)
    assert got(r) == brute(q, s, 4, metric)


def test_knn_exclude_self_and_hot_key(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    keys = ["hot"] * 40 + ["a"] * 12 + ["b"] * 8  # one key holds two thirds of the rows
    df = frame(spark, v, keys)
    r = knn_join(df, df, 3, on=["grp"], exclude_self=True, q_block_rows=5, s_block_rows=6)
    assert got(r) == brute(v, v, 3, exclude_self=True, q_key=keys, s_key=keys)


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=30), st.integers(min_value=1, max_value=30),
       st.integers(min_value=1, max_value=6), st.integers(min_value=0, max_value=10_000))
def test_knn_property(spark, nq, ns, k, seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(-3, 4, size=(nq, 3)).astype(float)  # integer grid: many exact ties
    s = rng.integers(-3, 4, size=(ns, 3)).astype(float)
    r = knn_join(frame(spark, q), frame(spark, s), k, q_block_rows=4, s_block_rows=5)
    assert got(r) == brute(q, s, k)


def test_nearest_single_query(spark):
    rng = np.random.default_rng(11)
    s = rng.normal(size=(40, 6))
    r = nearest(frame(spark, s), list(s[3]), 5)
    assert [row.sid for row in r.orderBy("rank").collect()] == [j for _, j, _ in brute([s[3]], s, 5)]
    assert nearest(frame(spark, s), None, 5).count() == 0


def test_lsh_recall_floor(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(10, 8)) * 5
    v = np.concatenate([c + rng.normal(size=(30, 8)) * 0.3 for c in centers])
    df = frame(spark, v)
    exact = set((a, b) for a, b, _ in brute(v, v, 5, exclude_self=True))
    approx = knn_lsh(df, df, 5, dim=8, tables=6, bits=4, exclude_self=True)
    pairs = set((r.qid, r.sid) for r in approx.collect())
    recall = len(pairs & exact) / len(exact)
    assert recall >= 0.8
    assert approx.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5


def test_large_norms_stay_exact(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1, 16)) * 5e5 + rng.normal(size=(200, 16))
    got = set((r.qid, r.sid) for r in knn_join(frame(spark, v), frame(spark, v), 5, exclude_self=True, q_block_rows=64, s_block_rows=64).collect())
    assert got == set((a, b) for a, b, _ in brute(v, v, 5, exclude_self=True))


def test_identical_vectors_are_cut_before_scoring():
    import pandas as pd
    from reclink.operators.knn import _distinct_rows
    rows = pd.DataFrame({"_sid": list(range(99, -1, -1)), "_svec": [[1.0, 2.0]] * 50 + [[3.0, 4.0]] * 50})
    kept = _distinct_rows(rows, 3)
    assert kept["_sid"].tolist() == [0, 1, 2, 50, 51, 52]


def test_nearest_odd_vectors(spark):
    s = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0]), ("d", None)], "id string, vec array<double>")
    got = [(r.sid, r.dist) for r in nearest(s, [1.0, 0.0], 5, metric="cosine").collect()]
    assert got == [("b", 0.0), ("a", 1.0)]
    none = nearest(s, None, 5)
    assert none.count() == 0 and none.schema["sid"].dataType.simpleString() == "string"


def test_cells_meet_in_every_partition(spark):
    # with all shuffle partitions kept apart, a cell whose two sides hash differently would be lost
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 6))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = frame(spark, v)
        got = set((r.qid, r.sid) for r in knn_join(df, df, 4, exclude_self=True, q_block_rows=40, s_block_rows=50).collect())
        keyed = df.withColumn("g", F.lit("one"))
        by_key = set((r.qid, r.sid) for r in knn_join(keyed, keyed, 4, on=["g"], exclude_self=True, q_block_rows=40, s_block_rows=50).collect())
    finally:
        spark.conf.set(key, "true")
    want = set((a, b) for a, b, _ in brute(v, v, 4, exclude_self=True))
    assert got == want and by_key == want


def test_small_blocks_do_not_copy_tables_for_every_hundred_rows(spark):
    from reclink.operators.knn import _blocks, _grid_cells
    assert [_blocks(n, 100, 32_768) for n in (0, 100, 101, 1600, 100_000, 1_000_000)] == [1, 1, 2, 16, 16, 31]
    side = spark.range(5000)
    q, s, merge = _grid_cells(spark, side.withColumnRenamed("id", "_qid"), side.withColumnRenamed("id", "_sid"), [], 96, 120, 4, enough=32_768)
    assert q.count() == s.count() == 16 * 5000 and merge


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
def test_tiles_of_a_cell_equal_bruteforce(monkeypatch, metric):
    from reclink.operators import knn
    monkeypatch.setattr(knn, "_TILE_QUERIES", 7)
    monkeypatch.setattr(knn, "_TILE_STORE", 9)
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, size=(60, 3)).astype(float) + [0.5, 0, 0]  # many ties
    table = lambda side: pd.DataFrame({f"_{side}id": range(60), f"_{side}vec": list(v)})
    for k in (1, 4, 70):
        r = knn._cell_topk(table("q"), table("s"), k=k, metric=metric, exclude_self=True, decimals=9, q_carry=[], s_carry=[],
                           out_cols=["qid", "sid", "rank", "dist"])
        if k == 70:  # of equal vectors only k + 1 are kept, here all
            assert len(r) == 60 * 59
        assert sorted(zip(*(r[c].tolist() for c in ("qid", "sid", "rank")))) == brute(v, v, k, metric, exclude_self=True)


def test_a_cell_stays_small():
    import tracemalloc
    from reclink.operators import knn
    n, dim = knn._SIDE_BYTES // (8 * 64) // 4, 64
    v = np.random.default_rng(0).normal(size=(n, dim)).astype(np.float32)
    table = lambda side: pd.DataFrame({f"_{side}id": range(n), f"_{side}vec": list(v)})
    tracemalloc.start()
    knn._cell_topk(table("q"), table("s"), k=5, metric="l2sq", exclude_self=True, decimals=9, q_carry=[], s_carry=[],
                           out_cols=["qid", "sid", "rank", "dist"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert knn._SIDE_BYTES <= 16 << 20 and peak < 64 << 20


def test_probes_are_numbers_not_objects():
    from reclink.operators.knn import _by_margin, _probed, sign_planes
    planes = sign_planes(8, 2, 3)
    vecs = pd.Series(list(np.random.default_rng(0).normal(size=(20, 8))))
    got = _probed(planes, 5).func(vecs)
    table, bucket = _by_margin(planes, vecs)
    assert all(isinstance(r, np.ndarray) and (r // 8 == t[:5]).all() and (r % 8 == b[:5]).all() for r, t, b in zip(got, table, bucket))
