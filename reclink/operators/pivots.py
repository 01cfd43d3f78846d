"""Exact kNN join with metric pruning (K1/K4 where vectors form clusters).

The store is cut into the cells of a bounded set of pivots.  A cell keeps the
least and the greatest distance of its vectors to its pivot, so the triangle
inequality bounds from below how near any of them can be to a query.

1. Every query meets the nearest cells that together hold k vectors.  Its k-th
   distance there is an upper bound of the final one.
2. It then meets every other cell whose lower bound does not exceed that.  The
   cells left out can't hold a nearer vector, so the result is that of
   ``knn_join``.

Both steps are the cell join of ``operators.knn``: a cell that holds a third of
all vectors is split into blocks.  Only the pivots (at most ``MAX_PIVOTS``, fitted
on at most ``SAMPLE_ROWS`` vectors) and three numbers a pivot reach the driver; any
choice of pivots gives the same result, a poor one only prunes less.

Vectors without clusters (random directions) prune next to nothing and each
query is copied to every cell: ``knn_join`` is the plan for those.

Rows whose vector is null, holds a null or a non-finite number, or is not of the commonest
length of the sample take no part, as queries or as stored rows.  Stored rows of one id
count each; query rows of one id are asked together and get one list.  Equal distances
go by the smaller stored id.  An empty store or no queries give no rows.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.operators.knn import _grid_cells, _out_schema, _scored, _stack, merge_topk
from reclink.session import materialize

#: vectors the pivots are fitted on, and the most pivots there can be
SAMPLE_ROWS = 4096
MAX_PIVOTS = 1024
#: stored vectors a cell should hold
CELL_ROWS = 8192
#: distances to pivots come from a matrix product; bounds give way by this share of the norms
SLACK = 1e-6


class PrunedJoin(NamedTuple):
    """``hits``: qid, sid, rank, dist and carried columns.  ``visits``: per query the
    cells it met (``cells``), the stored vectors in them (``candidates``) and all it might have met (``store``)."""
    hits: DataFrame
    visits: DataFrame


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` pivots: farthest points first, then a few rounds of means."""
    first = sample[0]
    far = ((sample - first) ** 2).sum(axis=1)
    chosen = [first]
    while len(chosen) < n and far.max() > 0:
        chosen.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(axis=1)
        size = np.bincount(near, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], pivots)
    return pivots


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows by pivots."""
    sq = (rows ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def _usable(df: DataFrame, col: str) -> DataFrame:
    finite = F.forall(col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return df.where(F.col(col).isNotNull() & (F.size(col) > 0)).where(finite)


def _home(pivots: np.ndarray):
    @F.pandas_udf("cell int, away double")
    def near(vecs: pd.Series) -> pd.DataFrame:
        if not len(vecs):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "away": np.zeros(0)})
        d = distances(_stack(vecs), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": d[np.arange(len(d)), cell]})
    return near


def _first_cells(pivots: np.ndarray, held: np.ndarray, need: int):
    """The nearest non-empty cells that hold ``need`` vectors together."""
    @F.pandas_udf("array<int>")
    def first(vecs: pd.Series) -> pd.Series:
        out = []
        for d in (distances(_stack(vecs), pivots) if len(vecs) else ()):
            order = np.argsort(d, kind="stable")
            order = order[held[order] > 0]
            out.append(order[:np.searchsorted(held[order].cumsum(), need) + 1].astype(np.int32))
        return pd.Series(out, dtype=object)
    return first


def _other_cells(pivots: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Cells not met yet that may hold a vector as near as the bound (null: any)."""
    reach = np.sqrt((pivots ** 2).sum(axis=1)).max()

    @F.pandas_udf("array<int>")
    def others(vecs: pd.Series, met: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        rows = _stack(vecs)
        d = distances(rows, pivots)
        least = np.maximum(d - high[None, :], low[None, :] - d)
        slack = SLACK * (np.sqrt((rows ** 2).sum(axis=1)) + reach + 1)
        limit = np.sqrt(bound.astype("float64").fillna(np.inf).to_numpy()) + slack
        keep = (least <= limit[:, None]) & (held > 0)[None, :]
        for i, cells in enumerate(met):
            keep[i, np.asarray(cells, dtype=int)] = False
        return pd.Series([np.flatnonzero(k).astype(np.int32) for k in keep], dtype=object)
    return others


def knn_pruned(queries: DataFrame, store: DataFrame, k: int, *, q_id: str = "id", q_vec: str = "vec", s_id: str = "id",
               s_vec: str = "vec", exclude_self: bool = False, q_carry: tuple = (), s_carry: tuple = (),
               pivots: int | None = None, q_block_rows: int = 8192, s_block_rows: int = 8192,
               decimals: int = 9) -> PrunedJoin:
    """Exact k nearest stored vectors by squared Euclidean distance, cells pruned (see the module)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    spark, q_carry, s_carry = queries.sparkSession, list(q_carry), list(s_carry)
    q = _usable(queries.select(F.col(q_id).alias("_qid"), F.col(q_vec).alias("_qvec"), *q_carry), "_qvec")
    s = _usable(store.select(F.col(s_id).alias("_sid"), F.col(s_vec).alias("_svec"), *s_carry), "_svec")
    schema = _out_schema(q, s, q_carry, s_carry)
    n_store = s.count()
    # a bounded sample, drawn by the hash of the id
    sample = [r[0] for r in s.select("_svec", F.xxhash64("_sid").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()]
    if not sample:
        return PrunedJoin(spark.createDataFrame([], schema),
                          q.limit(0).select(F.col("_qid").alias("qid"), F.lit(0).alias("cells"),
                                            F.lit(0).cast("long").alias("candidates"), F.lit(0).cast("long").alias("store")))
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    q, s = q.where(F.size("_qvec") == dim), s.where(F.size("_svec") == dim)
    n = pivots or max(16, -(-n_store // CELL_ROWS))
    p = fit_pivots(np.array([v for v in sample if len(v) == dim], dtype=np.float64), min(n, MAX_PIVOTS))

    s = materialize(s.withColumn("_h", _home(p)("_svec")).select("*", "_h.cell", "_h.away").drop("_h")
                     .withColumnRenamed("cell", "_cell"))
    held, low, high = np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p))
    for r in s.groupBy("_cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect():  # a row a pivot
        held[r[0]], low[r[0]], high[r[0]] = r[1], r[2], r[3]
    s = s.drop("away")

    q = materialize(q.withColumn("_met", _first_cells(p, held, k + bool(exclude_self))("_qvec")))

    def search(asked):
        qg, sg, _ = _grid_cells(spark, asked, s, ["_cell"], q_block_rows, s_block_rows, 1)
        return _scored(qg, sg, ["_cell", "_qb", "_sb"], k=k, metric="l2sq", exclude_self=exclude_self, decimals=decimals,
                       q_carry=q_carry, s_carry=s_carry)

    cols = ["_qid", "_qvec", *q_carry]
    first = materialize(merge_topk(search(q.select(*cols, F.explode("_met").alias("_cell"))), k, decimals))
    bound = (first.where(F.col("rank") == k)
                  .select(F.col("qid").alias("_bid"), (F.col("dist") + 2 * 10.0 ** -decimals).alias("_bound")))
    asked = materialize(q.join(bound, F.col("_qid") == F.col("_bid"), "left").drop("_bid")
                         .withColumn("_more", _other_cells(p, held, low, high)("_qvec", "_met", "_bound")))
    rest = search(asked.select(*cols, F.explode("_more").alias("_cell")))
    hits = merge_topk(first.unionByName(rest), k, decimals)
    sizes = F.array(*[F.lit(int(h)) for h in held])  # at most MAX_PIVOTS numbers
    both = F.concat("_met", "_more")
    visits = asked.select(F.col("_qid").alias("qid"), F.size(both).alias("cells"),
                          F.aggregate(F.transform(both, lambda c: F.get(sizes, c).cast("long")), F.lit(0).cast("long"),
                                      lambda a, x: a + x).alias("candidates"),
                          F.lit(int(held.sum())).alias("store"))
    return PrunedJoin(hits, visits)
