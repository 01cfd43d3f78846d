"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``sample_rows``) on the driver and sent to
the tasks; every vector is indexed: it goes down to one leaf.  Each query walks the
tree best bin first: a priority queue holds the branches seen so far by their
cosine to the query, and leaves come out in order of promise.  How many leaves to
visit is calibrated: for a sample of the queries the exact neighbours are found by
a full scan, and the visits are widened until ``recall`` of them is reached (or all
leaves are).  That number holds for every query.

Leaves are packed into cells of about ``cell_rows`` vectors (a crowded leaf is
split over several), queries are sent to the cells that hold their leaves, and a
cell is scored with matrix products.  Survivors are scored again row by row in
double precision, so that equal vectors get equal scores; equal vectors are put
together before the cut to k, which makes ties exact whatever their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors of each length are
searched by themselves; rows of one id count as one document, with the best of their
scores, however many they are; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import stored

_TOL = 1e-9  # cosines from matrix products are trusted up to this


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # no overflow for large components
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with the row of q, each computed by itself in double precision."""
    x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
    return (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum(1))


class Tree:
    """Centres of all nodes; children of a node, or its leaf number."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 16, seed: int = 7):
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        rng = np.random.RandomState(seed)
        self.dim = sample.shape[1]
        if len(sample):
            self._grow(_unit(sample.astype(np.float64)), max(1, leaves), branch, rng)

    def _grow(self, x, leaves, branch, rng) -> int:
        node = len(self.centres)
        mean = x.mean(0)
        n = np.sqrt(mean @ mean)
        self.centres.append(mean / n if n > 0 else mean)
        self.children.append([])
        self.leaf.append(-1)
        groups = self._split(x, min(branch, leaves), rng) if leaves > 1 and len(x) > 1 else []
        if len(groups) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        for g in groups:
            share = max(1, round(leaves * len(g) / len(x)))
            self.children[node].append(self._grow(x[g], share, branch, rng))
        return node

    @staticmethod
    def _split(x, k, rng, rounds: int = 8):
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            at = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
        at = (x @ centres.T).argmax(1)
        return [g for g in (np.flatnonzero(at == c) for c in range(len(centres))) if len(g)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (unit) row."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            at = (x[rows] @ np.stack([self.centres[c] for c in kids]).T).argmax(1)
            stack += [(c, rows[at == i]) for i, c in enumerate(kids) if (at == i).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order for a (unit) query."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            for c, s in zip(kids, np.stack([self.centres[c] for c in kids]) @ q):
                heapq.heappush(queue, (-float(s), c))

    def order(self, q: np.ndarray, most: int) -> list[int]:
        out = []
        for leaf in self.visit(q):
            out.append(leaf)
            if len(out) >= most:
                break
        return out


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _best(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, keep: np.ndarray | None = None):
    """(query position, id, score) of the k best per query among rows x, ties by id.

    ``keep``: which (row, query) pairs count.  Equal rows are one while scoring; of
    their ids the k + 1 smallest are enough (one may be the query itself).  An id
    with several different rows counts once, so the cut leaves room for all of them.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    flat = np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel()
    _, first, group = np.unique(flat, return_index=True, return_inverse=True)
    members = np.lexsort((ids, group))
    members = members[np.concatenate([[True], (np.diff(group[members]) != 0) | (np.diff(ids[members]) != 0)])] if len(ids) else members
    starts = np.searchsorted(group[members], np.arange(len(first) + 1))
    rows_of_id = int(np.unique(ids[members], return_counts=True)[1].max()) if len(members) else 1
    u = x[first]
    s = _unit(q) @ _unit(u).T
    for i in range(len(q)):
        row = s[i] if keep is None else np.where(keep[i][order][first], s[i], -np.inf)
        n = min(len(row), (k + 1) * rows_of_id)
        cut = np.partition(row, len(row) - n)[len(row) - n] - _TOL
        cand = np.flatnonzero((row >= cut) & (row > -np.inf))
        exact = cosines(u[cand], np.repeat(q[i:i + 1], len(cand), 0))
        found = {}
        for c, score in zip(cand, exact):
            for m in members[starts[c]:starts[c + 1]][:(k + 1) * rows_of_id]:
                if ids[m] != qid[i]:
                    found[ids[m]] = max(score, found.get(ids[m], -2.0))
        for score, vid in sorted((-s, v) for v, s in found.items())[:k]:
            yield i, vid, -score


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           recall: float = 0.97, leaf_rows: int = 256, max_leaves: int = 2048, sample_rows: int = 40_000,
           calibrate: int = 128, cell_rows: int = 4096, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, nearest first."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
    sizes = (base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("q").alias("asked")).where("asked")
             .orderBy("d").collect())  # one row per vector length
    found = [_search_length(base.where(F.size("v") == r["d"]), r["d"], r["n"], k, recall, leaf_rows, max_leaves, sample_rows, calibrate, cell_rows, block)
             for r in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search_length(base: DataFrame, dim: int, n: int, k: int, recall: float, leaf_rows: int, max_leaves: int, sample_rows: int,
                   calibrate: int, cell_rows: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) of the nearest found in each cell, for vectors (id, v, q) of one length."""
    spark = base.sparkSession
    # Fit on a bounded sample, by hash.
    leaves = int(min(max_leaves, max(1, n // leaf_rows)))
    want = min(n, sample_rows, 64 * leaves)
    near = base if want >= n else base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * want / n + 1e-3) * (1 << 30)))
    sample = near.orderBy(F.xxhash64("id"), "id").limit(want).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(_matrix(sample, dim), leaves)
    sent = spark.sparkContext.broadcast(tree)

    def index(batches):
        t = sent.value
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(t.assign(_unit(_matrix(b.column("v"), dim))), pa.int32()))
    indexed = stored(base.mapInArrow(index, "id long, v array<double>, q boolean, leaf int"), "leaves")
    held = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # at most max_leaves rows

    # Calibration: exact neighbours of some queries, and how far down their lists the leaves lie.
    some = (indexed.where("q").orderBy(F.xxhash64("id"), "id").limit(calibrate).select("id", "v").toArrow())
    sq, sid = _matrix(some.column("v").combine_chunks(), dim), some.column("id").to_numpy()

    def exact(batches):
        for b in batches:
            if b.num_rows:
                got = list(_best(b.column("id").to_numpy(), _matrix(b.column("v"), dim), sid, sq, k))
                leaf = dict(zip(b.column("id").to_pylist(), b.column("leaf").to_pylist()))
                yield pa.RecordBatch.from_pydict({"n": [g[0] for g in got], "id": [int(g[1]) for g in got], "s": [g[2] for g in got],
                                                  "leaf": [leaf[g[1]] for g in got]},
                                                 schema=pa.schema([("n", pa.int32()), ("id", pa.int64()), ("s", pa.float64()), ("leaf", pa.int32())]))
    best = Window.partitionBy("n").orderBy(F.desc("s"), "id")
    true = (indexed.select("id", "v", "leaf").mapInArrow(exact, "n int, id long, s double, leaf int")
            .withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("n", "leaf").collect())
    order = [{leaf: i for i, leaf in enumerate(tree.order(x, tree.leaves))} for x in _unit(sq)]
    depth = sorted(order[r["n"]][r["leaf"]] for r in true)
    visits = tree.leaves if not depth else 1 + depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]

    # Cells: neighbouring leaves together up to cell_rows, a crowded leaf over several.
    cells, cell, size = {}, 0, 0
    for leaf in range(tree.leaves):
        c = held.get(leaf, 0)
        parts = max(1, -(-c // cell_rows))
        if size and size + c > cell_rows:
            cell, size = cell + 1, 0
        cells[leaf] = (cell, parts)
        size += c
        if parts > 1:
            cell, size = cell + parts, 0
    plan = spark.sparkContext.broadcast((cells, held, visits))

    def place(batches):  # vectors -> their cell
        where = plan.value[0]
        for b in batches:
            ids, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = [where[x][0] + int(h) % where[x][1] for x, h in zip(leaf.tolist(), spread)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("id"), b.column("leaf"), b.column("v")], names=["cell", "id", "leaf", "v"])

    def ask(batches):  # queries -> the cells of the leaves they visit
        where, count, most = plan.value
        t = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, out = _unit(_matrix(b.column("v"), dim)), {"cell": [], "row": [], "leaves": []}
            for i in range(len(x)):
                got, rows, per = 0, 0, {}
                for leaf in t.visit(x[i]):
                    if got >= most and rows > k:  # widened until there are k candidates
                        break
                    got, rows = got + 1, rows + count.get(leaf, 0)
                    for c in range(where[leaf][0], where[leaf][0] + where[leaf][1]):
                        per.setdefault(c, []).append(leaf)
                for c, ls in per.items():
                    out["cell"].append(c)
                    out["row"].append(i)
                    out["leaves"].append(ls)
            rows = pa.array(out["row"], pa.int64())
            for a in range(0, len(rows), 8192):
                r = rows.slice(a, 8192)
                yield pa.RecordBatch.from_arrays([pa.array(out["cell"][a:a + 8192], pa.int32()), b.column("id").take(r), b.column("v").take(r),
                                                  pa.array(out["leaves"][a:a + 8192], pa.list_(pa.int32()))], names=["cell", "qid", "qv", "leaves"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        ids, leaf, x = (left.column("id").to_numpy(), left.column("leaf").to_numpy(), _matrix(left.column("v").combine_chunks(), dim))
        out = {"query_id": [], "vec_id": [], "score": []}
        names = np.unique(leaf)
        for a in range(0, right.num_rows, block):
            part = right.slice(a, block)
            qid, q = part.column("qid").to_numpy(), _matrix(part.column("qv").combine_chunks(), dim)
            has = np.stack([np.isin(names, ls) for ls in part.column("leaves").to_pylist()])
            keep = None if has.all() else has[:, np.searchsorted(names, leaf)]
            for i, vid, s in _best(ids, x, qid, q, k, keep):
                out["query_id"].append(int(qid[i]))
                out["vec_id"].append(int(vid))
                out["score"].append(float(s))
        return pa.Table.from_pydict(out, schema=empty)

    side = indexed.select("id", "v", "leaf").mapInArrow(place, "cell int, id long, leaf int, v array<double>")
    asked = (indexed.where("q").select("id", "v").mapInArrow(ask, "cell int, qid long, qv array<double>, leaves array<int>"))
    # A cell with very many queries is asked in several groups, each with a copy of its vectors.
    n_queries = indexed.where("q").count()
    salts = max(1, -(-n_queries // (16 * cell_rows)))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("qid"), F.lit(salts)).cast("int"))
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return side.groupBy("cell", "salt").cogroup(asked.groupBy("cell", "salt")).applyInArrow(
        lambda l, r: score(l, r), "query_id long, vec_id long, score double")
