"""Hard negatives by score windows, with bounds along a spanning tree of the anchors.

Vectors are quantised to integers; a score is the integer inner product with the
anchor.  An anchor's positives are its best rows of the same label; for each positive
the best rows of other labels are taken whose score lies in a window below the
positive's.

*Spanning-tree bounds.*  Anchors are put in blocks, and inside a block into groves of
``grove`` near ones.  A grove gets its minimum spanning tree.  Its root's scores with
the candidates are computed; then, level by level, a child's score lies within its
parent's plus or minus (edge length times candidate norm), and only candidates whose
bounds still overlap what is wanted are scored again: the anchor's best same-label
bounds in the first pass, its windows (cut at the best certain members) in the second.
A candidate that was not scored hands its interval on.  On vectors in random directions
the edges are long and nearly all is scored; on clustered ones most is skipped.

*Plan.*  Every row is dealt to a block of candidates by a hash of its id, every anchor
to a block of about ``anchor_rows`` neighbours on a projection; one task scores one pair
of blocks, emits its best few, and windows merge them: first the positives, then, with
their scores known, the negatives.  So no label, anchor or copy gathers rows.

Scores are exact: in double precision while every product stays below 2^53, else in
Python's integers (numbers beyond 64 bits count as the nearest that fit).

Defined cases: rows without an id, a label or a vector, or with a null or non-finite
component (also after multiplying by 256), take no part; vectors of different length
have no score together; exact repeats of a row are one; different rows of one id are
candidates each, but an id is never its own positive or negative, and as an anchor each
of its rows stands by itself, the better score for the pair counting; zero vectors score
0; fewer candidates than wanted are all returned; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions, stored

_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1
_AT_ONCE = 8192  # candidates with bounds in memory


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; beyond 2^53 a double is whole already."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(
        F.abs(x * scale) < _EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))


def _finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(parent, edge length, levels from the root) of a minimum spanning tree (Prim), root 0."""
    n = len(points)
    parent, length, depth = np.zeros(n, int), np.zeros(n), np.zeros(n, int)
    away, near = np.full(n, np.inf), np.zeros(n, int)
    inside, now = np.zeros(n, bool), 0
    inside[0] = True
    for _ in range(n - 1):
        d = points - points[now]
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        closer = ~inside & (d < away)
        away[closer], near[closer] = d[closer], now
        now = int(np.where(inside, np.inf, away).argmin())
        inside[now] = True
        parent[now], length[now], depth[now] = near[now], away[now], depth[near[now]] + 1
    return parent, length, [np.flatnonzero(depth == k) for k in range(int(depth.max()) + 1)] if n else []


def groves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size`` near ones: halved along the widest direction."""
    todo, out = [np.arange(len(points))], []
    while todo:
        g = todo.pop()
        if len(g) <= size:
            if len(g):
                out.append(g)
            continue
        x = points[g]
        far = x[np.square(x - x.mean(0)).sum(1).argmax()]
        other = x[np.square(x - far).sum(1).argmax()]
        order = g[np.argsort((x @ (far - other)), kind="stable")]
        todo += [order[:len(g) // 2], order[len(g) // 2:]]
    return out


def forest_of(anchors: np.ndarray, grove: int) -> list[tuple]:
    """(row numbers, parent, edge length, levels) of each grove."""
    return [(g, *spanning_tree(anchors[g])) for g in groves(anchors, grove)]


def bounded_scores(anchors: np.ndarray, x: np.ndarray, wanted, forest: list[tuple], count: list | None = None):
    """(anchor number, candidate numbers, exact scores) per anchor: all candidates that ``wanted`` keeps, and maybe more.

    ``wanted(numbers, low, high)`` says, for anchors and intervals of their scores with
    all candidates, which (anchor, candidate) pairs have to be scored.
    ``count`` collects [pairs, pairs scored below the roots].
    """
    norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-9) + 1e-9
    for g, parent, length, steps in forest:
        a = anchors[g]
        low, high = np.empty((len(g), len(x))), np.empty((len(g), len(x)))
        for depth, step in enumerate(steps):
            if depth:
                reach = (length[step] * (1 + 1e-9))[:, None] * norm
                low[step], high[step] = low[parent[step]] - reach, high[parent[step]] + reach
                need = wanted(g[step], low[step], high[step]) & (low[step] < high[step])
            else:
                need = np.ones((len(step), len(x)), bool)
            if count is not None and depth:
                count[0] += need.size
                count[1] += int(need.sum())
            if need.mean() > 0.2:
                exact = a[step] @ x.T
                low[step] = np.where(need, exact, low[step])
                high[step] = np.where(need, exact, high[step])
            else:
                for i, r in enumerate(step):
                    at = np.flatnonzero(need[i])
                    low[r, at] = high[r, at] = x[at] @ a[r]
        for i, r in enumerate(g):
            at = np.flatnonzero(low[i] == high[i])
            yield int(r), at, low[i, at]


def _whole_scores(anchors: np.ndarray, x: np.ndarray):
    """The same for numbers beyond 2^53: every score, in Python's integers."""
    whole = lambda m: [[int(v) for v in row] for row in m]
    cand = whole(x)
    for i, a in enumerate(whole(anchors)):
        yield i, np.arange(len(x)), np.array([max(-_MOST, min(_MOST, sum(p * q for p, q in zip(a, c)))) for c in cand], object)


def _scores(anchors: np.ndarray, x: np.ndarray, wanted, grove: int):
    """(anchor number, candidate numbers, scores), candidates in slices; ``wanted`` is made for each slice."""
    fits = _fits(anchors, x)
    forest = forest_of(anchors, grove) if fits else None
    for b in range(0, len(x), _AT_ONCE):
        part = x[b:b + _AT_ONCE]
        for i, at, s in bounded_scores(anchors, part, wanted(slice(b, b + _AT_ONCE)), forest) if fits else _whole_scores(anchors, part):
            yield i, at + b, s


def _fits(anchors: np.ndarray, x: np.ndarray) -> bool:
    top = lambda m: float(np.abs(m).max()) if m.size else 0.0
    return top(anchors) * top(x) * max(1, x.shape[1]) < _EXACT


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf in rows that are shorter."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k]


def _first(ids: np.ndarray, scores: np.ndarray, k: int):
    """(id, score) of the k best different ids, higher scores first, ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        if len(set(ids[keep].tolist())) >= k:
            ids, scores = ids[keep], scores[keep]
    out = {}
    for s, i in sorted(zip((-scores).tolist(), ids.tolist())):
        if len(out) == k:
            break
        out.setdefault(i, -s)
    return [(i, int(s)) for i, s in out.items()]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def mine(vectors: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
         anchor_rows: int = 65_536, cell_rows: int = 65_536, grove: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is the label of a row (column ``label`` by default); the windows are
    [low, high] percent of the positive's score.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                          quantised(F.col(vec_col)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("v"))).distinct().withColumn("dim", F.size("v"))
    # A direction to order the anchors by: its sum with fixed signs; ties are spread by a hash.
    sign = lambda i: F.when(F.crc32(i.cast("string").cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)
    line = F.aggregate(F.transform("v", lambda x, i: x * sign(i)), F.lit(0.0), lambda s, x: s + x) + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    rows = stored(rows.withColumn("line", F.when(F.col("anchor"), line)), "quantised")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count("line").alias("a")).where("a > 0")
    # blocks of candidates: as few as fit a task, but some for every core
    few = F.least(F.lit(2 * shuffle_partitions(spark)), F.ceil(F.col("n") / 2048))
    sizes = stored(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / cell_rows), few).cast("int"))
                   .withColumn("groups", F.ceil(F.col("a") / anchor_rows).cast("int")), "sizes")  # one row per vector length
    most = sizes.agg(F.max("groups")).first()[0]
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not most:
        return spark.createDataFrame([], out_schema)
    ends = F.array() if most == 1 else F.percentile_approx("line", [i / most for i in range(1, most)], 10_000)
    cuts = rows.where("anchor").groupBy("dim").agg(ends.alias("ends")) if most > 1 else sizes.select("dim", F.array().cast("array<double>").alias("ends"))
    plan = stored(sizes.join(cuts, "dim"), "blocks")  # one row per vector length, and one cut per block of anchors

    anchors = (rows.where("anchor").join(F.broadcast(plan), "dim")
               .withColumn("grp", F.size(F.filter("ends", lambda e: e < F.col("line"))))
               .withColumn("aid", F.xxhash64("id", "label", "v"))
               .select("dim", "grp", "blocks", "aid", "id", "label", "v"))
    cand = (rows.join(F.broadcast(plan.select("dim", "blocks", F.size("ends").alias("last"))), "dim")
            .withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
            .withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("last"))))
            .select("grp", "block", *[F.col(c).alias(f"c_{c}") for c in ("dim", "id", "label", "v")]))

    def cells(side: DataFrame, fn, schema: str) -> DataFrame:
        asked = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return asked.groupBy("dim", "grp", "block").cogroup(cand.groupBy("c_dim", "grp", "block")).applyInArrow(fn, schema)

    def sides(left: pa.Table, right: pa.Table):
        dim = left.column("dim")[0].as_py()
        names, code = np.unique(np.concatenate([left.column("label").to_numpy(), right.column("c_label").to_numpy()]).astype(str), return_inverse=True)
        return (left.column("id").to_numpy(), code[:len(left)], _matrix(left.column("v"), dim),
                right.column("c_id").to_numpy(), code[len(left):], _matrix(right.column("c_v"), dim))

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("aid", "pid", "score")])
        out = {"aid": [], "pid": [], "score": []}
        if left.num_rows and right.num_rows:
            aids = left.column("aid").to_pylist()
            ai, al, a, ci, cl, x = sides(left, right)
            # rows of one id may differ: so many rows are sure to hold n_positive ids
            enough = n_positive * int(np.unique(ci, return_counts=True)[1].max())

            def wanted(b):
                def need(n, lo, hi):
                    same = (al[n][:, None] == cl[b]) & (ai[n][:, None] != ci[b])
                    return same & (hi >= _kth(np.where(same, lo, -np.inf), enough)[:, None])
                return need
            for i, at, s in _scores(a, x, wanted, grove):
                keep = (cl[at] == al[i]) & (ci[at] != ai[i])
                for pid, score in _first(ci[at[keep]], s[keep], n_positive):
                    out["aid"].append(aids[i])
                    out["pid"].append(pid)
                    out["score"].append(score)
        return pa.Table.from_pydict(out, schema=schema)

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])
        out = {c: [] for c in schema.names}
        if left.num_rows and right.num_rows:
            given = [[(p["pid"], p["score"], *window_of(p["score"], low, high)) for p in ps] for ps in left.column("positives").to_pylist()]
            ai, al, a, ci, cl, x = sides(left, right)
            most = max(map(len, given))
            ends = np.array([[g[2:] for g in ps] + [(1, 0)] * (most - len(ps)) for ps in given], object).reshape(len(given), most, 2).astype(float)
            enough = n_negative * int(np.unique(ci, return_counts=True)[1].max())

            def wanted(b):
                def need(n, lo, hi):
                    other, some = (al[n][:, None] != cl[b]) & (ai[n][:, None] != ci[b]), np.zeros(lo.shape, bool)
                    for j in range(most):
                        bottom, top = ends[n, j, 0][:, None], ends[n, j, 1][:, None]
                        sure = other & (lo >= bottom) & (hi <= top)
                        best = _kth(np.where(sure, lo, -np.inf), enough)[:, None]
                        some |= other & (hi >= np.maximum(bottom, best)) & (lo <= top) & (bottom <= top)
                    return some
                return need
            for i, at, s in _scores(a, x, wanted, grove):
                keep = (cl[at] != al[i]) & (ci[at] != ai[i])
                ids, s = ci[at[keep]], s[keep]
                for pid, ps, bottom, top in given[i]:
                    fits = (s >= bottom) & (s <= top)
                    for nid, ns in _first(ids[fits], s[fits], n_negative):
                        for c, v in zip(schema.names, (int(ai[i]), pid, nid, ps, ns)):
                            out[c].append(v)
        return pa.Table.from_pydict(out, schema=schema)

    def best(df: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
        """One row per (keys, other) with its best score; the first k by score, then id."""
        by = Window.partitionBy(*keys).orderBy(F.desc(score), other)
        return (df.groupBy(*keys, other).agg(F.max(score).alias(score))
                .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))

    found = best(cells(anchors.select("dim", "grp", "blocks", "aid", "id", "label", "v"), positives, "aid long, pid long, score long"),
                 ["aid"], "score", "pid", n_positive)
    windows = stored(found.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("rank", "pid", "score"))).alias("positives")), "positives")
    asked = anchors.join(windows.withColumnRenamed("aid", "waid"), F.col("aid") == F.col("waid")).select(
        "dim", "grp", "blocks", "id", "label", "v", "positives")
    got = cells(asked, negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return (best(got, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", n_negative)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
