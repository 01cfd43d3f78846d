"""k-nearest-neighbour joins between a query DataFrame and a vector store.

Plan (exact join, K1/K2/K4):

* every query gets a query block ``_qb = pmod(xxhash64(qid), QB)`` and every
  stored vector a store block ``_sb = pmod(xxhash64(sid), SB)``;
* a query row is repeated once per store block and a stored row once per query
  block, so each (key, _qb, _sb) cell holds about |Q|/QB queries and |S|/SB
  vectors -- hashing on the unique id keeps every cell near that size even
  when one ``on`` key (a data provider) holds a third of the rows, because
  QB/SB are sized per key from that key's own counts;
* ``cogroup(...).applyInPandas`` scores a cell with matrix products over bounded
  tiles and emits only the local top k per query;
* the per-query lists from the SB store blocks are merged with
  ``row_number() <= k`` (planned as a WindowGroupLimit); when SB is 1 the
  local list is already final and the merge shuffle is skipped.

Nothing is collected to the driver except row counts.  Distances are computed
in float64; candidates are re-scored exactly (difference form) and ranked on
``(round(dist, decimals), sid)`` so ties resolve the same way in every engine.

Approximate join (K5) uses the same cell machinery, but cells are LSH buckets
(signs of random projections) instead of the full query x store grid.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2sq", "cosine", "dot")

# queries and stored vectors whose products are held at once (8 MiB)
_TILE_QUERIES, _TILE_STORE = 512, 2048
# candidates scored exactly at once
_EXACT_ROWS = 1 << 16
# a side of a cell may hold this many bytes of vectors: a worker holds some copies of them, four workers an executor
_SIDE_BYTES = 16 << 20
# smaller blocks than asked for by memory only move more copies: at most this many of a side, unless memory asks for more
_MOST_BLOCKS = 16
# a per-key block table up to this many rows is broadcast; larger is shuffled
_BROADCAST_KEYS = 200_000


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def _exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if metric == "l2sq":
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    if metric == "cosine":
        return 1.0 - np.einsum("ij,ij->i", a, b)
    return -np.einsum("ij,ij->i", a, b)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _own(qids: np.ndarray, sids: np.ndarray):
    """(query row, stored row) of all equal ids, by query row."""
    codes, _ = pd.factorize(np.concatenate([qids, sids]))  # null ids equal none
    cq, cs = codes[:len(qids)], codes[len(qids):]
    order = np.argsort(cs, kind="stable")
    lo, hi = (np.searchsorted(cs[order], cq, side) for side in ("left", "right"))
    n = np.where(cq < 0, 0, hi - lo)
    r = np.repeat(np.arange(len(qids)), n)
    return r, order[np.repeat(lo, n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]


def _candidates(Q: np.ndarray, S: np.ndarray, k: int, slack: np.ndarray, own):
    """(query row, stored row) of all pairs whose product is not below a query's k-th largest by more than ``slack``.

    Stored rows come in tiles.  The k-th largest product so far is a floor for later
    tiles, so only the first tile is partitioned and few pairs of the others remain.
    """
    floor = np.full(len(Q), -np.inf)
    kept, fresh = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], []
    for at in range(0, len(S), _TILE_STORE):
        H = Q @ S[at:at + _TILE_STORE].T
        here = (own[1] >= at) & (own[1] < at + _TILE_STORE)
        H[own[0][here], own[1][here] - at] = -np.inf
        if at == 0 and H.shape[1] > k:
            floor = np.partition(H, H.shape[1] - k, axis=1)[:, -k] - slack
        r, c = np.nonzero(H >= floor[:, None])
        h = H[r, c]
        real = np.isfinite(h)
        fresh.append((r[real], c[real] + at, h[real]))
        last = at + _TILE_STORE >= len(S)
        if last or sum(len(f[0]) for f in fresh) > len(Q) * k // 2:
            r, c, h = (np.concatenate([x, *y]) for x, y in zip(kept, zip(*fresh)))
            order = np.lexsort((-h, r))
            r, c, h = r[order], c[order], h[order]
            kth = np.arange(len(r)) - np.searchsorted(r, r) == k - 1
            floor[r[kth]] = np.maximum(floor[r[kth]], h[kth] - slack[r[kth]])
            keep = h >= floor[r]
            kept, fresh = [r[keep], c[keep], h[keep]], []
    return kept[0], kept[1]


def _cell_topk(qpdf: pd.DataFrame, spdf: pd.DataFrame, *, k: int, metric: str,
               exclude_self: bool, decimals: int, q_carry: list, s_carry: list,
               out_cols: list) -> pd.DataFrame:
    """Exact top-k of every query of one cell against the stored vectors of that cell."""
    if len(qpdf) == 0 or len(spdf) == 0:
        return pd.DataFrame()  # untyped empty columns would not convert to string fields
    spdf = _distinct_rows(spdf, k + bool(exclude_self))
    Q = _stack(qpdf["_qvec"])
    S = _stack(spdf["_svec"])
    qids = qpdf["_qid"].to_numpy()
    sids = spdf["_sid"].to_numpy()
    if metric == "cosine":
        Q, S = _unit(Q), _unit(S)
    qn = np.einsum("ij,ij->i", Q, Q)
    sn = np.einsum("ij,ij->i", S, S)
    # What the matrix product may be off by grows with the norms (l2sq cancels them) and the dimension.
    eps = 8 * np.finfo(np.float64).eps * max(1, S.shape[1] + 1)
    slack = 2 * (10.0 ** (-decimals) + eps * (qn + sn.max() + 1))
    # l2sq falls as q.s - s.s / 2 rises: one component more makes that a product too
    Qa, Sa = (np.column_stack([Q, np.ones(len(Q))]), np.column_stack([S, -sn / 2])) if metric == "l2sq" else (Q, S)
    own = _own(qids, sids) if exclude_self else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts = []
    for start in range(0, len(Q), _TILE_QUERIES):
        end = min(start + _TILE_QUERIES, len(Q))
        here = slice(*np.searchsorted(own[0], [start, end]))
        r, c = _candidates(Qa[start:end], Sa, k, slack[start:end], (own[0][here] - start, own[1][here]))
        r = r + start
        dist = np.concatenate([_exact(metric, Q[r[i:i + _EXACT_ROWS]], S[c[i:i + _EXACT_ROWS]])
                               for i in range(0, max(len(r), 1), _EXACT_ROWS)])
        # stored rows are in id order, so position breaks ties; cut to k before the next chunk
        order = np.lexsort((c, np.round(dist, decimals), r))
        r, c, dist = r[order], c[order], dist[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        top = rank <= k
        parts.append((r[top], c[top], dist[top], rank[top]))
    qp, sp, dist, rank = (np.concatenate(x) for x in zip(*parts))
    if not len(qp):
        return pd.DataFrame()
    res = {"qid": qids[qp], "sid": sids[sp], "rank": rank.astype(np.int32), "dist": dist}
    for c in q_carry:
        res[c] = qpdf[c].to_numpy()[qp]
    for c in s_carry:
        res[c] = spdf[c].to_numpy()[sp]
    return pd.DataFrame(res)[out_cols]


def _scored(q: DataFrame, s: DataFrame, keys: list, *, k: int, metric: str, exclude_self: bool, decimals: int,
            q_carry, s_carry) -> DataFrame:
    """The local top k of every query of every cell."""
    q_carry, s_carry = list(q_carry), list(s_carry)
    out = _out_schema(q, s, q_carry, s_carry)
    fn = partial(_cell_topk, k=k, metric=metric, exclude_self=exclude_self, decimals=decimals,
                 q_carry=q_carry, s_carry=s_carry, out_cols=out.fieldNames())
    return q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(fn, out)


def _distinct_rows(spdf: pd.DataFrame, keep: int) -> pd.DataFrame:
    """Stored rows in id order; of equal vectors only the ``keep`` smallest ids.

    Equal vectors are equally far from every query, so no other of them can be
    among its k nearest: a cell of copies costs no more than one of distinct rows.
    """
    spdf = spdf.sort_values("_sid", kind="stable")
    raw = [np.asarray(v, dtype=np.float64).tobytes() for v in spdf["_svec"]]
    nth = pd.Series(raw, index=spdf.index).groupby(raw).cumcount()
    return spdf[(nth < keep).to_numpy()]


def _field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def _out_schema(q: DataFrame, s: DataFrame, q_carry, s_carry) -> T.StructType:
    fields = [T.StructField("qid", _field(q, "_qid").dataType),
              T.StructField("sid", _field(s, "_sid").dataType),
              T.StructField("rank", T.IntegerType()),
              T.StructField("dist", T.DoubleType())]
    fields += [T.StructField(c, _field(q, c).dataType) for c in q_carry]
    fields += [T.StructField(c, _field(s, c).dataType) for c in s_carry]
    return T.StructType(fields)


def _blocks(n: int, rows: int, enough: int) -> int:
    """Blocks of ``rows`` rows each; beyond ``_MOST_BLOCKS`` the blocks grow, up to ``enough`` rows."""
    return max(1, min(-(-n // rows), max(_MOST_BLOCKS, -(-n // max(rows, enough)))))


def _grid_cells(spark, q: DataFrame, s: DataFrame, on: list, q_block_rows: int,
                s_block_rows: int, min_cells: int, counts=(None, None), enough: int = 0):
    """Assign query/store rows to (on..., _qb, _sb) cells; return (q, s, needs_merge).

    A row is copied to each block of the other side.  A side without ``on`` keys has more than
    ``_MOST_BLOCKS`` blocks only where blocks of ``enough`` rows need them, so that small
    ``q_block_rows`` and ``s_block_rows`` don't copy the tables once for every hundred rows.

    Block numbers are ints on both sides: cogroup hashes its keys as they are typed,
    and an int and a bigint of one value go to different partitions.
    """
    if not on:
        nq = counts[0] if counts[0] is not None else q.count()
        ns = counts[1] if counts[1] is not None else s.count()
        sb = _blocks(ns, s_block_rows, enough)
        qb = max(_blocks(nq, q_block_rows, enough), int(math.ceil(min_cells / sb)))
        qb = max(1, min(qb, max(nq, 1)))
        q = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(qb)).cast("int"))
              .withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(sb - 1)))))
        s = (s.withColumn("_sb", F.pmod(F.xxhash64("_sid"), F.lit(sb)).cast("int"))
              .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))
        return q, s, sb > 1
    # per-key block counts, so a hot key is split and a small key is not fanned out.
    # Keys are renamed on the count side: query and store often share lineage.
    ks = [f"_k{i}" for i in range(len(on))]
    qc = q.groupBy(*on).agg(F.count(F.lit(1)).alias("_nq")).select(
        *[F.col(c).alias(k) for c, k in zip(on, ks)], "_nq")
    sc = s.groupBy(*on).agg(F.count(F.lit(1)).alias("_ns")).select(
        *[F.col(c).alias(k + "s") for c, k in zip(on, ks)], "_ns")
    cond = [F.col(k) == F.col(k + "s") for k in ks]
    stats = (qc.join(sc, cond, "inner")
               .select(*ks,
                       F.greatest(F.lit(1), F.ceil(F.col("_nq") / F.lit(q_block_rows))).cast("int").alias("_qbn"),
                       F.greatest(F.lit(1), F.ceil(F.col("_ns") / F.lit(s_block_rows))).cast("int").alias("_sbn")))
    from reclink.session import materialize
    stats = materialize(stats)  # one row per key, read by both sides
    agg = stats.agg(F.count(F.lit(1)).alias("n"), F.max("_sbn").alias("m")).first()
    n_keys, max_sb = agg["n"], (agg["m"] or 1)
    side = F.broadcast(stats) if n_keys <= _BROADCAST_KEYS else stats

    def attach(df):
        return df.join(side, [F.col(c) == F.col(k) for c, k in zip(on, ks)], "inner").drop(*ks)

    q = (attach(q)
          .withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_qbn")).cast("int"))
          .withColumn("_sb", F.explode(F.sequence(F.lit(0), F.col("_sbn") - 1)))
          .drop("_qbn", "_sbn"))
    s = (attach(s)
          .withColumn("_sb", F.pmod(F.xxhash64("_sid"), F.col("_sbn")).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_qbn") - 1)))
          .drop("_qbn", "_sbn"))
    return q, s, max_sb > 1


def merge_topk(local: DataFrame, k: int, decimals: int = 9, dedup: bool = False) -> DataFrame:
    """Merge per-cell top-k lists into the global top-k per query (WindowGroupLimit)."""
    if dedup:
        # the same pair can come from several LSH tables; keep one copy.  Hash
        # partitioning on qid satisfies both the pair aggregate and the window.
        carry = [c for c in local.columns if c not in ("qid", "sid", "rank", "dist")]
        local = (local.repartition("qid")
                      .groupBy("qid", "sid")
                      .agg(F.min("dist").alias("dist"), *[F.first(c).alias(c) for c in carry]))
    w = Window.partitionBy("qid").orderBy(F.round("dist", decimals), F.col("sid"))
    cols = [c for c in local.columns if c != "rank"]
    return (local.withColumn("rank", F.row_number().over(w))
                 .where(F.col("rank") <= k)
                 .select("qid", "sid", F.col("rank").cast("int").alias("rank"), "dist",
                         *[c for c in cols if c not in ("qid", "sid", "dist")]))


def knn_join(queries: DataFrame, store: DataFrame, k: int, *, q_id: str = "id", q_vec: str = "vec",
             s_id: str = "id", s_vec: str = "vec", on: list | None = None, where: Column | None = None,
             metric: str = "l2sq", exclude_self: bool = False, q_carry: tuple = (),
             s_carry: tuple = (), q_block_rows: int | None = None, s_block_rows: int | None = None,
             min_cells: int | None = None, decimals: int = 9, n_queries: int | None = None,
             n_store: int | None = None) -> DataFrame:
    """Exact kNN join: for every query, its k nearest stored vectors.

    ``on`` lists equality keys present on both sides (metadata pre-filter, P7);
    ``where`` is a store-side predicate applied before the join (P8).
    Result: ``qid, sid, rank, dist`` plus the carried columns; lower dist is
    closer for every metric (cosine distance, negative dot product).
    ``n_queries`` / ``n_store`` (known sizes) skip the counting passes that
    size the blocks.  Unless given, a block holds as many rows as fit 16 MiB of
    vectors, the same on both sides: for a cell of given size that moves the
    fewest copies.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")
    on = list(on or [])
    q_carry, s_carry = list(q_carry), list(s_carry)
    clash = set(q_carry) & set(s_carry)
    if clash:
        raise ValueError(f"carried columns must be distinct on the two sides: {clash}")
    spark = queries.sparkSession
    if where is not None:
        store = store.where(where)
    # re-alias keys so the two sides never share attribute ids (self joins)
    q = queries.select(F.col(q_id).alias("_qid"), F.col(q_vec).alias("_qvec"),
                       *[F.col(c).alias(c) for c in on + q_carry])
    s = store.select(F.col(s_id).alias("_sid"), F.col(s_vec).alias("_svec"),
                     *[F.col(c).alias(c) for c in on + s_carry])
    one = q.select(F.size("_qvec")).first()
    rows = max(256, _SIDE_BYTES // (8 * max(1, one[0] if one and one[0] else 1)))
    q_block_rows, s_block_rows = q_block_rows or rows, s_block_rows or rows
    min_cells = min_cells or spark.sparkContext.defaultParallelism
    qg, sg, needs_merge = _grid_cells(spark, q, s, on, q_block_rows, s_block_rows, min_cells,
                                      (n_queries, n_store), rows)
    local = _scored(qg, sg, on + ["_qb", "_sb"], k=k, metric=metric, exclude_self=exclude_self, decimals=decimals,
                    q_carry=q_carry, s_carry=s_carry)
    if needs_merge:
        return merge_topk(local, k, decimals)
    return local


def nearest(store: DataFrame, vec, k: int, *, s_id: str = "id", s_vec: str = "vec",
            metric: str = "l2sq", decimals: int = 9) -> DataFrame:
    """Single-query kNN (K3): distance of every stored vector to one query vector.

    Without a vector (unknown id) the result is empty; stored vectors that are null
    or of another length have no distance and are left out.  The cosine distance
    to or from a zero vector is 1.

    ``vec`` is the query vector (a list of floats, looked up beforehand -- one
    row) or a Column.  The distance is a JVM-side higher-order expression and
    the ordered limit plans as TakeOrderedAndProject: every partition keeps k
    rows and one task merges them, so the store is scanned once, unshuffled.
    """
    if vec is None:
        return store.select(F.lit(0).alias("rank"), F.col(s_id).alias("sid"), F.lit(0.0).alias("dist")).limit(0)
    if not isinstance(vec, Column):
        vec = F.array(*[F.lit(float(x)) for x in vec])
    d = vector_distance(F.col(s_vec), vec, metric)
    order = [F.round("dist", decimals), F.col("sid")]
    top = (store.select(F.col(s_id).alias("sid"), d.alias("dist"))
                .where(F.col("dist").isNotNull())
                .orderBy(*order)
                .limit(k))
    # k rows after the limit: a single small window partition is fine
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "sid", "dist")


def vector_distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """JVM-side distance between two array<float|double> columns (higher-order functions)."""
    ad = F.transform(a, lambda x: x.cast("double"))
    bd = F.transform(b, lambda x: x.cast("double"))
    if metric == "l2sq":
        return F.aggregate(F.zip_with(ad, bd, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    dot = F.aggregate(F.zip_with(ad, bd, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    if metric == "dot":
        return -dot
    na = F.sqrt(F.aggregate(ad, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(bd, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.lit(1.0) - F.when((na == 0) | (nb == 0), dot * 0).otherwise(dot / F.when(na * nb == 0, 1.0).otherwise(na * nb))


def sign_planes(dim: int, tables: int, bits: int, seed: int = 42) -> list:
    """Random +1/-1 projections, [table][bit][component]: the parity of an md5 digit of their place."""
    import hashlib
    sign = lambda *at: 1.0 if int(hashlib.md5("|".join(map(str, (seed, *at))).encode()).hexdigest()[0], 16) % 2 else -1.0
    return [[[sign(t, b, i) for i in range(dim)] for b in range(bits)] for t in range(tables)]


def lsh_buckets(vec: Column, planes: list) -> Column:
    """array<int>: per table the number made of the signs of its projections."""
    def bucket(table):
        total = F.lit(0)
        for b, plane in enumerate(table):
            dot = F.aggregate(F.zip_with(vec, F.lit(plane), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
            total = total + F.when(dot > 0, F.lit(1 << b)).otherwise(F.lit(0))
        return total
    return F.array(*[bucket(t) for t in planes])


def knn_lsh(queries: DataFrame, store: DataFrame, k: int, *, dim: int, q_id: str = "id", q_vec: str = "vec",
            s_id: str = "id", s_vec: str = "vec", tables: int = 8, bits: int = 6, seed: int = 42,
            exclude_self: bool = False, q_carry: tuple = (), s_carry: tuple = (),
            q_block_rows: int = 8192, s_block_rows: int = 8192, decimals: int = 9) -> DataFrame:
    """Approximate kNN join (K5): candidates are pairs that share a bucket of a table.

    A bucket is the signs of ``bits`` random projections taken together, so a table
    compares about ``2 ** -bits`` of all pairs; ``tables`` of them are merged.  The
    bucket is the cell key of the exact join, so a crowded one is split into blocks
    like a hot provider; candidates are scored exactly.  Projections come from md5,
    so any engine can repeat them.  Recall depends on how close neighbours are: a
    pair at angle a shares a bit with probability ``1 - a / pi``.
    """
    planes = sign_planes(dim, tables, bits, seed)

    def keyed(df, id_col, vec_col, idn, vecn, carry):
        return df.select(F.col(id_col).alias(idn), F.col(vec_col).alias(vecn), *carry,
                         F.posexplode(lsh_buckets(F.col(vec_col), planes)).alias("_table", "_bucket"))
    q = keyed(queries, q_id, q_vec, "_qid", "_qvec", q_carry)
    s = keyed(store, s_id, s_vec, "_sid", "_svec", s_carry)
    qg, sg, _ = _grid_cells(queries.sparkSession, q, s, ["_table", "_bucket"], q_block_rows, s_block_rows, 1)
    local = _scored(qg, sg, ["_table", "_bucket", "_qb", "_sb"], k=k, metric="l2sq", exclude_self=exclude_self,
                    decimals=decimals, q_carry=q_carry, s_carry=s_carry)
    # a pair can repeat across tables, so the merge always de-duplicates
    return merge_topk(local, k, decimals, dedup=True)


def _by_margin(tables: list, vecs: pd.Series) -> tuple:
    """Per row the buckets of all tables in the order they are probed: (table, bucket) arrays.

    A bucket costs the squared margins of the signs it turns (zero for the row's
    own), so the ones a near neighbour most likely fell into come first.
    """
    planes = np.array(tables, dtype=np.float64)
    bits = planes.shape[1]
    dots = np.einsum("nd,tbd->ntb", _stack(vecs), planes)
    place = 1 << np.arange(bits)
    codes = np.arange(1 << bits)
    cost = np.empty((len(dots), len(planes), len(codes)))
    for t in range(len(planes)):
        own = ((dots[:, t] > 0) * place).sum(axis=1)
        turned = ((own[:, None] ^ codes[None, :])[:, :, None] & place) > 0
        cost[:, t] = np.einsum("ncb,nb->nc", turned, dots[:, t] ** 2)
    order = np.argsort(cost.reshape(len(dots), -1), axis=1, kind="stable")
    return order // len(codes), order % len(codes)


# rows whose probing order is worked out at once (64 tables of buckets stay under 32 MiB)
_PROBE_ROWS = 512


def _probed(planes: list, probes: int):
    """Column function: the first ``probes`` buckets of a vector, numbered through all tables."""
    size = 1 << len(planes[0])

    @F.pandas_udf("array<int>")
    def probe(vecs: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(vecs), _PROBE_ROWS):
            table, bucket = _by_margin(planes, vecs.iloc[a:a + _PROBE_ROWS])
            out += list((table[:, :probes] * size + bucket[:, :probes]).astype(np.int32))
        return pd.Series(out, dtype=object)
    return probe


def calibrate_probes(queries: DataFrame, store: DataFrame, k: int, planes: list, *, q_id: str = "id", q_vec: str = "vec",
                     s_id: str = "id", s_vec: str = "vec", exclude_self: bool = False, recall: float = 0.95,
                     sample: int = 128) -> int:
    """How many buckets a query must probe for ``recall``, measured on exact neighbours.

    The exact k nearest stored vectors of ``sample`` queries (drawn by the hash of
    the id) are found by ``knn_join``.  A neighbour is found at the first place of the
    query's probing order that holds one of its buckets; the count is the
    ``recall`` quantile of those places.  The driver gets ``sample * k`` small numbers.
    """
    some = queries.orderBy(F.xxhash64(q_id), q_id).limit(sample).select(F.col(q_id).alias("id"), F.col(q_vec).alias("vec"))
    exact = knn_join(some, store.select(F.col(s_id).alias("id"), F.col(s_vec).alias("vec"),
                                        lsh_buckets(F.col(s_vec), planes).alias("_buckets")), k,
                     exclude_self=exclude_self, s_carry=("_buckets",), n_queries=sample)

    @F.pandas_udf("int")
    def place(vecs: pd.Series, buckets: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(vecs), _PROBE_ROWS):
            table, bucket = _by_margin(planes, vecs.iloc[a:a + _PROBE_ROWS])
            mine = np.stack(buckets.iloc[a:a + _PROBE_ROWS].to_numpy())
            out.append((np.take_along_axis(mine, table, axis=1) == bucket).argmax(axis=1) + 1)
        return pd.Series(np.concatenate(out) if out else [], dtype="int32")

    places = sorted(r[0] for r in exact.join(F.broadcast(some.withColumnRenamed("id", "qid")), "qid")  # ``sample`` rows
                    .select(place("vec", "_buckets")).collect())
    return places[math.ceil(recall * len(places)) - 1] if places else 1


def knn_multiprobe(queries: DataFrame, store: DataFrame, k: int, *, dim: int, q_id: str = "id", q_vec: str = "vec",
                   s_id: str = "id", s_vec: str = "vec", tables: int = 1, bits: int = 6, seed: int = 42,
                   probes: int | None = None, recall: float = 0.95, exclude_self: bool = False, q_carry: tuple = (),
                   s_carry: tuple = (), q_block_rows: int = 8192, s_block_rows: int = 8192,
                   decimals: int = 9) -> DataFrame:
    """Approximate kNN join with calibrated recall (K5): queries probe several buckets of few tables.

    A stored vector lies in one bucket a table; a query visits ``probes`` buckets in
    order of how little its projections would have to move.  Unless given, that
    number is measured (``calibrate_probes``).  Pairs are scored exactly, and each
    probed bucket is a cell of the exact join.
    """
    planes = sign_planes(dim, tables, bits, seed)
    if probes is None:
        probes = calibrate_probes(queries, store, k, planes, q_id=q_id, q_vec=q_vec, s_id=s_id, s_vec=s_vec,
                                  exclude_self=exclude_self, recall=recall)
    q = (queries.select(F.col(q_id).alias("_qid"), F.col(q_vec).alias("_qvec"), *q_carry)
                .withColumn("_p", F.explode(_probed(planes, probes)("_qvec")))
                .withColumn("_table", F.shiftright("_p", bits)).withColumn("_bucket", F.col("_p").bitwiseAND(F.lit((1 << bits) - 1))).drop("_p"))
    s = store.select(F.col(s_id).alias("_sid"), F.col(s_vec).alias("_svec"), *s_carry,
                     F.posexplode(lsh_buckets(F.col(s_vec), planes)).alias("_table", "_bucket"))
    qg, sg, _ = _grid_cells(queries.sparkSession, q, s, ["_table", "_bucket"], q_block_rows, s_block_rows, 1)
    local = _scored(qg, sg, ["_table", "_bucket", "_qb", "_sb"], k=k, metric="l2sq", exclude_self=exclude_self,
                    decimals=decimals, q_carry=q_carry, s_carry=s_carry)
    return merge_topk(local, k, decimals, dedup=tables > 1)
