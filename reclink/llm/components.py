"""Connected components of an edge table: forests inside partitions, then alternating stars.

First every partition replaces its edges by a spanning forest (union-find over at most
``forest_edges`` edges at a time), which leaves no more edges than nodes.  While a round
of that, over fewer partitions, still removes much, it is repeated; when all that is
left fits ``forest_edges``, one task ends the work.  Else alternating large and small
stars go on: joins and aggregates on the edges, nothing gathered.  Stars of any size are
spread: minima are combined before the shuffle, and the rows of a node with very many
neighbours are salted before they meet its minimum.  Every step is written to the shared
folder, so a lost executor costs a re-read.

Defined cases: edges with a null end and loops are left out; repeated edges count once;
no edges give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import stored

FOREST_EDGES = 1 << 20  # edges of one union-find: 16 MB, and a dictionary of their nodes


def _roots(u: np.ndarray, v: np.ndarray):
    """(nodes, least node of the component of each) of the edges."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[:len(u)], code[len(u):]
    up = np.arange(len(nodes))
    while True:  # hook roots to smaller ones, then halve the paths, until no edge joins two trees
        x, y = up[a], up[b]
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        apart = hi != lo
        if not apart.any():
            return nodes, nodes[up]
        np.minimum.at(up, hi[apart], lo[apart])
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher


def _forest(e: DataFrame, parts: int, most: int) -> DataFrame:
    """(u, v) edges that connect what ``e`` connects: stars to the least node of each partition's components."""
    def run(batches):
        held, size = [], 0

        def out():
            u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            nodes, least = _roots(u, v)
            rest = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(least[rest])], names=["u", "v"])
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                size += b.num_rows
            if size >= most:
                yield out()
                held, size = [], 0
        if held:
            yield out()
    return e.repartition(parts, "v").mapInArrow(run, "u long, v long") if parts > 1 else e.coalesce(1).mapInArrow(run, "u long, v long")


def _with_least(e: DataFrame, total: int) -> DataFrame:
    """Adds to (u, v) rows m, the least v of their u; a u with many rows is salted.

    At most 2 * total / (total / 1000) = 2,000 nodes have more than ``many`` rows, so
    their table is broadcast.
    """
    many = max(256, total // 1000)
    least = e.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    salts = F.when(F.col("deg") > many, F.ceil(F.col("deg") / many).cast("int")).otherwise(1)
    heavy = least.where(F.col("deg") > many).select(F.col("c").alias("h"), salts.alias("salts"))
    rows = (e.join(F.broadcast(heavy), F.col("u") == F.col("h"), "left")
            .withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")))
    copies = least.select("c", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("cs"))
    return rows.join(copies, (F.col("u") == F.col("c")) & (F.col("salt") == F.col("cs"))).select("u", "v", "m")


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """(u, v), u > v: each neighbour larger than a node goes to the node's least neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both, total).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to its least neighbour."""
    joined = _with_least(e, total)
    return (joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame, most: int = 60, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """(u, v) edges -> (node, component): the least node reachable, for nodes with an edge to a smaller one.

    Nodes that are their own component are not listed.
    """
    e = stored(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
               .where("u <> v").distinct(), "edges")
    named = lambda d: d.select(F.col("u").alias("node"), F.col("v").alias("component"))
    n = e.count()
    while n > forest_edges:  # fewer edges in every round, or stars
        e = stored(_forest(e, -(-2 * n // forest_edges), forest_edges).distinct(), "edges")
        left = e.count()
        if left > 0.7 * n:
            break
        n = left
    else:
        return named(stored(_forest(e, 1, max(n, 1)), "edges")) if n else named(e)
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(e)
    for _ in range(most):
        if not seen[0]:
            break
        e = stored(_small_star(_large_star(e, seen[0]), seen[0]), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return named(e)
