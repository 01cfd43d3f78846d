"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source is cut into blocks of ``block_docs`` documents.  With weight w, block
j is released at slot ``floor(j / w)`` and due by ``ceil((j + 1) / w)``;
earliest-deadline-first among the released blocks fills every slot with one block
and meets every deadline, so after any number of slots t a source has been given
more than ``w * t - 1`` and less than ``w * t + 1`` blocks.  With one document a
block, that holds to the document; larger blocks keep documents of a
source together, and a source smaller than a block fills it by repeating.

The weights are taken as given: releases and deadlines are whole numbers computed from
exact fractions, and the schedule is walked once, block by block, on the driver.  That
table is bounded: ``max_blocks`` (a documented parameter) slots at most.  A corpus of
more documents takes them in blocks of as many as it needs, at every size the same
schedule with the same bound of less than one block.

The mix runs until every document of every source has been placed at least once;
sources that are used up start over (``epoch`` 1, 2, ...), none is cut off.  A
document's rank in its source comes from counts per (source, hash bucket) and a
row number inside the bucket, so a source with a third of all rows is spread over
many tasks.

Defined cases: a null source is a source of its own; sources without a given
weight are an error, as are weights so small that the schedule could not place a source
within ``max_blocks``; weights of absent sources are left out; null ids and texts
are rows like others; exact repeats of a row are placed each; an empty table gives
no rows; all other columns are carried as one struct and can't clash.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions

MAX_SOURCES = 20_000  # bound of the driver's weight table


def exact_weights(weights: dict) -> tuple[dict, int]:
    """({source: numerator}, denominator) of the given weights as exact fractions of their sum."""
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = {s: Fraction(w) for s, w in weights.items()}
    bottom = lcm(*[p.denominator for p in parts.values()]) if parts else 1
    tops = {s: int(p * bottom) for s, p in parts.items()}
    return tops, sum(tops.values())


def schedule(weights: dict, slots: int):
    """The first ``slots`` slots, one by one: (source, block, slot, release, deadline), earliest deadline first."""
    tops, total = exact_weights(weights)
    names = list(tops)
    top = [tops[s] for s in names]
    ahead = [(0, n, 0) for n in range(len(names))]  # (release, source, block) to come
    ready = []
    for slot in range(slots if names else 0):
        while ahead and ahead[0][0] <= slot:
            r, n, j = heapq.heappop(ahead)
            heapq.heappush(ready, (-(-(j + 1) * total // top[n]), n, j, r))
        d, n, j, r = heapq.heappop(ready)
        heapq.heappush(ahead, ((j + 1) * total // top[n], n, j + 1))
        yield names[n], j, slot, r, d


def source_counts(docs: DataFrame, source_col: str = "source") -> dict:
    """Rows per source; at most MAX_SOURCES."""
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: r["count"] for r in rows}


def temper(counts: dict, alpha: float) -> dict:
    """Target weights in proportion to ``count ** alpha``: below 1 lifts small sources."""
    raw = {s: n ** alpha for s, n in counts.items() if n}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def mix(docs: DataFrame, weights: dict, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", block_docs: int = 1, max_blocks: int = 400_000,
        bucket_rows: int = 2_000) -> DataFrame:
    """One row per placement: pos, slot, epoch, block, release, deadline, source, row (all columns).

    ``pos`` numbers the mix without gaps from 0.  ``block_docs`` is raised to what keeps
    the schedule within ``max_blocks`` slots.
    """
    spark = docs.sparkSession
    counts = source_counts(docs, source_col)
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for {len(missing)} sources, for example {missing[0]!r}")
    weights = {s: weights[s] for s in sorted(counts, key=lambda s: (s is None, s))}
    tops, total = exact_weights(weights)
    # the slot by which the last needed block of every source is due
    due = lambda size: max((-(-(-(-n // size)) * total // tops[s]) for s, n in counts.items()), default=0)
    while due(block_docs) > max(max_blocks, 2 * len(counts)):
        if block_docs >= max(counts.values()):
            raise ValueError(f"a weight is too small for a schedule of {max_blocks} blocks")
        block_docs = max(block_docs + 1, block_docs * due(block_docs) // max(max_blocks, 2 * len(counts)))
    number = {s: i for i, s in enumerate(weights)}
    plan = [array("q") for _ in range(5)]
    for s, *rest in schedule(weights, due(block_docs)):
        for column, x in zip(plan, (number[s], *rest)):
            column.append(x)
    given = Counter(plan[0])
    draws = [(s, i, counts[s], given[i] * block_docs) for s, i in number.items()]
    per_source = F.broadcast(spark.createDataFrame(draws, "src string, nr_src long, n long, draws long"))
    table = F.broadcast(spark.createDataFrame(pa.table({c: np.frombuffer(a, np.int64) for c, a in zip(("tsrc", "k", "at", "r", "d"), plan)})))

    # enough buckets that those of one large source fill all tasks evenly
    n_buckets = max(-(-max(sum(counts.values()), 1) // bucket_rows), 4 * shuffle_partitions(spark))
    rows = docs.select(F.col(source_col).cast("string").alias("src"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.struct("*").alias("row"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("int"))
    bases = (rows.groupBy("src", "bucket").count()
             .withColumn("base", F.coalesce(F.sum("count").over(
                 Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .select(F.col("src").alias("bsrc"), F.col("bucket").alias("bbucket"), "base"))
    ranked = rows.withColumn("nr", F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "id")))
    ranked = (ranked.join(bases, F.col("src").eqNullSafe(F.col("bsrc")) & (F.col("bucket") == F.col("bbucket")))
              .withColumn("rank", F.col("base") + F.col("nr") - 1).drop("bsrc", "bbucket"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    p = per_source.withColumnRenamed("src", "psrc")
    drawn = (ranked.join(p, same("src", "psrc"))
             .withColumn("epoch", F.explode(F.expr("sequence(0L, (draws - 1 - rank) div n)")))
             .withColumn("i", F.col("rank") + F.col("epoch") * F.col("n"))
             .withColumn("block", F.expr(f"i div {block_docs}")))
    return (drawn.join(table, (F.col("nr_src") == F.col("tsrc")) & (F.col("block") == F.col("k")))
            .select((F.col("at") * block_docs + F.pmod("i", F.lit(block_docs))).alias("pos"), F.col("at").alias("slot"), "epoch", "block",
                    F.col("r").alias("release"), F.col("d").alias("deadline"), F.col("src").alias("source"), "row"))
