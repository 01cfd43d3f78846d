"""Small relational helpers named in the operator inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def distinct_links(df: DataFrame, ids_col: str = "projId", out: str = "proj_id") -> DataFrame:
    """A3: the distinct ids of an array column (explode + distinct, partial aggregate)."""
    return df.select(F.explode(ids_col).alias(out)).distinct()


def step_counts(df_in: DataFrame, step) -> tuple:
    """Run ``step`` and report (rows in, rows out) from one pass each.

    The counts are collected as Observations while the data flows, so no
    extra job re-reads the input.
    """
    obs_in, obs_out = Observation("in"), Observation("out")
    src = df_in.observe(obs_in, F.count(F.lit(1)).alias("n"))
    out = step(src).observe(obs_out, F.count(F.lit(1)).alias("n"))
    out.write.format("noop").mode("overwrite").save()
    return obs_in.get["n"], obs_out.get["n"], out


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """L4: first n rows in a stated order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, by, order, k: int, rank_col: str = "rank") -> DataFrame:
    """K rows per group; ``row_number() <= k`` is limited per partition before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if not isinstance(order, (list, tuple)) else list(order)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def sorted_distinct(c) -> F.Column:
    """Sorted distinct values of an array column."""
    return F.array_sort(F.array_distinct(F.col(c) if isinstance(c, str) else c))


def append_batches(*dfs: DataFrame) -> DataFrame:
    """Append row batches, aligning columns by name (missing ones become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def join_stores(a: DataFrame, b: DataFrame, key: str = "id", suffixes=("_a", "_b")) -> DataFrame:
    """Pair two stores by id (never by row position)."""
    ra = a.select(key, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c != key])
    rb = b.select(key, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c != key])
    return ra.join(rb, key, "inner")
