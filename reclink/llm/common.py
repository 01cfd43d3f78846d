"""Helpers shared by the operators: tables, shared scratch folder, small HOF idioms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without localCheckpoint: a lost executor costs a re-read,
    and values such as ``spark_partition_id()`` are fixed from here on.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and hand it to ``body`` (a lambda variable is not inlined)."""
    return F.transform(F.array(expr), body)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(lens: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array<int>, in O(k * block + (k/block)^2) steps.

    Sums of blocks first, so that an array of many thousands of entries does not
    cost the square of its length.  NULL or empty arrays give an empty array.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.size(lens)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                         lambda b: total(F.slice(lens, b * block + 1, block)))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(let(blocks, lambda bs: let(
        F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: total(F.slice(bs, F.lit(1), b))),
        lambda base: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(base, F.floor(i / block).cast("int"))
            + total(F.slice(lens, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block))))))))


def grouped(batches, keys: list[str]):
    """(key tuple, list of row dicts) of each run of equal keys in sorted Arrow batches.

    Holds one group at a time; callers see to it that groups are bounded.
    """
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows
