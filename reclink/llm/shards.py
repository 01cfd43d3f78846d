"""Sharding: contiguous, byte-balanced shards from global prefix sums.

Sizes and digests are taken in one pass over the texts and written as a narrow
table.  Its rows are put in key order by a range partitioning and written with
the number of their partition.  Totals of the partitions (one row each) give every
partition its base; a running sum inside the partition gives each row its global
byte offset; the offset decides the shard: ``floor(offset * n / total)``.  Shards
are contiguous in key order and differ from the target by less than one row.
Nothing but per-partition totals and per-shard starts is gathered.

Only DataFrame functions are used.  The order is (key, crc32, size) and a row
number of the scan, so that many rows of one key still spread over partitions.

Defined cases: null text has size 1 and crc32 0; null keys sort first; repeated
rows each get their own slot; an empty table gives no rows; extra columns are
ignored by ``shard_by_bytes`` and kept by ``with_shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions, stored


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc")).withColumn("nth", F.monotonically_increasing_id())
    key = ["id", "crc", "size", "nth"]
    # The range partitioning samples its input first; from a table, that costs no second pass over the texts.
    parts = stored(stored(rows, "shard-sizes").repartitionByRange(shuffle_partitions(docs.sparkSession), *key)
                   .withColumn("part", F.spark_partition_id()), "shard-rows")
    # One row per partition: bases by prefix sums, and the total.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    bases = (parts.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
             .select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"),
                     F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_rows"),
                     F.sum("b").over(everything).alias("total")))
    inside = Window.partitionBy("part").orderBy(*key)
    placed = (parts.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("nr", F.row_number().over(inside))
              .join(F.broadcast(bases), "part")
              .withColumn("offset", F.col("base") + F.col("run") - F.col("size"))
              .withColumn("nth_row", F.col("base_rows") + F.col("nr") - 1)
              # floor(offset * n / total) without leaving 64 bits
              .withColumn("shard", F.expr(f"cast(cast(offset as decimal(38,0)) * {n_shards} div total as int)")))
    starts = placed.groupBy("shard").agg(F.min("nth_row").alias("first"))  # one row per shard
    out = (placed.join(F.broadcast(starts), "shard")
           .withColumn("slot", F.col("nth_row") - F.col("first")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def with_shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``shard``, without moving the texts.

    The least (key, crc32, size) of each shard (one row per shard) is a constant of
    the plan, and rows compare themselves with these; rows equal in all three go to
    one shard.
    """
    cuts = (shard_by_bytes(docs, n_shards, id_col, text_col)
            .groupBy("shard").agg(F.min(F.struct(F.col(id_col).cast("long").alias("i"), F.col("text_crc32").alias("c"), F.col("size").alias("s"))).alias("k"))
            .orderBy("shard").collect())
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).cast("long"), F.crc32(text.cast("binary")), (F.octet_length(text) + 1).cast("long"))
    shard = F.lit(0)
    for r in cuts:
        at = F.struct(*[F.lit(r["k"][f]).cast("long") for f in "ics"])
        shard = F.when(key >= at, F.lit(r["shard"])).otherwise(shard)
    return docs.withColumn("shard", shard)
