"""Keyed Parquet vector store.

A store is a DataFrame ``id, vec, doc, meta...`` persisted as Parquet.  Writes
are DataFrame transformations (upsert = the batch wins, append =
insert-only) followed by a rewrite into a fresh folder; the only driver work
is choosing the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_of_batch(batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row per id of a batch: the last by ``order``, else the greatest row.

    Only keys that repeat are looked at again; the others pass by an anti join.
    """
    again = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    rest = [c for c in batch.columns if c != key]
    first = [order] + [c for c in rest if c != order] if order else rest
    picked = (batch.join(again, key, "left_semi")
                   .groupBy(key).agg(F.max(F.struct(*first)).alias("_row"))
                   .select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*batch.columns))
    return batch.join(again, key, "left_anti").select(*batch.columns).unionByName(picked)


def upsert(store: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The stored rows whose id is not in the batch, and the batch.

    An anti join: stored vectors are neither sorted nor aggregated, and a batch that
    is small enough is broadcast by the optimizer.  Of ids repeated in the batch the
    last by ``order`` (a column of the batch; else the greatest row) is taken.
    """
    new = last_of_batch(batch, key, order).select(*store.columns)
    return store.join(new.select(key), key, "left_anti").select(*store.columns).unionByName(new)


def append(store: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Insert-only; rows whose id is already stored are ignored, ids repeated in
    the batch are stored once (as in ``upsert``)."""
    new = last_of_batch(batch.join(store.select(key), key, "left_anti").select(*batch.columns), key, order)
    return store.unionByName(new.select(*store.columns))


def scan(store: DataFrame, fields=None, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Column-pruned scan, optionally restricted to an id list (semi join)."""
    out = store
    if ids is not None:
        out = out.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    if fields:
        out = out.select(key, *[f for f in fields if f != key])
    return out


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Persist a store (S8-style sink for vectors); optional partitioning for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a completely written table (its ``_SUCCESS`` mark, by Hadoop's file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def convert(store: DataFrame, path: str, layout: str = "by_provider", provider: str = "dataProvider",
            key: str = "id") -> None:
    """Re-materialise a store in a second layout, carrying the id as ``doc_id``.

    ``by_provider`` partitions by a copy of the provider (``by_<provider>``): as a
    folder name an empty provider would be read back as null.
    """
    out = store.withColumn("doc_id", F.col(key))
    if layout == "by_provider":
        write(out.withColumn(f"by_{provider}", F.col(provider)), path, partition_by=f"by_{provider}")
    else:
        write(out.repartition(F.col(key)), path)


def cached(spark: SparkSession, path: str, compute, source: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Materialise once.

    Without ``source``: read ``path`` if present, else ``compute()`` and write.
    With ``source``: incremental -- only source rows whose id is not yet stored
    are passed to ``compute`` and appended, so the store grows with the input.
    A folder that a failed first write left behind counts as absent.
    """
    if not exists(spark, path):
        write(compute(source) if source is not None else compute(), path)
        return read(spark, path)
    if source is None:
        return read(spark, path)
    have = read(spark, path).select(key)
    todo = source.join(have, key, "left_anti")
    write(compute(todo), path, mode="append")
    return read(spark, path)


def materialize_once(spark: SparkSession, path: str, compute, source: DataFrame, params: str = "",
                     fp: str = "_fp") -> DataFrame:
    """S13 by content: a row is computed once for its values and ``params``.

    Every source row gets a fingerprint: md5 of all its columns and ``params`` (what
    the result depends on besides, such as a model's name).  Rows whose fingerprint is
    not stored go through ``compute``, which keeps the column ``fp``, and are appended.
    What is returned are the stored rows of the present source: a changed text is
    computed anew and its old row no longer seen, rows gone from the source go, and
    a row that comes back is not computed again.  Equal source rows are one row.

    Both joins carry fingerprints of 32 characters; only rows to be computed are
    exchanged.  An append that fails leaves nothing behind.
    """
    values = F.to_json(F.struct(*[F.col(c) for c in source.columns]))
    marked = source.withColumn(fp, F.md5(F.concat(values, F.lit("\n" + params))))
    if exists(spark, path):
        todo = marked.join(read(spark, path).select(fp), fp, "left_anti").select(*marked.columns)
        write(compute(todo.dropDuplicates([fp])), path, mode="append")
    else:
        write(compute(marked.dropDuplicates([fp])), path)
    return read(spark, path).join(marked.select(fp), fp, "left_semi").drop(fp)


def append_batch(df: DataFrame, path: str, batch_id: int, stream: str = "batch") -> None:
    """Write one batch of store rows as partition ``stream=S/batch_id=N``.

    Re-running a batch (a retried task or stream epoch) overwrites only its own
    partition, so the write is idempotent, and two streams never share one;
    readers resolve versions with ``current``.
    """
    (df.withColumn("written_at", F.current_timestamp()).withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(int(batch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("stream", "batch_id").parquet(path))


def current(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Latest version of every id across the batch log (S9 semantics on read).

    Later batches win within a stream, later writes across streams.
    """
    return upsert_log(read(spark, path), key)


def upsert_log(log: DataFrame, key: str = "id") -> DataFrame:
    """One row per id.  The winner is found on (id, version) alone, a hash aggregate of
    numbers; the rows themselves are only joined."""
    rest = [c for c in log.columns if c not in (key, "batch_id", "stream", "written_at")]
    when = F.unix_micros("written_at") if "written_at" in log.columns else F.lit(0).cast("long")
    log = log.withColumn("_v", when).withColumn("_b", F.col("batch_id").cast("long"))
    newest = log.groupBy(key).agg(F.max("_v").alias("_mv"))
    latest = (log.join(newest, key).where("_v = _mv"))
    top = latest.groupBy(key).agg(F.max("_b").alias("_mb"))
    return last_of_batch(latest.join(top.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).where("_b = _mb")
                         .select(key, *rest), key)
