"""Keyed store in id buckets with compaction (S9, S10 for stores that are written often).

Rows lie in folders ``rows/bucket=B/version=V``: B from the hash of the id, V one
higher with every write.  A write adds its rows and touches nothing else; a reader
merges inside the buckets that hold several versions and passes the others as they
are, without a join.  ``compact`` rewrites just the buckets with several versions and
then names the new version as their base (``bases/version=V``); should it fail
between the two, readers still get the same rows.  ``vacuum`` frees what no reader of
the bases looks at any more.

One writer at a time.  Writing a version again replaces it, so a retried batch is
harmless.  Rows without an id are left out.  Of ids repeated in a batch the last by
``order`` is taken, else the greatest row.  The number of buckets and the type of the
id may not change during the life of a store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.sources import store as st


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = path.rstrip("/")
        self.rows_path, self.bases_path, self.empty_path = (f"{self.path}/{d}" for d in ("rows", "bases", "empty"))

    def bucket_of(self, c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    # ---- what is there

    def _rows(self) -> DataFrame:
        return st.read(self.spark, self.rows_path)

    def versions(self) -> dict:
        """{bucket: its live versions, ascending}: a few numbers a bucket, from the folder names."""
        if not self._any():
            return {}
        out: dict = {}
        bases = self.bases()
        for b, v in self._rows().select("bucket", "version").distinct().collect():
            if v >= bases.get(b, 0):
                out.setdefault(b, []).append(v)
        return {b: sorted(vs) for b, vs in out.items()}

    def bases(self) -> dict:
        if not self._exists(self.bases_path):
            return {}
        rows = st.read(self.spark, self.bases_path).groupBy("bucket").agg(F.max("version")).collect()  # a row a bucket
        return {r[0]: r[1] for r in rows}

    def next_version(self) -> int:
        if not self._any():
            return 1
        return int(self._rows().agg(F.max("version")).first()[0]) + 1

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _any(self) -> bool:
        fs, p = self._fs(f"{self.rows_path}/bucket=*")
        return bool(fs.globStatus(p))

    # ---- writing

    def upsert(self, batch: DataFrame, order: str | None = None, version: int | None = None) -> None:
        """The batch's rows replace stored rows of their ids."""
        new = st.last_of_batch(batch.where(F.col(self.key).isNotNull()), self.key, order)
        self._put(new.drop(order) if order else new, version or self.next_version())

    def append(self, batch: DataFrame, order: str | None = None, version: int | None = None) -> None:
        """Rows whose id is stored already are ignored; only ids of the batch's buckets are read."""
        if self._any():
            touched = [r[0] for r in batch.select(self.bucket_of(self.key)).distinct().collect()]  # at most all buckets
            stored = self._rows().where(F.col("bucket").isin(touched)).select(self.key)
            batch = batch.join(stored, self.key, "left_anti").select(*batch.columns)
        self.upsert(batch, order, version)

    def _put(self, rows: DataFrame, version: int) -> None:
        if not st.exists(self.spark, self.empty_path):
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(self.empty_path)
        # ids are hashed, so buckets are even and each is written by one task as one file
        (rows.withColumn("bucket", self.bucket_of(self.key)).repartition("bucket").withColumn("version", F.lit(version))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "version").parquet(self.rows_path))

    def compact(self) -> list:
        """Rewrite the buckets that hold several versions as one; returns them."""
        many = sorted(b for b, vs in self.versions().items() if len(vs) > 1)
        if many:
            version = self.next_version()
            self._put(self.current(many), version)
            bases = self.spark.createDataFrame([(b,) for b in many], "bucket int").coalesce(1).withColumn("version", F.lit(version))
            (bases.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(self.bases_path))
        return many

    def vacuum(self) -> int:
        """Delete the versions below their bucket's base; returns how many."""
        n = 0
        if self._any():
            bases = self.bases()
            for b, v in self._rows().select("bucket", "version").distinct().collect():
                if v < bases.get(b, 0):
                    fs, p = self._fs(f"{self.rows_path}/bucket={b}/version={v}")
                    n += bool(fs.delete(p, True))
        return n

    # ---- reading

    def current(self, buckets: list | None = None) -> DataFrame:
        """The latest row of every id, of all or the given buckets.

        Buckets of one version are a plain scan.  In the others the latest version of an
        id is found on numbers alone, and the rows are joined to it.
        """
        live = {b: vs for b, vs in self.versions().items() if buckets is None or b in buckets}
        if not live:
            return st.read(self.spark, self.empty_path)
        rows = self._rows()
        cols = [c for c in rows.columns if c not in ("bucket", "version")]

        def of(some: dict) -> DataFrame:
            by_first: dict = {}
            for b, vs in some.items():
                by_first.setdefault(vs[0], []).append(b)
            return rows.where(reduce(lambda x, y: x | y, [(F.col("version") >= v) & F.col("bucket").isin(bs)
                                                          for v, bs in sorted(by_first.items())]))
        one = {b: vs for b, vs in live.items() if len(vs) == 1}
        many = {b: vs for b, vs in live.items() if len(vs) > 1}
        parts = [of(one).select(*cols)] if one else []
        if many:
            merged = of(many)
            newest = merged.groupBy(F.col(self.key).alias("_k")).agg(F.max("version").alias("_v"))
            parts.append(merged.join(newest, (F.col(self.key) == F.col("_k")) & (F.col("version") == F.col("_v")), "left_semi")
                               .select(*cols))
        return reduce(DataFrame.unionByName, parts)

    def lookup(self, value) -> DataFrame:
        """P5 on the store: the row of one id, from its bucket alone."""
        typed = F.lit(value).cast(st.read(self.spark, self.empty_path).schema[self.key].dataType)
        bucket = self.spark.range(1).select(self.bucket_of(typed)).first()[0]
        return self.current([bucket]).where(F.col(self.key) == typed)
