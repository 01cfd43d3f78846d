"""Incremental page ingest (ST1): new page files -> parse -> curate -> embed -> store.

A file-source stream remembers in its checkpoint which page files it has
processed, so re-running picks up only new pages.  ``availableNow`` drains
what is there and stops; each micro-batch is written as its own idempotent
partition of the store's batch log.

The stream's state holds a digest of every page it has seen, by export: a page that
is delivered again under another name, in a later batch or after a restart, is left
out.  Pages and records that give no store row (faults, broken pages, records without
id, title or abstract) go to a table of rejects, written like the store.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators.curate import PROJECT_MIN, PUBLICATION_MIN, min_length
from reclink.operators.embed import embed_records
from reclink.session import scratch_path
from reclink.sources import store as st
from reclink.sources import xml_pages as xp


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id kept beside a stream's checkpoint: the same when it resumes, a new one for a new checkpoint."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(checkpoint.rstrip("/") + "/stream-id")
    fs = mark.getFileSystem(conf)
    if not fs.exists(mark):
        out = fs.create(mark, False)
        out.writeBytes(uuid.uuid4().hex)
        out.close()
    got = fs.open(mark)
    try:
        return got.readLine()
    finally:
        got.close()


# the folder of a page is its export, the number before ".xml" its page number
EXPORT_PATTERN = r"^(.*)/[^/]*$"
PAGE_PATTERN = r"page(\d+)\.xml$"


def page_stream(spark: SparkSession, src_dir: str, max_files: int | None = None, export_pattern: str = EXPORT_PATTERN,
                page_pattern: str = PAGE_PATTERN) -> DataFrame:
    """Streaming page rows ``export, path, page_no, xml`` from a folder of page files.

    The patterns take export and page number (their first group) from the file's path.
    """
    r = spark.readStream.format("text").option("wholetext", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    raw = r.load(src_dir)
    fp = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(fp, export_pattern, 1).alias("export"), fp.alias("path"),
                      F.regexp_extract(fp, page_pattern, 1).try_cast("int").alias("page_no"),
                      F.col("value").alias("xml"))


def new_pages(pages: DataFrame) -> DataFrame:
    """Pages of a stream that their export has not delivered before, by content.

    The state keeps a 128-bit digest a page, spread by (export, digest).  Of equal
    pages within a batch any one is taken; they hold the same records.
    """
    return pages.withColumn("_digest", F.md5("xml")).dropDuplicates(["export", "_digest"]).drop("_digest")


def parse_batch(pages: DataFrame, entity: str = "project") -> DataFrame:
    return xp.parse_pages(pages, entity, "ascii" if entity == "project" else "unicode")


def _key_of(entity: str, key: str | None) -> str:
    """the record column that becomes the id."""
    return key or ("projId" if entity == "project" else "id")


def _curate_records(recs: DataFrame, entity: str, template: str, embedder, key: str | None) -> DataFrame:
    recs, key = min_length(recs, PROJECT_MIN if entity == "project" else PUBLICATION_MIN), _key_of(entity, key)
    recs = recs if key == "id" else recs.drop("id").withColumnRenamed(key, "id")
    v = embed_records(recs, template, embedder, title="title", abstract="abstract")
    return v.select("id", "vec", "doc", "dataProvider", F.array_join("participants", ", ").alias("participants"))


def curate_parsed(parsed: DataFrame, entity: str = "project", template: str = "plain", embedder=None,
                  key: str | None = None) -> DataFrame:
    """Extract, length-filter, render, embed -> store rows ``id, vec, doc, ...``; F20: ``key`` is
    the record column that becomes the id."""
    recs = xp.extract_projects(parsed) if entity == "project" else xp.extract_publications(parsed, entity)
    return _curate_records(recs, entity, template, embedder, key)


def curate_batch(pages: DataFrame, entity: str = "project", template: str = "plain", embedder=None,
                 key: str | None = None) -> DataFrame:
    """One micro-batch: parse, extract, length-filter, render, embed -> store rows."""
    return curate_parsed(parse_batch(pages, entity), entity, template, embedder, key)


def ingest(spark: SparkSession, src_dir: str, store_path: str, checkpoint: str | None = None,
           entity: str = "project", template: str = "plain", embedder=None, max_files: int | None = None,
           rejects_path: str | None = None, key: str | None = None, export_pattern: str = EXPORT_PATTERN,
           page_pattern: str = PAGE_PATTERN):
    """Run the ingest stream until the folder is drained (availableNow); returns the query.

    The default checkpoint is named by source, store (full paths) and entity.  The
    partitions a stream writes carry the name of its checkpoint, so several streams
    can feed one store, and a stream begun anew never overwrites an earlier one's.
    With ``rejects_path`` what a batch leaves out is written there, one partition a batch.
    """
    name = hashlib.md5("\n".join([src_dir.rstrip("/"), store_path.rstrip("/"), entity]).encode()).hexdigest()
    checkpoint = checkpoint or scratch_path(spark, "ingest-" + name)
    stream = stream_id(spark, checkpoint)

    def write(batch: DataFrame, epoch_id: int):
        # one pass over the stream's state, its pages and their texts feeds both tables
        told, used = ["export", "page_no", "uuid", "reason"], {_key_of(entity, key), "title", "abstract", "dataProvider", "participants"}
        rows = xp.outcomes(parse_batch(batch, entity), entity).select(*told, *sorted(used)).persist()
        try:
            st.append_batch(_curate_records(rows.where("reason IS NULL").drop(*told), entity, template, embedder, key), store_path, epoch_id, stream)
            if rejects_path:
                st.append_batch(rows.where("reason IS NOT NULL").select(*told), rejects_path, epoch_id, stream)
        finally:
            rows.unpersist()

    q = (new_pages(page_stream(spark, src_dir, max_files, export_pattern, page_pattern)).writeStream
         .foreachBatch(write)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q
