"""Title search over postings of trigrams (P6 where titles are many and searched often).

``build`` writes two tables: ``postings`` (trigram -> id, in folders by the hash of the
trigram) and ``titles`` (in folders by the hash of the id).  ``search`` reads the postings
of the query's trigrams, keeps the ids that have them all, reads those ids' titles and
tests them with the very condition of ``title_search``: same rows, no scan of all titles.

A query under three characters has no trigram and one given as a regular expression no
fixed ones: both scan the titles table.  Null titles never match; an empty query gives
no rows; equal (id, title) rows are each returned, as in the scan.  Case is folded per
character by ``lower`` on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators.search import title_search
from reclink.sources import store as st

#: folders of each table
FOLDERS = 32
#: characters of titles a part of a folder, about as many postings: a folder is written by as many tasks as it has
#: parts, each of which sorts one part, so the memory of a task does not grow with the table
PART_CHARS = 4_000_000


def trigrams(title) -> Column:
    """The distinct trigrams of a lower-cased title; none under three characters.

    A look-ahead finds overlapping ones in a single pass, however long the title is.
    """
    t = F.lower(F.col(title) if isinstance(title, str) else title)
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(...))"), F.lit(1)))


def _folder(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FOLDERS)).cast("int")


def build(records: DataFrame, path: str, title: str = "title", key: str = "id") -> None:
    rows = records.where(F.col(title).isNotNull()).select(F.col(key).alias("id"), F.col(title).alias("title"))
    chars = rows.agg(F.sum(F.length("title"))).first()[0] or 0
    parts = 1 + chars // (FOLDERS * PART_CHARS)
    part = F.pmod(F.xxhash64("id", "title", F.lit("part")), F.lit(parts)).cast("int")

    def write(df: DataFrame, by: str, name: str) -> None:
        (df.withColumn("folder", _folder(by)).repartitionById(FOLDERS * parts, F.col("folder") * parts + F.col("_part")).drop("_part")
           .sortWithinPartitions("folder", by).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{name}"))
    rows = rows.withColumn("_part", part)
    write(rows, "id", "titles")
    write(rows.select("id", "_part", F.explode(trigrams("title")).alias("gram")), "gram", "postings")


def candidates(spark: SparkSession, path: str, q: str) -> DataFrame:
    """Ids whose titles hold every trigram of ``q`` (of three characters or more)."""
    # the query's own trigrams, made by the same expression: at most its length
    grams = spark.range(1).select(F.explode(trigrams(F.lit(q))).alias("g"), _folder("g").alias("f")).collect()
    post = (st.read(spark, f"{path}/postings").where(F.col("folder").isin(sorted({r.f for r in grams})))
              .where(F.col("gram").isin([r.g for r in grams])))
    # an id may have several titles, so different trigrams are counted
    return post.select("id", "gram").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id")


def search(spark: SparkSession, path: str, q: str, n: int = 10, literal: bool = True) -> DataFrame:
    titles = st.read(spark, f"{path}/titles")
    if literal and q and len(q) >= 3:
        ids = candidates(spark, path, q).select(F.col("id").alias("_id"), _folder("id").alias("_folder"))
        # a row a title: the folders of the candidates prune the scan at run time
        titles = titles.join(ids, (F.col("folder") == F.col("_folder")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return title_search(titles, q, n, literal)
