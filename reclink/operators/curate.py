"""Record curation: length filters, boilerplate removal, null drops, keep-first
de-duplication and the merge of publications sharing a title (P1-P4, A1-A3).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the two boilerplate project abstracts excluded from the legacy export
BOILERPLATE_ABSTRACTS = [
    "A BOF-ZAP professorship granted by the Special Research Fund is a primarily research-oriented "
    "position and is made available for excellent researchers with a high-quality research programme.",
    "A BOF-TT mandate holder receives an appointment as a Tenure Track with mainly research assignment. "
    "The salary costs are charged to the Special research Fund (BOF).",
]

# fixed values: minimum lengths (characters) used by the curation steps
PROJECT_MIN = {"abstract": 150, "title": 5}
PUBLICATION_MIN = {"abstract": 50, "title": 5}
LEGACY_MIN_ABSTRACT = 50
SAMPLE_PROJECT_MIN_ABSTRACT = 201  # "longer than 200"


def min_length(df: DataFrame, mins: dict) -> DataFrame:
    """Keep rows whose columns have at least the given number of characters."""
    cond = F.lit(True)
    for c, n in mins.items():
        cond = cond & (F.length(F.col(c)) >= n)
    return df.where(cond)


def drop_boilerplate(df: DataFrame, col: str, texts) -> DataFrame:
    """Drop rows whose column equals one of the boilerplate texts.

    ``texts`` is a list (an IN-set, pushed to the scan) or a DataFrame with one
    column, used as a left-anti join (broadcast only when it is small).
    """
    if isinstance(texts, DataFrame):
        other = texts.select(F.col(texts.columns[0]).alias("_bp")).distinct()
        return df.join(other, F.col(col) == F.col("_bp"), "left_anti")
    return df.where(~F.col(col).isin(list(texts)) | F.col(col).isNull())


def drop_any_null(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a NULL in any (or the given) column."""
    return df.na.drop("any", subset=cols)


def linked_only(df: DataFrame, ids_col: str = "proj_ids") -> DataFrame:
    """Publications with at least one linked project id."""
    return df.where(F.size(F.col(ids_col)) > 0)


def dedup_first(df: DataFrame, keys, order: str, unique_order: bool = False) -> DataFrame:
    """A2: keep the first row (lowest ``order``) of every group of equal ``keys``.

    ``order`` is a number (an id, a position).  The keys are shuffled as a 128-bit
    hash and the winner of a group is ``min(order)``, a hash aggregate that collapses
    copies inside each map task; then one equi-join on (hash, order) keeps the
    winners, so texts are neither sorted nor aggregated.  Rows equal in keys and
    order are one; ``unique_order`` says there are none and saves a pass.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    # a null and an empty key differ: nulls are marked
    text = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in keys])
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")  # noqa: E731  two 60-bit halves of the digest
    marked = df.withColumn("_h1", half(1)).withColumn("_h2", half(17))
    winners = marked.groupBy("_h1", "_h2").agg(F.min(order).alias("_o"))
    if unique_order:
        return df.join(winners.select("_o"), F.col(order) == F.col("_o"), "left_semi")
    kept = marked.join(winners.select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), "_o"),
                       (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")) & F.col(order).eqNullSafe(F.col("_o")))
    return kept.dropDuplicates(["_h1", "_h2"]).select(*df.columns)


def merge_by_title(pubs: DataFrame, order: str, *, title: str = "title", first_cols=("id", "abstract"),
                   split_cols=("participants", "disciplines", "organization", "flemishDisciplines"),
                   whole_cols=("projId", "dataProvider"), sep: str = ", ") -> DataFrame:
    """A1: one row per title.

    ``first_cols``: first non-null value in ``order``; ``whole_cols``: sorted
    distinct values joined by ', '; ``split_cols``: values split on ', ' first,
    then sorted distinct and joined.  NULL titles are dropped.  Titles are told apart
    by a 128-bit hash, which the values carry instead of the title (a title may be a whole
    text).  Values are exploded and made distinct per (title, field) first, a hash
    aggregate with map-side combine, so a title shared by a third of the rows gathers its
    distinct values only, never its rows.
    """
    digest = F.md5(F.col(title).cast("string"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")  # noqa: E731  its two signed halves
    rows = pubs.where(F.col(title).isNotNull()).withColumn("_h1", half(1)).withColumn("_h2", half(17))
    firsts = rows.groupBy("_h1", "_h2").agg(F.first(title).alias(title), *[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_cols])
    names = [*whole_cols, *split_cols]
    value = {c: F.array(F.col(c).cast("string")) for c in whole_cols}
    value |= {c: F.split(F.col(c), re.escape(sep).replace("\\ ", " "), -1) for c in split_cols}
    fields = [F.struct(F.lit(i).alias("f"), value[c].alias("v")) for i, c in enumerate(names)]
    values = (rows.select("_h1", "_h2", F.explode(F.array(*fields)).alias("_f"))
                  .select("_h1", "_h2", F.col("_f.f").alias("_f"), F.explode("_f.v").alias("_v"))
                  .where(F.col("_v").isNotNull()).distinct())
    lists = (values.groupBy("_h1", "_h2").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_f") == i, F.col("_v")))), sep).alias(c) for i, c in enumerate(names)]))
    joined = firsts.join(lists, ["_h1", "_h2"], "left")
    return joined.select(title, *first_cols, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])
