"""Interactive lookups: point lookup, title suggestions, correlated records
(P5, P6 and the correlated-publication query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.functions.text import break_before_abstract, format_hit
from reclink.operators.knn import nearest


def lookup(df: DataFrame, value, key: str = "id") -> DataFrame:
    """P5: rows with the given id (pushed down to the Parquet scan)."""
    return df.where(F.col(key) == F.lit(value))


def title_search(projects: DataFrame, q: str, n: int = 10, literal: bool = True, *, title: str = "title",
                 key: str = "id") -> DataFrame:
    """Case-insensitive title match, first n by (title, id); empty query -> no rows.

    ``literal=False`` treats the query as a regular expression, as the
    original suggestion endpoint did.  NULL titles never match.
    """
    if not q:
        return projects.limit(0).select(key, title)
    t = F.lower(F.col(title))
    cond = t.contains(q.lower()) if literal else t.rlike(q.lower())
    return (projects.where(F.col(title).isNotNull() & cond)
                    .select(key, title)
                    .orderBy(F.col(title), F.col(key))
                    .limit(n))


def correlated(query_vec: DataFrame, store: DataFrame, docs: DataFrame, k: int = 5, *, vec: str = "vec",
               s_id: str = "id", s_vec: str = "vec", doc_id: str = "id", doc: str = "doc",
               metric: str = "l2sq") -> DataFrame:
    """The correlated-records query: nearest stored records to one query vector,
    formatted as '<doc> \\n Similarity Score: <dist>' with the Abstract label on
    its own line.  ``query_vec`` holds zero or one row; zero rows -> no result.

    The store is scanned in parallel with a JVM-side distance expression and
    only k rows per partition reach the final merge.
    """
    row = query_vec.select(F.col(vec)).first()  # one looked-up row (P5), never the data
    hits = nearest(store, None if row is None else row[0], k, s_id=s_id, s_vec=s_vec, metric=metric)
    # k rows: a size-bounded broadcast side
    text = docs.select(F.col(doc_id).alias("sid"), F.col(doc).alias("_doc"))
    j = F.broadcast(hits.select("sid", "rank", "dist")).join(text, "sid", "inner")
    return j.select("rank", "sid", "dist",
                    break_before_abstract(format_hit(F.col("_doc"), F.format_string("%.6f", F.col("dist"))))
                    .alias("result"))
