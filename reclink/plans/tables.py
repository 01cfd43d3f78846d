"""Readers for the driver tables and the proxy views built on them.

Proxy mapping (driver tables stand in for the research records):

* ``embeddings`` is the vector store: ``vec_id`` the record id, ``label`` the
  truth class (a hit is a neighbour with the query's label), and the data
  provider is the ``source`` of the document with the same id ('' if none);
* ``documents`` are the text records: the title is the first line of the text,
  the abstract the rest, ``source`` the data provider, ``lang`` the locale;
* ``customer`` -> ``orders`` is the publication -> project link table;
* ``pages.html`` supplies HTML fields, ``benchmark`` boilerplate/query texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: id, title (first line), abstract (rest), provider, lang."""
    d = table(spark, sf_dir, "documents")
    first_nl = F.instr(F.col("text"), "\n")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(first_nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)"))
         .otherwise(F.col("text")).alias("title"),
        F.when(first_nl > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
         .otherwise(F.lit("")).alias("abstract"),
        F.col("source").alias("dataProvider"),
        F.col("lang"),
        F.col("text"),
    )


def vectors(spark: SparkSession, sf_dir: str, with_provider: bool = False) -> DataFrame:
    """embeddings as a store: id, vec, label[, dataProvider]."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    if not with_provider:
        return e
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"),
                                                 F.col("source").alias("dataProvider"))
    # documents.doc_id is unique, so the left join never multiplies store rows
    return (e.join(d, "id", "left")
             .withColumn("dataProvider", F.coalesce("dataProvider", F.lit(""))))


# Markup put in front of every page and abstract, so that the rows hold "<" as text and more kinds of references.
MARKUP = ("<p class='a'>caf&eacute; &#233;t&#x27; &beta;1 (p < 0.05, n > 30)<br/>x<y and 3<4</p><!-- a > b --><?pi x?>"
          "<style>p > a {}</style>&amp;lt; ")
