"""Corpus pipeline: language id, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Each works on whatever its predecessor kept, and
its result is written as Parquet and read again before the next.

1. ``language_id``: the models are learned from the labelled rows; documents that
   get no language (null text, or no letter in it) go.
2. ``near_dedup``: five-word shingles, similarity 0.8; of each group the document
   with the smallest id stays.  Documents without an id stay.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``mix``: sources are interleaved to tempered target weights.  Nothing is left
   out; sources below their weight are repeated.
5. ``shard``: 8 contiguous shards of nearly equal bytes; adds ``shard``.
"""

from pyspark.sql import functions as F

from reclink.llm import decontaminate as leaks
from reclink.llm import langid, mixing, near_dups, shards
from reclink.llm.common import stored, table
from reclink.llm.queries import MIX_ALPHA
from reclink.session import ship_package


def language_id(spark, docs, sf_dir):
    ship_package(spark)
    return langid.predict(docs, langid.train(docs)).where("lang_pred <> 'und'").select("row.*")


def near_dedup(spark, docs, sf_dir):
    ship_package(spark)
    out = near_dups.near_duplicates(docs, shingle=5).where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(out, docs["doc_id"] == F.col("_dropped"), "left_anti")


def decontaminate(spark, docs, sf_dir):
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    weights = mixing.temper(mixing.source_counts(docs), MIX_ALPHA)
    return mixing.mix(docs, weights).select("row.*")


def shard(spark, docs, sf_dir):
    return shards.with_shard(docs, 8)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]

#: Language identification and MinHash families can't be said in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
