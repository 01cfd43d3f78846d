"""Physical-plan shapes that matter at scale (checked with explain, not timing)."""

import contextlib
import io

import __spark_entry__ as E
from tests.conftest import SF001


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_knn_single_store_block_has_no_merge_shuffle(spark):
    p = plan(E.queries()["knn_exact"](spark, SF001))
    assert "FlatMapCoGroupsInPandas" in p
    assert "Window" not in p          # one store block: local top-k is final
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def shape(p: str) -> str:
    """Aggregates (A) and exchanges (X) of a plan, from the top."""
    return "".join("X" if "Exchange" in x else "A" for x in p.split("\n\n(")[0].splitlines() if "Aggregate" in x or "Exchange" in x)


def test_dedup_is_a_hash_aggregate_of_numbers(spark):
    p = plan(E.queries()["dedup_keep_first"](spark, SF001))
    assert "HashAggregate" in p and "SortAggregate" not in p and "ObjectHashAggregate" not in p
    assert "AXA" in shape(p)
    winners = p.split("\n\n(")[0].split("HashAggregate")[-1]
    assert "Sort" not in winners  # texts are hashed, not sorted


def test_merge_makes_values_distinct_map_side(spark):
    p = plan(E.queries()["merge_by_title"](spark, SF001))
    assert "AXA" in shape(p) and "collect_set" not in p


def test_upsert_neither_sorts_nor_aggregates_the_store(spark):
    from reclink.sources.store import upsert
    s = spark.range(1000).selectExpr("id", "array(1.0, 2.0) AS vec")
    p = plan(upsert(s, s.where("id < 10")))
    head = p.split("\n\n(")[0]
    assert "LeftAnti" in p and "SortMergeJoin" not in head.split("Union")[0]


def test_building_an_embedding_runs_no_job(spark):
    from reclink.operators.embed import embed
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    a = spark.range(100).selectExpr("id % 7 AS k", "string(id) AS t")
    a = a.join(a.groupBy("k").count(), "k")
    batch, before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), jobs()
    embed(a, "t", batch_size=3)
    assert jobs() == before and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_replicate_sample_limits_before_shuffle(spark):
    from reclink.operators.sample import replicate_samples
    p = plan(replicate_samples(spark.range(1000), 10, range(5)))
    assert p.count("WindowGroupLimit") >= 2   # partial (pre-shuffle) and final


def test_scans_are_pruned_and_filters_pushed(spark):
    p = plan(E.queries()["title_search"](spark, SF001))
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = plan(E.queries()["sample_linked"](spark, SF001))
    assert "GreaterThan(o_totalprice,200000.0)" in p


def test_single_query_knn_is_unshuffled_top_k(spark):
    p = plan(E.queries()["knn_single"](spark, SF001))
    assert "TakeOrderedAndProject" in p and "FlatMapCoGroupsInPandas" not in p


def test_merge_exchanges_hashes_of_titles(spark):
    p = plan(E.queries()["merge_by_title"](spark, SF001))
    parts = [x for x in p.splitlines() if "hashpartitioning(" in x]
    assert parts and all("hashpartitioning(_h1#" in x for x in parts)  # values don't carry the title


def test_topic_words_count_texts_once_and_embed_once(spark):
    from reclink.plans import catalog
    _, words, _ = catalog._kmeans_topics(spark, SF001)
    words.collect()
    p = words._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in p.split("Initial Plan")[0]  # tf is made once for terms and topics
    assert "ArrowEvalPython" not in p  # vectors are read, not computed again
