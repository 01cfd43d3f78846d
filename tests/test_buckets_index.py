"""Bucketed store with compaction, and title search over trigram postings."""

import re
import tempfile

import pytest

from reclink.operators import title_index
from reclink.operators.search import title_search
from reclink.sources.buckets import BucketStore


def rows(df):
    return sorted((r.id, r.doc) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch(spark, data, extra=""):
    return spark.createDataFrame(data, "id long, doc string" + extra)


def test_upsert_compact_vacuum(spark):
    b = BucketStore(spark, tempfile.mkdtemp(prefix="reclink-buckets-"), buckets=8)
    want = {i: f"a{i}" for i in range(200)}
    b.upsert(batch(spark, list(want.items())))
    assert rows(b.current()) == sorted(want.items()) and "Join" not in plan(b.current())
    hit = b.current().where(b.bucket_of("id") == 3).select("id").limit(2).collect()   # two ids of one bucket
    new = {r.id: "b" for r in hit}
    b.upsert(batch(spark, list(new.items())))
    want |= new
    assert rows(b.current()) == sorted(want.items())
    many = [k for k, vs in b.versions().items() if len(vs) > 1]
    assert many == [3] and b.compact() == [3] and b.compact() == []
    after = b.current()
    assert rows(after) == sorted(want.items()) and "Join" not in plan(after)   # one scan, no join
    untouched = {k: vs for k, vs in b.versions().items() if k != 3}
    assert all(vs == [1] for vs in untouched.values()) and b.versions()[3] == [3]
    assert b.vacuum() == 2 and b.vacuum() == 0
    assert rows(b.current()) == sorted(want.items())
    one = next(iter(new))
    assert rows(b.lookup(one)) == [(one, "b")]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(3\)|= 3)", plan(b.lookup(one)))   # its bucket alone is read
    assert b.lookup(-5).count() == 0


def test_failed_compaction_leaves_the_same_rows(spark):
    b = BucketStore(spark, tempfile.mkdtemp(prefix="reclink-buckets-"), buckets=2)
    b.upsert(batch(spark, [(1, "a"), (2, "b"), (3, "c")]))
    b.upsert(batch(spark, [(1, "x")]))
    want = rows(b.current())
    b._put(b.current(), b.next_version())           # rows written, bases not
    assert rows(b.current()) == want == [(1, "x"), (2, "b"), (3, "c")]
    b.compact()
    assert rows(b.current()) == want


def test_append_repeats_nulls_and_retries(spark):
    b = BucketStore(spark, tempfile.mkdtemp(prefix="reclink-buckets-"), buckets=4)
    b.append(batch(spark, [(1, "a"), (None, "n"), (2, None)]))
    b.append(batch(spark, [(1, "z", 0), (3, "x", 0), (3, "w", 1)], ", nth int"), order="nth", version=2)
    b.upsert(batch(spark, [(3, "w")]), version=2)     # a retry of version 2
    assert [tuple(r) for r in b.current().orderBy("id").collect()] == [(1, "a"), (2, None), (3, "w")]
    b.upsert(batch(spark, []))
    assert b.current().count() == 3


def test_empty_store(spark):
    b = BucketStore(spark, tempfile.mkdtemp(prefix="reclink-buckets-"))
    b.upsert(batch(spark, []))
    assert b.current().columns == ["id", "doc"] and b.current().count() == 0 and b.compact() == [] and b.vacuum() == 0
    assert b.lookup(1).count() == 0


TITLES = [(1, "The Theory of Things"), (2, "other thEory"), (3, None), (4, ""), (5, "of"), (6, "a+b (x) [y]"), (7, "Ünder the Straße"),
          (8, "theory"), (8, "thesis"), (9, "the ory"), (9, "the ory"), (None, "no id in theory"), (10, "x" * 5000 + "needle")]


@pytest.mark.parametrize("q", ["theory", "THE", "of", "", "+b (", "straße", "ÜN", "needle", "nothing like it", "the t", "xxxx", "sisthe"])
def test_index_finds_what_the_scan_finds(spark, index, q):
    df, path = index
    same = lambda d: [tuple(r) for r in d.collect()]
    assert title_index.search(spark, path, None).count() == 0
    assert same(title_index.search(spark, path, q)) == same(title_search(df, q))
    if q and "[" not in q and "(" not in q:
        assert same(title_index.search(spark, path, q, literal=False)) == same(title_search(df, q, literal=False))


@pytest.fixture(scope="module")
def index(spark):
    path = tempfile.mkdtemp(prefix="reclink-titles-")
    df = spark.createDataFrame(TITLES, "id long, title string")
    title_index.build(df, path)
    return df, path


def test_only_candidates_are_tested(spark, index):
    _, path = index
    assert {r.id for r in title_index.candidates(spark, path, "theory").collect()} == {1, 2, 8, None}
    assert title_index.candidates(spark, path, "sisthe").count() == 0
    assert title_index.search(spark, path, "zzz").count() == 0


def test_parts_of_the_title_index_are_bounded_by_characters(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from reclink.operators import title_index
    monkeypatch.setattr(title_index, "PART_CHARS", 50)
    df = spark.range(400).selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS id", "concat('the title ', id, ' of all') AS title")
    title_index.build(df, str(tmp_path))
    post = spark.read.parquet(f"{tmp_path}/postings")
    rows = post.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert rows[1] == df.select(F.explode(title_index.trigrams("title"))).count()
    assert rows[0] <= 400  # a folder of trigrams that all titles have lies in several files
    got = title_index.search(spark, str(tmp_path), "the title 3", 500)
    want = df.where("title LIKE 'the title 3%'")
    assert sorted(r.title for r in got.collect()) == sorted(r.title for r in want.collect())
