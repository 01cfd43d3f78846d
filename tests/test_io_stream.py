"""CSV round trip (S7/S8), store batch log (S9/S13) and incremental ingest (ST1)."""

import os
import tempfile

from pyspark.sql import functions as F

from reclink.sources import csv_io, store as st
from reclink.streaming.ingest import ingest
from tests.test_xml import ABS, BROKEN, FAULT, P1, P2, page, write_pages


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="reclink-csv-")
    rows = [("p1", "T, with comma", "line1\nline2 \"quoted\"", ["Ann Lee", "Bo Li"], ["d1", "d2"], [], ["Org"], "")]
    df = spark.createDataFrame(rows, "projId string, title string, abstract string, participants array<string>, "
                                     "disciplines array<string>, flemishDisciplines array<string>, "
                                     "organization array<string>, dataProvider string")
    csv_io.write_records_csv(df, d + "/p")
    back = csv_io.read_records_csv(spark, d + "/p").first()
    assert back.title == "T, with comma" and back.abstract == 'line1\nline2 "quoted"'
    assert back.participants == ["Ann Lee", "Bo Li"] and back.disciplines == ["d1", "d2"]
    assert back.dataProvider is None  # empty string is read back as NULL


def test_csv_ranges_of_one_file(spark):
    """One file with quoted line breaks is read by many tasks, with the rows of the whole-file reader."""
    d = tempfile.mkdtemp(prefix="reclink-ranges-")
    odd = ["plain", "a,b", 'say "hi"', "two\nlines", '"\n"\n\n"', "", None, "x\n\ny, \"z\"\r\nend", "é\n" * 40, '""', " sp ", "back\\slash"]
    rows = [(str(i), odd[i % len(odd)], odd[(i * 7 + 3) % len(odd)]) for i in range(600)]
    df = spark.createDataFrame(rows, "projId string, title string, abstract string")
    csv_io.write_records_csv(df.coalesce(1), d + "/one")
    os.makedirs(d + "/more")
    with open(d + "/more/crlf.csv", "w", newline="") as f:
        f.write('projId,title,abstract\r\n1,"a\r\nb",c\r\n\r\n2,,"d"\r\n3,"long ' + "z\n" * 5000 + '",e')
    with open(d + "/more/empty.csv", "w") as f:
        f.write("projId,title,abstract\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for path in (d + "/one", d + "/more"):
            for schema in (None, "projId int, title string, abstract string"):
                assert spark.read.text(path).rdd.getNumPartitions() > 4
                got = csv_io.read_records_csv(spark, path, schema=schema, ranges=True)
                want = csv_io.read_records_csv(spark, path, schema=schema)
                assert got.dtypes == want.dtypes
                key = lambda r: tuple(str(v) for v in r)
                got = [tuple(r) for r in got.collect()]
                if path.endswith("more"):  # the whole-file reader rewrites line breaks inside fields of a file with "\r\n"
                    assert sum("a\r\nb" in r for r in got) == 1
                    got = [tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in r) for r in got]
                assert sorted(got, key=key) == sorted(map(tuple, want.collect()), key=key)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_store_upsert_append_idempotent(spark):
    s = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "id long, vec array<double>, doc string")
    b = spark.createDataFrame([(2, [9.0], "B"), (3, [3.0], "c")], "id long, vec array<double>, doc string")
    up = {r.id: r.doc for r in st.upsert(s, b).collect()}
    assert up == {1: "a", 2: "B", 3: "c"}
    assert {r.id: r.doc for r in st.upsert(st.upsert(s, b), b).collect()} == up
    ap = {r.id: r.doc for r in st.append(s, b).collect()}
    assert ap == {1: "a", 2: "b", 3: "c"}
    d = tempfile.mkdtemp(prefix="reclink-store-")
    st.append_batch(s, d + "/log", 0)
    st.append_batch(b, d + "/log", 1)
    st.append_batch(b, d + "/log", 1)  # retried batch: same result
    assert {r.id: r.doc for r in st.current(spark, d + "/log").collect()} == up


def test_cached_is_incremental(spark):
    d = tempfile.mkdtemp(prefix="reclink-cache-")
    src = spark.range(5).withColumnRenamed("id", "id")
    calls = []

    def compute(df):
        calls.append(1)
        return df.withColumn("sq", F.col("id") * F.col("id"))
    st.cached(spark, d + "/c", compute, src)
    more = spark.range(8)
    out = st.cached(spark, d + "/c", compute, more)
    assert sorted(r.id for r in out.collect()) == list(range(8))


def test_ingest_stream_processes_only_new_pages(spark):
    src = write_pages({0: page(P1)})
    out = tempfile.mkdtemp(prefix="reclink-ingest-")
    store_path, ckpt = out + "/store", out + "/ckpt"
    ingest(spark, src, store_path, ckpt)
    first = st.current(spark, store_path).collect()
    assert [r.id for r in first] == ["p1"] and len(first[0].vec) == 64
    p9 = P1.replace('uuid="p1"', 'uuid="p9"')
    with open(os.path.join(src, "page1.xml"), "w") as f:
        f.write(page(p9))
    ingest(spark, src, store_path, ckpt)
    log = st.read(spark, store_path)
    assert sorted((r.id, int(r.batch_id)) for r in log.select("id", "batch_id").collect()) == [("p1", 0), ("p9", 1)]
    assert sorted(r.id for r in st.current(spark, store_path).collect()) == ["p1", "p9"]
    assert ABS


def test_two_streams_into_one_store(spark):
    out = tempfile.mkdtemp(prefix="reclink-two-")
    for i, name in enumerate(("u1", "u2")):
        src = write_pages({0: page(P1.replace('uuid="p1"', f'uuid="{name}"'))})
        ingest(spark, src, out + "/store", f"{out}/ckpt{i}")
    assert sorted(r.id for r in st.current(spark, out + "/store").collect()) == ["u1", "u2"]


def test_default_checkpoints_of_equal_basenames(spark):
    src, out = write_pages({0: page(P1)}), tempfile.mkdtemp(prefix="reclink-names-")
    for d in ("/a/vec", "/b/vec"):
        ingest(spark, src, out + d)
        assert [r.id for r in st.current(spark, out + d).collect()] == ["p1"]


def test_repeated_ids_of_a_batch(spark):
    s = spark.createDataFrame([(1, "a")], "id long, doc string")
    b = spark.createDataFrame([(1, "x", 0), (1, "w", 1), (2, "c", 0), (2, "b", 5)], "id long, doc string, nth int")
    assert sorted(map(tuple, st.upsert(s, b, order="nth").collect())) == [(1, "w"), (2, "b")]
    assert sorted(map(tuple, st.append(s, b, order="nth").collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, st.upsert(s, b.drop("nth")).collect())) == [(1, "x"), (2, "c")]


def test_half_written_store_counts_as_absent(spark):
    d = tempfile.mkdtemp(prefix="reclink-half-")
    spark.range(2).write.parquet(d + "/c")
    os.remove(d + "/c/_SUCCESS")
    assert not st.exists(spark, d + "/c")
    assert sorted(r.id for r in st.cached(spark, d + "/c", lambda: spark.range(5)).collect()) == list(range(5))


def test_repeated_pages_and_rejects_across_restarts(spark):
    src, out = write_pages({0: page(P1 + P2), 1: FAULT, 2: BROKEN}), tempfile.mkdtemp(prefix="reclink-rejects-")

    def run():
        ingest(spark, src, out + "/store", out + "/ckpt", rejects_path=out + "/rejects")
        return (sorted((r.id, int(r.batch_id)) for r in st.read(spark, out + "/store").collect()),
                sorted((r.page_no, r.uuid or "", r.reason) for r in st.read(spark, out + "/rejects").collect()))
    first = run()
    assert first == ([("p1", 0)], [(0, "p2", "no title"), (1, "", "fault"), (2, "", "unparseable")])
    for name, body in (("page3.xml", page(P1 + P2)), ("page4.xml", FAULT)):   # delivered again under other names
        with open(os.path.join(src, name), "w") as f:
            f.write(body)
    assert run() == first


def test_materialize_once_follows_content(spark):
    d, seen = tempfile.mkdtemp(prefix="reclink-once-"), []

    def compute(df):
        seen.append(sorted(str(r.text) for r in df.collect()))
        return df.select("_fp", "id", F.length("text").alias("n"))

    def run(rows, **kw):
        df = spark.createDataFrame(rows, "id long, text string")
        return sorted(map(tuple, st.materialize_once(spark, d + "/c", compute, df, **kw).collect()))
    assert set(run([(1, "a"), (2, "bb"), (3, "c"), (3, "c")])) == {(1, 1), (2, 2), (3, 1)}
    assert run([(1, "a"), (2, "long")]) == [(1, 1), (2, 4)]                      # 2 changed, 3 is gone
    assert run([(1, "a"), (2, "long"), (3, "c")]) == [(1, 1), (2, 4), (3, 1)]    # 3 is back, not computed again
    assert seen == [["a", "bb", "c"], ["long"], []]
    assert run([(1, "a")], params="other model") == [(1, 1)] and seen[-1] == ["a"]
    assert run([(1, "a")]) == [(1, 1)] and seen[-1] == []
    got = st.materialize_once(spark, d + "/n", compute, spark.createDataFrame([(None, "x"), (7, None), (8, "")], "id long, text string"))
    assert {(r.id, r.n) for r in got.collect()} == {(None, 1), (7, None), (8, 0)}
    assert run([]) == []
