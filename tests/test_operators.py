"""Per-operator checks on tiny hand-made frames (text quirks, curation, sampling, evaluation)."""

import os
import tempfile

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reclink.functions import text as tx
from reclink.functions import vectors as vx
from reclink.operators import curate as cu
from reclink.operators import evaluate as ev
from reclink.operators import sample as sm
from reclink.operators.knn import knn_join
from reclink.operators.search import lookup, title_search
from reclink.sources import store as store_mod
from reclink.sources import xml_pages as xp


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first().y


def test_html_to_text_quirks(spark):
    html = ("<!DOCTYPE html><html><head><style>p{x}</style><script>var t='</p>';</script></head>"
            "<body><!-- c --><p>A&amp;B&nbsp;&lt;tag&gt;</p>\n\t<b>x</b>&amp;lt;</body></html>")
    assert one(spark, tx.html_to_text("x"), html) == "A&B <tag> x &lt;"
    assert one(spark, tx.html_to_text("x"), None) == ""


def test_break_before_abstract_first_only(spark):
    s = "Title: T  Abstract:   one Abstract: two"
    assert one(spark, tx.break_before_abstract("x"), s) == "Title: T\nAbstract: one Abstract: two"


def test_clean_fields(spark):
    assert one(spark, tx.clean_participants("x"), "B, A, B") == "A, B"
    assert one(spark, tx.clean_participants("x"), None) == ""
    assert one(spark, tx.clean_disciplines("x"), "010101:Algebra;020202:Botany;010101:Algebra") == "Algebra, Botany"
    assert one(spark, tx.stopword_clean("x"), "The  cat is ON a Mat") == " cat mat"
    assert one(spark, tx.truncate_id("x"), "a" * 60) == "a" * 50


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(vx.l2_normalize("a").alias("n"), vx.blend("a", "b").alias("m")).collect()
    assert np.allclose(r[0].n, [0.6, 0.8]) and r[1].n == [0.0, 0.0]
    assert np.allclose(r[0].m, [0.2 * 3 + 0.8, 0.8])


def test_dedup_first_keeps_lowest_order(spark):
    df = spark.createDataFrame([(3, "t", "c"), (1, "t", "a"), (2, "u", "b"), (5, "t", "d")], "o int, text string, v string")
    out = {r.text: (r.o, r.v) for r in cu.dedup_first(df, "text", "o").collect()}
    assert out == {"t": (1, "a"), "u": (2, "b")}


def test_merge_by_title(spark):
    df = spark.createDataFrame(
        [(1, "T", None, "x", "B, A", "P2"), (2, "T", "id2", "y", "C, A", "P1"), (3, None, "id3", "z", "Q", "P3")],
        "o int, title string, id string, abstract string, participants string, dataProvider string")
    r = cu.merge_by_title(df, "o", first_cols=("id", "abstract"), split_cols=("participants",),
                          whole_cols=("dataProvider",)).collect()
    assert len(r) == 1  # NULL title dropped
    assert (r[0].id, r[0].abstract, r[0].participants, r[0].dataProvider) == ("id2", "x", "A, B, C", "P1, P2")


def test_filters_and_lookup(spark):
    df = spark.createDataFrame([("p1", "Short", "a" * 150), ("p2", "Long title", "a" * 149), ("p3", None, "b")],
                               "id string, title string, abstract string")
    assert [r.id for r in cu.min_length(df, cu.PROJECT_MIN).collect()] == ["p1"]
    assert [r.id for r in cu.drop_any_null(df).collect()] == ["p1", "p2"]
    assert [r.id for r in lookup(df, "p2").collect()] == ["p2"]
    assert [r.id for r in title_search(df, "TITLE").collect()] == ["p2"]
    assert title_search(df, "").count() == 0
    assert [r.id for r in title_search(df, "sh.rt", literal=False).collect()] == ["p1"]
    assert [r.id for r in cu.drop_boilerplate(df, "abstract", ["b"]).collect()] == ["p1", "p2"]


def test_sample_exact_size_and_seeded(spark):
    df = spark.range(1000)
    a = [r.id for r in sm.sample_n(df, 100, seed=7).collect()]
    b = [r.id for r in sm.sample_n(df, 100, seed=7).collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)
    reps = sm.replicate_samples(df, 50, [1, 2, 3]).groupBy("replicate_id").count().collect()
    assert sorted(r["count"] for r in reps) == [50, 50, 50]


def test_is_hit_modes(spark):
    df = spark.createDataFrame([("p1", ["p1", "p2"], "p10,p2")], "h string, ids array<string>, s string")
    r = df.select(ev.is_hit(F.col("h"), F.col("ids")).alias("a"),
                  ev.is_hit(F.col("h"), F.col("s"), "substring").alias("b")).first()
    assert r.a and r.b  # substring mode also matches p1 inside p10, as the original test did


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=0, max_value=1000))
def test_hit_rate_monotone_in_k(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(40, 3))
    lab = rng.integers(0, 4, size=40)
    df = spark.createDataFrame([(i, list(map(float, v[i])), int(lab[i])) for i in range(40)],
                               "id long, vec array<double>, label int")
    r = knn_join(df.withColumnRenamed("label", "ql"), df.withColumnRenamed("label", "sl"), 10,
                 exclude_self=True, q_carry=("ql",), s_carry=("sl",))
    fr = ev.first_hit_rank(r, df.select(F.col("id").alias("qid")), F.col("ql") == F.col("sl"))
    rates = sorted((x.k, x.hit_rate, x.n_queries) for x in ev.hit_rate(fr, ev.K_GRID_SHORT).collect())
    assert all(x[2] == 40 for x in rates)
    assert all(rates[i][1] <= rates[i + 1][1] for i in range(len(rates) - 1))
    missed = ev.misses(fr, 10).count()
    assert missed == round(40 - rates[-1][1] * 40 / 100)


def test_where_predicate_and_convert(spark):
    df = spark.createDataFrame([(i, [float(i)], "A" if i % 2 else "B") for i in range(6)],
                               "id long, vec array<double>, dataProvider string")
    r = knn_join(df, df, 2, where=F.col("dataProvider") == "A")
    assert set(x.sid for x in r.collect()) <= {1, 3, 5}
    d = tempfile.mkdtemp(prefix="reclink-conv-")
    store_mod.convert(df, d + "/s")
    assert sorted(os.listdir(d + "/s"))[0].startswith("_") or any(x.startswith("by_dataProvider=") for x in os.listdir(d + "/s"))
    back = spark.read.parquet(d + "/s").where(F.col("dataProvider") == "A")
    assert sorted(x.doc_id for x in back.collect()) == [1, 3, 5]


def test_read_legacy(spark):
    d = tempfile.mkdtemp(prefix="reclink-legacy-")
    with open(os.path.join(d, "page0.xml"), "w") as f:
        f.write('<CERIF><cfProj><cfProjId>P1</cfProjId><cfAbstr>abs</cfAbstr>'
                '<cfPers><cfFirstNames>A</cfFirstNames><cfFamilyNames>B</cfFamilyNames></cfPers>'
                '<cfPers><cfFirstNames>C</cfFirstNames></cfPers></cfProj>'
                '<cfResPubl><cfPublId>X</cfPublId><cfProj_ResPubl><cfProjId>P1</cfProjId></cfProj_ResPubl>'
                '<cfProj_ResPubl><cfProjId>P2</cfProjId></cfProj_ResPubl></cfResPubl>'
                '<cfResPubl><cfPublId>Y</cfPublId></cfResPubl></CERIF>')
    p = xp.read_legacy(spark, d, "cfProj").first()
    assert (p.projId, p.abstract, p.participants) == ("P1", "abs", "A B")
    pubs = {r.id: r.projId for r in xp.read_legacy(spark, d, "cfResPubl").collect()}
    assert pubs == {"X": "P1,P2", "Y": None}


def test_relational_helpers(spark):
    from reclink.operators import relational as rl
    df = spark.createDataFrame([("a", ["p1", "p2"], 3), ("b", ["p2"], 1), ("c", ["p3"], 2)],
                               "id string, projId array<string>, v int")
    assert sorted(r.proj_id for r in rl.distinct_links(df).collect()) == ["p1", "p2", "p3"]
    n_in, n_out, _ = rl.step_counts(df, lambda d: d.where(F.col("v") > 1))
    assert (n_in, n_out) == (3, 2)
    assert [r.id for r in rl.head(df, 2, F.col("v")).collect()] == ["b", "c"]
    g = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 5)], "g string, v int")
    assert sorted((r.g, r.v) for r in rl.top_k(g, "g", F.col("v").desc(), 2).collect()) == [("x", 2), ("x", 3), ("y", 5)]
    u = rl.append_batches(df.select("id"), df.select("id", "v"))
    assert u.count() == 6 and u.columns == ["id", "v"]
    j = rl.join_stores(df.select("id", "v"), df.select("id", F.col("v").alias("w")))
    assert sorted(j.columns) == ["id", "v_a", "w_b"]


def test_model_persistence_and_text_query(spark):
    from pyspark.ml.feature import Word2VecModel
    from reclink.operators import topics as tp
    docs = spark.createDataFrame([(i, ("alpha beta gamma " * 5 if i % 2 else "delta eps zeta " * 5).split())
                                  for i in range(20)], "id long, tokens array<string>")
    model = tp.fit_doc2vec(docs, dim=8, min_count=1)
    d = tempfile.mkdtemp(prefix="reclink-model-")
    tp.save_model(model, d + "/w2v")
    again = tp.load_model(Word2VecModel, d + "/w2v")
    vecs = tp.doc_vectors(docs, again)
    q = spark.createDataFrame([(100, ["alpha", "beta"])], "id long, tokens array<string>")
    hits = tp.query_documents(again, vecs, q, 3).collect()
    assert len(hits) == 3 and all(h.sid % 2 == 1 for h in hits)


def test_html_keeps_less_than_and_decodes_all_references(spark):
    from reclink.functions.text import html_to_text
    rows = [("significant (p < 0.05, n > 30) in mice", "significant (p < 0.05, n > 30) in mice"),
            ("caf&eacute; &#233; &#x27; &beta; &amp;lt;", "café é ' β &lt;"), ("a<b>c</b><!-- x > y --><?p q?>d", "a c d"),
            ("1 <2 and <3", "1 <2 and <3"), (None, ""), ("<br/>", "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "h string")
    assert [r[0] for r in df.select(html_to_text("h")).collect()] == [r[1] for r in rows]


def test_dictionary_is_never_cut_and_unseen_terms_are_ignored(spark):
    from reclink.operators import topics as tp
    docs = spark.createDataFrame([(i, [f"t{i}_{j}" for j in range(50)] + ["all"]) for i in range(200)], "id long, tokens array<string>")
    d = tp.dictionary(docs)
    assert d.count() == 200 * 50 + 1 and d.where("term = 'all'").first()["doc_freq"] == 200
    assert tp.dictionary(docs, min_df=2).count() == 1
    new = spark.createDataFrame([(1, ["all", "never", "all"]), (2, ["never"]), (3, [])], "id long, tokens array<string>")
    got = {r.id: r.bow.numNonzeros() and sum(r.bow.values) for r in tp.bag_of_words(new, terms=d).collect()}
    assert got == {1: 2.0, 2: 0, 3: 0}


def test_lda_reads_every_document_in_every_pass(spark):
    from reclink.operators import topics as tp
    docs = spark.createDataFrame([(i, [["sun", "moon"], ["cat", "dog"]][i % 2] * 8) for i in range(60)], "id long, tokens array<string>")
    model = tp.fit_lda(docs, k=2, passes=15, dim=64)
    assert model.estimatedDocConcentration().size == 2
    v = {r.id: r.vec for r in tp.topic_vectors(docs, model).collect()}
    assert all(abs(sum(x) - 1) < 1e-5 for x in v.values())
    top = {i: max(range(2), key=lambda t: v[i][t]) for i in v}
    assert len({top[i] for i in range(0, 60, 2)}) == len({top[i] for i in range(1, 60, 2)}) == 1 and top[0] != top[1]


def test_kmeans_assigns_nearest_and_pca_keeps_variance(spark):
    import numpy as np
    from reclink.operators import topics as tp
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 4)) + c for c in (0, 8, 16)])
    df = spark.createDataFrame([(i, v.tolist(), ["w"]) for i, v in enumerate(x)], "id long, vec array<double>, tokens array<string>")
    assigned, _, model = tp.cluster_topics(df, k=3)
    centres = np.array(model.clusterCenters())
    for r in assigned.collect():
        assert r.topic == np.argmin(((centres - np.array(r.vec)) ** 2).sum(1))
    p = np.array([[r.x, r.y] for r in tp.project_2d(df.select("id", "vec")).collect()])
    top = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(p.var(0, ddof=1), top)


def test_normalising_is_linear_in_the_dimension(spark):
    import time
    from pyspark.sql import functions as F
    from reclink.functions.vectors import l2_normalize
    took = []
    for d in (512, 512, 1024):  # the first one warms up
        df = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: i * 0.5).alias("v"))
        t = time.perf_counter()
        df.select(l2_normalize("v")).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    assert took[2] < 4 * took[1] + 2


def test_batches_keep_their_budget():
    from reclink.operators.embed import by_budget
    sizes = [3, 3, 3, 50, 1, 0, 0, 9]
    runs = list(by_budget(sizes, 3, 10))
    assert runs == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert all(sum(sizes[a:b]) <= 10 or b - a == 1 for a, b in runs)
    assert list(by_budget([], 3, 10)) == [] and list(by_budget([1, 1], None, None)) == [(0, 2)]


class LoggingEmbedder:
    """Writes the texts of each request to a file of its own."""

    def __init__(self, folder):
        self.folder = folder

    def load(self):
        return self

    def __call__(self, texts):
        import json
        import uuid

        import numpy as np
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        return np.array([[float(len(t or ""))] for t in texts])


def test_equal_texts_are_embedded_once(spark):
    import json

    from reclink.operators.embed import embed_distinct
    d = tempfile.mkdtemp(prefix="reclink-embed-")
    rows = [(i, f"word {'x ' * (i % 7)}") for i in range(60)] + [(60, None), (61, None), (62, ""), (63, "y " * 90)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1).withColumn("vec", F.lit("old"))
    got = {r.id: r.vec for r in embed_distinct(df, "text", LoggingEmbedder(d), batch_tokens=12, partitions=4).collect()}
    assert got == {i: [float(len(t or ""))] for i, t in rows}
    calls = [json.load(open(f"{d}/{f}")) for f in os.listdir(d)]
    assert sorted((t for c in calls for t in c), key=str) == sorted({t for _, t in rows}, key=str)
    assert all(sum(len((t or "").split()) for t in c) <= 12 or len(c) == 1 for c in calls)
    assert embed_distinct(df.limit(0), "text").count() == 0


def test_embedder_remembers_a_bounded_number_of_tokens(monkeypatch):
    from reclink.operators import embed as em
    assert em._CACHED_TOKENS <= 1 << 17
    text = " ".join(f"t{i}" for i in range(50))
    whole = em.HashingEmbedder(16).load()([text])
    monkeypatch.setattr(em, "_CACHED_TOKENS", 10)
    model = em.HashingEmbedder(16).load()
    assert (model([text]) == whole).all() and len(model._cache) == 10


def test_white_space_is_squashed_as_by_plain_regex(spark):
    from reclink.functions.text import html_to_text, squash_ws
    rows = ["a b", " a  b ", "a\tb\n\nc", "a \n b", " a   b　", "x y", "", "  ", "\t", "a\x0b\x0c\r b", "é  ü \u0085 z"]
    ws = "[\t\n\x0b\f\r \u0085   -     　]+"
    import re
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r[0] for r in df.select(squash_ws("h")).collect()] == [re.sub(ws, " ", r).strip(" ") for r in rows]
    # markup is looked for where entities are decoded and in the result, not a third time to ask for "&"
    plan = df.select(html_to_text("h"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("<!--") == 4  # twice a text (6 before)


def test_merge_by_title_of_null_orders_and_long_titles(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(None, long, "a", "B, A"), (None, long, "b", "A"), (2, "T", None, None), (1, "T", "c", "Q"), (None, "T", "d", "Z")],
                               "o int, title string, id string, participants string")
    r = {x.title: (x.id, x.participants) for x in cu.merge_by_title(df, "o", first_cols=("id",), split_cols=("participants",), whole_cols=()).collect()}
    assert r == {long: (None, "A, B"), "T": ("c", "Q, Z")}


def test_tokens_of_latin_1_texts_are_those_of_the_pattern():
    import re

    from reclink.operators.embed import HashingEmbedder
    model = HashingEmbedder(16).load()
    texts = ["", "a_b  c\x1cd\x85e\xa0f", "".join(map(chr, range(256))), "ª²³µ¹º¼ Àÿß", "“q” café ǆ"]
    for t in texts:
        got = [x.decode("latin-1") if isinstance(x, bytes) else x for x in model._tokens(t)]
        assert got == re.findall(r"[^\W_]+", t)
    assert (model(["café x", "café “x”"])[0] == model(["x café"])[0]).all()  # bytes and text share buckets
    assert (model(["café x"]) == model(["café “x”"])).all()
