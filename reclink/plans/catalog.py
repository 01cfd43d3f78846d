"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole tables; computed columns carry the same aliases as the
oracle SQL in ``reclink.plans.oracle``.  Floats are rounded, arrays are joined
to strings, ties are broken by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.operators import evaluate as ev
from reclink.operators.knn import knn_join
from reclink.plans.tables import table, vectors
from reclink.session import materialize, scratch_path, shuffles_freed

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- kNN + evaluation

def _knn_all(spark: SparkSession, sf: str, k: int, **kw) -> DataFrame:
    """Leave-one-out kNN over the whole store: every vector queries all others."""
    v = vectors(spark, sf, with_provider=bool(kw.get("on")))
    qv = v.withColumnRenamed("label", "q_label")
    sv = v.withColumnRenamed("label", "s_label")
    return knn_join(qv, sv, k, exclude_self=True, q_carry=("q_label",), s_carry=("s_label",), **kw)


@register("knn_exact")
def knn_exact(spark, sf):
    r = _knn_all(spark, sf, 10)
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


@register("knn_blocked")
def knn_blocked(spark, sf):
    # small blocks: several store blocks per query, so the per-query lists are merged
    r = _knn_all(spark, sf, 10, q_block_rows=96, s_block_rows=120)
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


@register("knn_cosine")
def knn_cosine(spark, sf):
    # norms from 1 to 7000, and one zero vector (at distance 1 from everything)
    v = vectors(spark, sf)
    scaled = v.select("id", F.transform("vec", lambda x: x.cast("double") * (1 + F.col("id") % 7 * 1000)).alias("vec"))
    zero = v.where("id = 0").select(F.lit(-1).cast("long").alias("id"), F.transform("vec", lambda x: F.lit(0.0)).alias("vec"))
    both = scaled.unionByName(zero)
    r = knn_join(both, both, 10, metric="cosine", exclude_self=True)
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


@register("knn_duplicates")
def knn_duplicates(spark, sf):
    # every stored vector three times: ties everywhere
    v = vectors(spark, sf)
    store = (v.select("id", "vec", F.explode(F.array(*[F.lit(i * 1_000_000) for i in range(3)])).alias("add"))
              .select((F.col("id") + F.col("add")).alias("id"), "vec"))
    r = knn_join(v.select("id", "vec"), store, 10, exclude_self=True)
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


def _hit_rates(spark, sf, ks, **kw):
    r = _knn_all(spark, sf, max(ks), **kw)
    queries = vectors(spark, sf).select(F.col("id").alias("qid"))
    fr = ev.first_hit_rank(r, queries, F.col("q_label") == F.col("s_label"))
    return fr, ev.hit_rate(fr, ks)


@register("hit_rate_at_k")
def hit_rate_at_k(spark, sf):
    _, hr = _hit_rates(spark, sf, ev.K_GRID_LONG)
    return hr.select("k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


# ---------------------------------------------------------------- text functions

from reclink.functions import text as tx  # noqa: E402
from reclink.functions.templates import TEMPLATES, compose_text  # noqa: E402
from reclink.plans.tables import MARKUP, records  # noqa: E402


def participants_raw(c="text"):
    """Proxy multi-value field: the sentences of the text, joined by ', '."""
    return F.regexp_replace(F.col(c), r"[.][ \n]*", ", ")


def disciplines_raw(c="text"):
    """Proxy coded-discipline field: the lines of the text, joined by ';'."""
    return F.replace(F.col(c), F.lit("\n"), F.lit(";"))


@register("html_to_text")
def html_to_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.html_to_text(F.concat(F.lit(MARKUP), F.coalesce("html", F.lit("")))).alias("text"))


@register("clean_participants")
def clean_participants(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_participants(participants_raw()).alias("participants"))


@register("clean_disciplines")
def clean_disciplines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_disciplines(disciplines_raw()).alias("disciplines"))


@register("compose_text")
def compose_text_q(spark, sf):
    r = records(spark, sf).withColumn("disciplines", tx.clean_disciplines(disciplines_raw()))
    names = list(TEMPLATES)
    rendered = F.array(*[F.struct(F.lit(n).alias("template"),
                                  compose_text(n, title="title", abstract="abstract",
                                               disciplines="disciplines").alias("doc")) for n in names])
    return (r.select(F.col("id").alias("doc_id"), F.explode(rendered).alias("t"))
             .select("doc_id", F.col("t.template").alias("template"), F.md5(F.col("t.doc")).alias("text_md5"),
                     F.length("t.doc").alias("n_chars")))


@register("stopword_clean")
def stopword_clean(spark, sf):
    r = records(spark, sf)
    return r.select(F.col("id").alias("doc_id"),
                    tx.stopword_clean(compose_text("plain", title="title", abstract="abstract")).alias("cleaned"))


@register("break_abstract")
def break_abstract(spark, sf):
    r = records(spark, sf)
    doc = compose_text("labelled", title="title", abstract="abstract")
    return r.select(F.col("id").alias("doc_id"), tx.break_before_abstract(doc).alias("result"))


# ---------------------------------------------------------------- curation

from reclink.operators import curate as cu  # noqa: E402


@register("min_length_filter")
def min_length_filter(spark, sf):
    return cu.min_length(records(spark, sf), cu.PROJECT_MIN).select(F.col("id").alias("doc_id"))


@register("boilerplate_filter")
def boilerplate_filter(spark, sf):
    r = records(spark, sf)
    kept = cu.drop_boilerplate(r, "abstract", cu.BOILERPLATE_ABSTRACTS)
    # proxy boilerplate: texts that more than one document has
    copies = r.groupBy(F.md5("text").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text")).where("n > 1")
    kept = cu.drop_boilerplate(kept, "text", copies.select("text"))
    return kept.select(F.col("id").alias("doc_id"))


@register("linked_only")
def linked_only(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("proj_ids"))
    pubs = c.join(o, "c_custkey", "left").withColumn("proj_ids", F.coalesce("proj_ids", F.array().cast("array<bigint>")))
    return cu.linked_only(pubs).select("c_custkey")


@register("dedup_keep_first")
def dedup_keep_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return cu.dedup_first(d, "text", "doc_id", unique_order=True).select("doc_id", "source")


@register("merge_by_title")
def merge_by_title(spark, sf):
    r = (records(spark, sf)
         .select(F.col("title"), F.col("id"), F.col("abstract"),
                 participants_raw().alias("participants"),
                 F.col("lang").alias("disciplines"),
                 F.col("dataProvider")))
    m = cu.merge_by_title(r, "id", first_cols=("id", "abstract"), split_cols=("participants", "disciplines"),
                          whole_cols=("dataProvider",))
    return m.select("title", "id", F.md5("abstract").alias("abstract_md5"),
                    F.md5("participants").alias("participants_md5"), "disciplines", "dataProvider")


@register("title_search")
def title_search(spark, sf):
    from reclink.operators.search import title_search as ts
    return ts(records(spark, sf), "the", 10).select(F.col("id").alias("doc_id"), "title")


# ---------------------------------------------------------------- sampling and linkage joins

from reclink.operators import sample as sm  # noqa: E402

# fixed values: evaluation sample size and seeds
SAMPLE_N = 100
SEED = 42
REPLICATE_SEEDS = list(range(20))
ELIGIBLE_PRICE = 200000.0  # proxy for "project abstract longer than 200 characters"


def _link_tables(spark, sf):
    pubs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf, "orders")
    links = o.select(F.col("o_custkey").alias("pub_id"), F.col("o_orderkey").alias("proj_id"))
    projects = o.where(F.col("o_totalprice") > ELIGIBLE_PRICE).select(F.col("o_orderkey").alias("id"))
    return pubs, links, projects


@register("left_join_participants")
def left_join_participants(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("participants"))
    return sm.attach_participants(o, c, legacy_id="o_custkey").select("o_orderkey", "o_custkey", "participants")


@register("sample_linked")
def sample_linked(spark, sf):
    pubs, links, projects = _link_tables(spark, sf)
    kp, kj = sm.linked_sample(pubs, links, projects, SAMPLE_N, SEED)
    return (kp.select(F.lit("pub").alias("role"), "id")
              .unionByName(kj.select(F.lit("proj").alias("role"), "id")))


@register("replicate_samples")
def replicate_samples(spark, sf):
    pubs, links, projects = _link_tables(spark, sf)
    kp, kj = sm.linked_replicates(pubs, links, projects, SAMPLE_N, REPLICATE_SEEDS)
    return (kp.select(F.lit("pub").alias("role"), F.col("replicate_id").cast("int").alias("replicate_id"), "id")
              .unionByName(kj.select(F.lit("proj").alias("role"),
                                     F.col("replicate_id").cast("int").alias("replicate_id"), "id")))


# ---------------------------------------------------------------- vectors, embedding, store

from reclink.functions import vectors as vx  # noqa: E402
from reclink.operators.embed import HashingEmbedder, blend_stores, embed, embed_records, normalize_store  # noqa: E402
from reclink.sources import store as st  # noqa: E402

HASH_DIM = 64


def _nnz(c):
    return F.size(F.filter(F.col(c), lambda x: x != 0)).cast("long")


@register("l2_normalize")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vx.checksum(vx.l2_normalize("embedding")), 6).alias("checksum"),
                    F.round(vx.norm("embedding"), 6).alias("norm"))


@register("embed_hash")
def embed_hash(spark, sf):
    r = records(spark, sf).select("id", compose_text("plain", title="title", abstract="abstract").alias("doc"))
    v = embed(r, "doc", HashingEmbedder(HASH_DIM))
    return v.select(F.col("id").alias("doc_id"), _nnz("vec").alias("nnz"),
                    F.round(vx.checksum("vec"), 6).alias("checksum"))


@register("blend_vectors")
def blend_vectors(spark, sf):
    r = records(spark, sf)
    a = embed(r.select("id", "title"), "title", HashingEmbedder(HASH_DIM)).select("id", "vec")
    b = embed(r.select("id", "abstract"), "abstract", HashingEmbedder(HASH_DIM)).select("id", "vec")
    bl = blend_stores(a, b, 0.2, 0.8)
    return bl.select(F.col("id").alias("doc_id"), F.round(vx.checksum("vec"), 6).alias("checksum"))


def _store_and_batch(spark, sf):
    store = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
                                                  "label")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    batch = embed(lab.join(docs, "id", "inner"), "text", HashingEmbedder(HASH_DIM)).select("id", "vec", "label")
    # every fourth id comes twice in the batch; the later row (by nth) holds
    again = batch.where("id % 4 = 0").withColumn("label", F.col("label") + 10).withColumn("nth", F.lit(1))
    return store, batch.withColumn("nth", F.lit(0)).unionByName(again)


def _store_out(df):
    return df.select("id", "label", F.round(vx.checksum("vec"), 6).alias("checksum"))


@register("store_upsert")
def store_upsert(spark, sf):
    store, batch = _store_and_batch(spark, sf)
    return _store_out(st.upsert(store, batch, order="nth"))


@register("store_append")
def store_append(spark, sf):
    store, batch = _store_and_batch(spark, sf)
    return _store_out(st.append(store, batch, order="nth"))


@register("normalize_store")
def normalize_store_q(spark, sf):
    # norms from 0 to 4
    v = vectors(spark, sf).select("id", F.transform("vec", lambda x: x.cast("double") * (F.col("id") % 5)).alias("vec"))
    return normalize_store(v).select("id", F.round(vx.checksum("vec"), 6).alias("checksum"))


@register("store_convert")
def store_convert(spark, sf):
    path = _fresh(spark, "by-provider")
    st.convert(vectors(spark, sf, with_provider=True), path)
    return st.read(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.col("dataProvider").cast("string").alias("dataProvider"))


@register("store_cached")
def store_cached(spark, sf):
    # a first run sees the even ids, the second all: only the odd ones are computed then
    path = _fresh(spark, "cached")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    compute = lambda df: df.select("id", F.md5("text").alias("digest"))
    st.cached(spark, path, compute, docs.where("id % 2 = 0"))
    return st.cached(spark, path, compute, docs)


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("store_scan")
def store_scan(spark, sf):
    store, _ = _store_and_batch(spark, sf)
    ids = table(spark, sf, "labels").select("doc_id")
    return st.scan(store, ["label"], ids)


# ---------------------------------------------------------------- kNN variants and evaluation

from reclink.operators.knn import nearest  # noqa: E402
from reclink.operators.search import correlated  # noqa: E402


@register("knn_filtered")
def knn_filtered(spark, sf):
    r = _knn_all(spark, sf, 10, on=["dataProvider"])
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


@register("hit_rate_filtered")
def hit_rate_filtered(spark, sf):
    _, hr = _hit_rates(spark, sf, ev.K_GRID_SHORT, on=["dataProvider"])
    return hr.select("k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


QUERY_ID = 0  # the record whose neighbours the single-query searches return


@register("knn_single")
def knn_single(spark, sf):
    v = vectors(spark, sf)
    row = v.where(F.col("id") == QUERY_ID).select("vec").first()  # point lookup (P5)
    return nearest(v, None if row is None else row[0], 10).select("rank", "sid", F.round("dist", 6).alias("dist"))


@register("missed_queries")
def missed_queries(spark, sf):
    fr, _ = _hit_rates(spark, sf, [30])
    return ev.misses(fr, 10).select("qid", "first_rank")


@register("hit_rate_variance")
def hit_rate_variance(spark, sf):
    # the samples first, then kNN for the sampled vectors only; SAMPLE_N rows per seed: size-bounded broadcasts
    v = vectors(spark, sf)
    reps = materialize(sm.replicate_samples(v.select("id"), SAMPLE_N, REPLICATE_SEEDS)
                       .select("replicate_id", F.col("id").alias("qid")))
    ids = reps.select(F.col("qid").alias("id")).distinct()
    qv = v.join(F.broadcast(ids), "id", "left_semi").withColumnRenamed("label", "q_label")
    r = knn_join(qv, v.withColumnRenamed("label", "s_label"), 10, exclude_self=True, q_carry=("q_label",), s_carry=("s_label",),
                 n_queries=SAMPLE_N * len(REPLICATE_SEEDS))
    fr = ev.first_hit_rank(r, ids.withColumnRenamed("id", "qid"), F.col("q_label") == F.col("s_label"))
    per = fr.join(F.broadcast(reps), "qid", "inner")
    rates = ev.hit_rate(per, ev.K_GRID_SHORT, by=["replicate_id"])
    out = ev.hit_rate_variance(rates)
    return out.select("k", "n_replicates", *[F.round(c, 6).alias(c) for c in
                                             ("mean_hit_rate", "sd_hit_rate", "min_hit_rate", "max_hit_rate")])


@register("correlated_lookup")
def correlated_lookup(spark, sf):
    v = vectors(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("doc"))
    return correlated(v.where(F.col("id") == QUERY_ID), v, docs, 5)


# ---------------------------------------------------------------- bag of words

@register("bow_counts")
def bow_counts(spark, sf):
    # per-document bag-of-words size: row expressions only, no shuffle
    r = records(spark, sf)
    t = tx.tokens(compose_text("plain", title="title", abstract="abstract"))
    return r.select(F.col("id").alias("doc_id"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"),
                    F.size(t).cast("long").alias("n_tokens"))


@register("dictionary")
def dictionary(spark, sf):
    from reclink.operators.topics import dictionary as terms
    return terms(_token_docs(spark, sf))


# ---------------------------------------------------------------- XML pages

from reclink.sources import xml_pages as xp  # noqa: E402

PAGE_SIZE = 50


def _derived_pages(spark, sf):
    """SOAP export pages rendered from the documents (PAGE_SIZE records per page)."""
    r = records(spark, sf).withColumn("page_no", F.floor(F.col("id") / PAGE_SIZE).cast("int"))
    return xp.records_to_pages(r, PAGE_SIZE, entity="project")


@register("xml_projects")
def xml_projects(spark, sf):
    parsed = xp.parse_pages(_derived_pages(spark, sf), "project", sanitize="ascii")
    recs = cu.min_length(xp.extract_projects(parsed), cu.PROJECT_MIN)
    return recs.select("projId", "title", F.md5("abstract").alias("abstract_md5"), "dataProvider")


_SOAP = '<soap:Envelope xmlns:soap="http://schemas.xmlsoap.org/soap/envelope/"><soap:Body>{}</soap:Body></soap:Envelope>'
_RESULT = '<fris:getProjectsResponse xmlns:fris="http://fris.ewi.be/"><queryResult total="{}">{}</queryResult></fris:getProjectsResponse>'


def _odd_pages(spark, sf):
    """The derived pages, then: the last one again, a fault, an empty, a broken one, and one of incomplete records."""
    pages = _derived_pages(spark, sf)
    last = table(spark, sf, "documents").agg(F.floor(F.max("doc_id") / PAGE_SIZE).cast("int")).first()[0]
    text = lambda el, t: f'<fris:{el}><fris:texts><fris:text locale="en">{t}</fris:text></fris:texts></fris:{el}>'
    title, abstract = text("name", "A title"), text("projectAbstract", "An abstract")
    odd = [_SOAP.format("<soap:Fault><faultcode>c</faultcode><faultstring>s</faultstring></soap:Fault>"),
           _SOAP.format(_RESULT.format(0, "")), _SOAP.format("<fris:getProjects")[:70],
           _SOAP.format(_RESULT.format(4, f"<fris:project>{title}{abstract}</fris:project><fris:project uuid='no-title'>{abstract}</fris:project>"
                                          f"<fris:project uuid='no-abstract'>{title}</fris:project><fris:project uuid='whole'>{title}{abstract}</fris:project>"))]
    rest = spark.createDataFrame([("derived", last + 2 + i, x) for i, x in enumerate(odd)], "export string, page_no int, xml string")
    again = pages.where(F.col("page_no") == last).withColumn("page_no", F.lit(last + 1))
    return pages.unionByName(again).unionByName(rest)


@register("xml_rejects")
def xml_rejects(spark, sf):
    parsed = xp.parse_pages(_odd_pages(spark, sf), "project", sanitize="ascii")
    return xp.rejects(parsed, "project").select("page_no", "uuid", "reason")


@register("xml_publications")
def xml_publications(spark, sf):
    """Publications with people, organisations in two places, plain and coded disciplines and linked projects."""
    r = records(spark, sf).withColumn("page_no", F.floor(F.col("id") / PAGE_SIZE).cast("int"))
    person = lambda a, b: F.struct(a.cast("string").alias("first"), b.cast("string").alias("last"))
    src, lang = F.col("dataProvider"), F.col("lang")
    r = (r.withColumn("people", F.array(person(F.lit("Ann"), src), person(F.lit(None), lang), person(F.lit("B&b"), lang), person(lang, F.lit(None))))
          .withColumn("terms", F.array(src, F.concat(lang, F.lit(" <studies>"))))
          .withColumn("coded", F.array(F.struct(F.lit("0101").alias("code"), src.alias("term"))))
          .withColumn("orgs", F.array(F.concat(F.lit("Org "), src), F.lit(""), F.lit("Alpha")))
          .withColumn("own_orgs", F.array(F.concat(F.lit("Institute "), lang), F.lit("Alpha")))
          .withColumn("proj_ids", F.filter(F.array(F.col("id") - 1, F.col("id") + 1), lambda x: x % 3 != 0)))
    pages = xp.records_to_pages(r, PAGE_SIZE, entity="journalContribution")
    recs = xp.extract_publications(xp.parse_pages(pages, "journalContribution", "unicode"))
    recs = cu.min_length(recs, cu.PUBLICATION_MIN)
    join = lambda c: F.array_join(c, "|").alias(c)
    return recs.select("id", join("projId"), F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"), join("participants"),
                       join("disciplines"), join("flemishDisciplines"), join("organization"), "dataProvider")


def _legacy_pages(spark, sf):
    """CERIF pages: a project and a publication for each document, PAGE_SIZE a page."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    el = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    r = records(spark, sf)
    i = F.col("id").cast("string")
    link = lambda n: el("cfProj_ResPubl", el("cfProjId", (F.col("id") + n).cast("string")))
    rec = F.concat(
        el("cfProj", F.concat(el("cfProjId", i), el("cfAbstr", esc(F.col("abstract"))), F.lit('<cfEndDate xsi:nil="true"/>'),
                              el("cfPers", F.concat(el("cfFirstNames", F.lit("Ann")), el("cfFamilyNames", esc(F.col("dataProvider"))))),
                              el("cfPers", el("cfFirstNames", F.lit("Bo"))), el("cfPers", F.concat(el("cfFirstNames", F.lit("Bo")), el("cfFamilyNames", F.col("lang")))))),
        el("cfResPubl", F.concat(el("cfPublId", i), F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, link(1)).otherwise(F.concat(link(1), link(2))))))
    head = ('<CERIF xmlns="urn:xmlns:org:eurocris:cerif-1.5-1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">')
    return (r.select(F.floor(F.col("id") / PAGE_SIZE).alias("page_no"), rec.alias("x"))
             .groupBy("page_no").agg(F.array_join(F.collect_list("x"), "").alias("x"))
             .select("page_no", F.concat(F.lit(head), "x", F.lit("</CERIF>")).alias("xml")))


@register("legacy_projects")
def legacy_projects(spark, sf):
    p = xp.legacy_projects(_legacy_pages(spark, sf))
    return p.select("projId", F.md5(tx.squash_ws("abstract")).alias("abstract_md5"), "participants")


@register("legacy_publications")
def legacy_publications(spark, sf):
    return xp.legacy_publications(_legacy_pages(spark, sf))


def _csv_back(spark, sf, ranges):
    from reclink.sources import csv_io
    r = records(spark, sf).select(
        F.col("id").cast("string").alias("projId"), "title", "abstract", F.split(participants_raw("title"), ", ", -1).alias("participants"),
        F.array("lang", "dataProvider").alias("disciplines"), "dataProvider")
    path = _fresh(spark, "csv")
    csv_io.write_records_csv(r, path)
    schema = ", ".join(f"{c} string" for c in r.columns)
    back = csv_io.read_records_csv(spark, path, schema=schema, ranges=ranges)
    return back.select("projId", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"), F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"),
                       F.size("participants").alias("n_participants"), F.array_join("disciplines", "|").alias("disciplines"), "dataProvider")


@register("csv_roundtrip")
def csv_roundtrip(spark, sf):
    return _csv_back(spark, sf, False)


@register("csv_ranges")
def csv_ranges(spark, sf):
    """S7 by byte ranges: the same files, each read by as many tasks as it has splits."""
    return _csv_back(spark, sf, True)


@register("ingest_pages")
def ingest_pages(spark, sf):
    """ST1: page files -> stream -> store; a second stream over other pages feeds the same store."""
    from reclink.streaming.ingest import ingest
    pages, base = _derived_pages(spark, sf), _fresh(spark, "ingest")
    for part in (0, 1):
        (pages.where(F.col("page_no") % 2 == part).select("page_no", "xml").write.partitionBy("page_no").text(f"{base}/in{part}"))
        ingest(spark, f"{base}/in{part}/*", f"{base}/vec", f"{base}/ckpt{part}", embedder=HashingEmbedder(HASH_DIM))
    return st.current(spark, f"{base}/vec").select("id", F.md5("doc").alias("doc_md5"), F.round(vx.checksum("vec"), 6).alias("checksum"), "dataProvider")


@register("page_audit")
def page_audit(spark, sf):
    parsed = xp.parse_pages(_odd_pages(spark, sf), "project", sanitize="ascii")
    return xp.audit_pages(parsed, "project", PAGE_SIZE)


# ---------------------------------------------------------------- approximate kNN and topic models
# (no SQL oracle: iterative / randomised fits; covered by tests against brute force)

from reclink.operators import lda, wordvec  # noqa: E402
from reclink.operators import topics as tp  # noqa: E402
from reclink.operators.knn import knn_lsh  # noqa: E402

LSH_TABLES, LSH_BITS, VEC_DIM = 8, 6, 64


@register("knn_lsh")
def knn_lsh_q(spark, sf):
    v = vectors(spark, sf)
    return knn_lsh(v, v, 10, dim=VEC_DIM, tables=LSH_TABLES, bits=LSH_BITS, exclude_self=True).select(
        "qid", "sid", "rank", F.round("dist", 6).alias("dist"))


def _as_tokens(r):
    return r.select("id", F.col("lang").alias("truth"),
                    tx.tokens(compose_text("plain", title="title", abstract="abstract")).alias("tokens"))


def _token_docs(spark, sf):
    return _as_tokens(records(spark, sf))


def _spread_token_docs(spark, sf):
    """Token documents split once, by all tasks however the file is cut, for queries that read them several times."""
    r = records(spark, sf).select("id", "lang", "title", "abstract").repartition("id")
    with shuffles_freed(spark):
        return materialize(_as_tokens(r))


def _retrieval_rates(vecs, ks):
    qv = vecs.select("id", "vec", F.col("truth").alias("q_truth"))
    sv = vecs.select("id", "vec", F.col("truth").alias("s_truth"))
    r = knn_join(qv, sv, max(ks), exclude_self=True, q_carry=("q_truth",), s_carry=("s_truth",))
    fr = ev.first_hit_rank(r, vecs.select(F.col("id").alias("qid")), F.col("q_truth") == F.col("s_truth"))
    return ev.hit_rate(fr, ks).select("k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


@register("lda_topics")
def lda_topics(spark, sf):
    docs = _spread_token_docs(spark, sf)
    tv = lda.topic_vectors(docs, lda.fit(docs, tp.dictionary(docs), tp.LDA_TOPICS, seed=tp.LDA_SEED))
    return tv.select(F.col("id").alias("doc_id"), F.array_position(
        tv.vec, F.array_max("vec")).cast("int").alias("top_topic"))


def _held_out(c="id"):
    return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) == 0


@register("lda_retrieval")
def lda_retrieval(spark, sf):
    """Documents the model has not seen go through its dictionary and query those it has."""
    docs = _spread_token_docs(spark, sf)
    known, new = docs.where(~_held_out()), docs.where(_held_out())
    model = lda.fit(known, tp.dictionary(known), tp.LDA_TOPICS, seed=tp.LDA_SEED)
    store = lda.topic_vectors(known, model).select("id", "vec", F.col("truth").alias("s_truth"))
    qv = lda.topic_vectors(new, model).select("id", "vec", F.col("truth").alias("q_truth"))
    r = knn_join(qv, store, max(ev.K_GRID_LONG), q_carry=("q_truth",), s_carry=("s_truth",))
    fr = ev.first_hit_rank(r, new.select(F.col("id").alias("qid")), F.col("q_truth") == F.col("s_truth"))
    return ev.hit_rate(fr, ev.K_GRID_LONG).select("k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


@register("doc2vec_query")
def doc2vec_query(spark, sf):
    """Unseen documents as free text -> nearest trained documents."""
    docs = _spread_token_docs(spark, sf)
    known, new = docs.where(~_held_out()), docs.where(_held_out())
    model = wordvec.fit(known, tp.dictionary(known), min_count=tp.DOC2VEC_MIN_COUNT)
    r = wordvec.query_documents(model, wordvec.doc_vectors(known, model), new, max(ev.K_GRID_LONG))
    truth = lambda d, a, b: d.select(F.col("id").alias(a), F.col("truth").alias(b))
    r = r.join(truth(new, "qid", "q_truth"), "qid").join(truth(known, "sid", "s_truth"), "sid")
    fr = ev.first_hit_rank(r, new.select(F.col("id").alias("qid")), F.col("q_truth") == F.col("s_truth"))
    return ev.hit_rate(fr, ev.K_GRID_LONG).select("k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


def _kmeans_topics(spark, sf):
    r = records(spark, sf).select("id", compose_text("plain", title="title", abstract="abstract").alias("doc"))
    # vectors are computed once, for the fits and the assignment; texts are cut into tokens after the join
    emb = materialize(embed(r, "doc", HashingEmbedder(HASH_DIM)).select("id", "vec"))
    return tp.cluster_topics(r.join(emb, "id").select("id", "vec", tx.tokens("doc").alias("tokens")), k=None)


@register("topics_kmeans")
def topics_kmeans(spark, sf):
    _, words, _ = _kmeans_topics(spark, sf)
    return words.select("topic", "rank", "term", F.round("score", 6).alias("score"))


@register("find_topics")
def find_topics(spark, sf):
    _, _, model = _kmeans_topics(spark, sf)
    cents = tp.centroids(spark, model)
    term = spark.createDataFrame([("cancer",)], "t string")
    q = embed(term, "t", HashingEmbedder(HASH_DIM)).first()["vec"]  # one embedded search term
    return nearest(cents, q, 5).select("rank", F.col("sid").alias("topic"), F.round("dist", 6).alias("dist"))


@register("pca_2d")
def pca_2d(spark, sf):
    p = tp.project_2d(vectors(spark, sf))
    return p.select("id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("compare_models")
def compare_models(spark, sf):
    """The same evaluation over two stores, provided vectors and hashed texts, the first also by provider."""
    _, plain = _hit_rates(spark, sf, ev.K_GRID_SHORT)
    _, prov = _hit_rates(spark, sf, ev.K_GRID_SHORT, on=["dataProvider"])
    r = records(spark, sf).select("id", compose_text("plain", title="title", abstract="abstract").alias("doc"))
    hashed = embed(vectors(spark, sf).select("id", "label").join(r, "id"), "doc", HashingEmbedder(HASH_DIM))
    ranked = knn_join(hashed.select("id", "vec", F.col("label").alias("q_label")), hashed.select("id", "vec", F.col("label").alias("s_label")),
                      max(ev.K_GRID_SHORT), exclude_self=True, q_carry=("q_label",), s_carry=("s_label",))
    fr = ev.first_hit_rank(ranked, hashed.select(F.col("id").alias("qid")), F.col("q_label") == F.col("s_label"))
    out = ev.compare_models({"all_store": plain, "same_provider": prov, "hashed_text": ev.hit_rate(fr, ev.K_GRID_SHORT)})
    return out.select("model", "k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate"))


# ---------------------------------------------------------------- linkage evaluation: publications -> project store

def _link_eval(spark, sf, on):
    """Even documents are projects, odd ones publications that list the projects before and after them.

    The two sides use different templates; queries are a sample of the
    publications; truth is the list of project ids, as exact membership and as
    the substring test.
    """
    r = records(spark, sf).withColumn("disciplines", tx.clean_disciplines(disciplines_raw()))
    projects, pubs = r.where("id % 2 = 0"), r.where("id % 2 = 1")
    store = embed_records(projects, "labelled_disc", HashingEmbedder(HASH_DIM), title="title", abstract="abstract", disciplines="disciplines")
    sample = materialize(sm.sample_n(pubs.select("id", "title", "abstract", "dataProvider"), SAMPLE_N, SEED))
    queries = embed_records(sample, "instruct_pub", HashingEmbedder(HASH_DIM), title="title", abstract="abstract")
    ranked = knn_join(queries.select("id", "vec", "dataProvider"), store.select("id", "vec", "dataProvider"), max(ev.K_GRID_LONG), on=on, n_queries=SAMPLE_N)
    # The substring test sees the id list as text, so project 1 is also found in "11,13"
    truth = sample.select(F.col("id").alias("qid"), F.array(F.col("id") - 1, F.col("id") + 1).alias("ids"))
    judged = ranked.join(F.broadcast(truth), "qid")  # SAMPLE_N rows
    out = {}
    for compat, t in (("exact", F.col("ids")), ("substring", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))):
        fr = ev.first_hit_rank(judged, truth, ev.is_hit(F.col("sid"), t, compat))
        out[compat] = ev.hit_rate(fr, ev.K_GRID_LONG)
    return (ev.compare_models(out).withColumnRenamed("model", "compat")
              .select("compat", "k", "n_queries", "hits", F.round("hit_rate", 6).alias("hit_rate")))


@register("link_eval")
def link_eval(spark, sf):
    return _link_eval(spark, sf, None)


@register("link_eval_provider")
def link_eval_provider(spark, sf):
    return _link_eval(spark, sf, ["dataProvider"])


# ---------------------------------------------------------------- pruned and probed kNN

from reclink.operators import relational as rel  # noqa: E402
from reclink.operators.embed import embed_distinct  # noqa: E402
from reclink.operators.knn import knn_multiprobe  # noqa: E402
from reclink.operators.pivots import knn_pruned  # noqa: E402


@register("knn_pruned")
def knn_pruned_q(spark, sf):
    v = vectors(spark, sf)
    return knn_pruned(v, v, 10, exclude_self=True).hits.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


MIN_RECALL = 0.9


@register("knn_multiprobe")
def knn_multiprobe_q(spark, sf):
    """K5: the approximate join's share of the exact one's neighbours, over all vectors."""
    v = vectors(spark, sf)
    found = knn_multiprobe(v, v, 10, dim=VEC_DIM, exclude_self=True).select("qid", "sid", F.lit(1).alias("hit"))
    exact = knn_join(v, v, 10, exclude_self=True).select("qid", "sid")
    return exact.join(found, ["qid", "sid"], "left").agg(
        F.count(F.lit(1)).alias("n_pairs"), (F.count("hit") >= MIN_RECALL * F.count(F.lit(1))).alias("recall_reached"))


@register("knn_where")
def knn_where(spark, sf):
    """Only stored vectors of the lower half of the labels can be neighbours."""
    v = vectors(spark, sf)
    r = knn_join(v, v, 5, where=F.col("label") < 5, exclude_self=True)
    return r.select("qid", "sid", "rank", F.round("dist", 6).alias("dist"))


# ---------------------------------------------------------------- content cache, distinct embedding, ingest rejects

@register("store_fingerprint")
def store_fingerprint(spark, sf):
    """A first run over other texts for every third id, odd ids missing and ids that go; the second over all documents."""
    path = _fresh(spark, "fingerprint")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")

    def compute(run):
        return lambda df: df.select("_fp", "id", F.md5("text").alias("digest"), F.lit(run).alias("computed_in"))
    before = (docs.where("id % 2 = 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
                  .unionByName(docs.where("id % 5 = 0").withColumn("id", -1 - F.col("id"))))
    st.materialize_once(spark, path, compute(1), before)
    return st.materialize_once(spark, path, compute(2), docs)


@register("embed_distinct")
def embed_distinct_q(spark, sf):
    r = records(spark, sf).select("id", compose_text("plain", title="title", abstract="abstract").alias("doc"))
    v = embed_distinct(r, "doc", HashingEmbedder(HASH_DIM), batch_tokens=20_000)
    return v.select(F.col("id").alias("doc_id"), _nnz("vec").alias("nnz"), F.round(vx.checksum("vec"), 6).alias("checksum"))


def _write_pages(pages, path):
    pages.select("page_no", "xml").write.mode("append").partitionBy("page_no").text(path)


def _ingest_derived(spark, base, **kw):
    """Ingest pages written as ``base/in/page_no=N/part-...``; ``in`` is the export."""
    from reclink.streaming.ingest import ingest
    ingest(spark, f"{base}/in/*", f"{base}/vec", f"{base}/ckpt", embedder=HashingEmbedder(HASH_DIM), rejects_path=f"{base}/rejects",
           export_pattern=r"^(.*)/page_no=[^/]*/[^/]*$", page_pattern=r"page_no=(\d+)/[^/]*$", **kw)


@register("ingest_rejects")
def ingest_rejects(spark, sf):
    """ST1: rejects of a stream that is started again; the page delivered a second time is no news then."""
    pages, base = materialize(_odd_pages(spark, sf)), _fresh(spark, "ingest")
    last = table(spark, sf, "documents").agg(F.floor(F.max("doc_id") / PAGE_SIZE).cast("int")).first()[0]
    for again in (False, True):
        _write_pages(pages.where((F.col("page_no") == last + 1) == F.lit(again)), f"{base}/in")
        _ingest_derived(spark, base)
    return st.read(spark, f"{base}/rejects").select("page_no", "uuid", "reason")


@register("ingest_publications")
def ingest_publications(spark, sf):
    """ST1 with another entity and F20 key."""
    r = records(spark, sf).withColumn("page_no", F.floor(F.col("id") / PAGE_SIZE).cast("int"))
    base = _fresh(spark, "ingest")
    _write_pages(xp.records_to_pages(r, PAGE_SIZE, entity="journalContribution"), f"{base}/in")
    _ingest_derived(spark, base, entity="journalContribution", key="id")
    return st.current(spark, f"{base}/vec").select("id", F.md5("doc").alias("doc_md5"), "dataProvider")


# ---------------------------------------------------------------- small operators on their own

@register("store_flat")
def store_flat(spark, sf):
    path = _fresh(spark, "flat")
    st.write(vectors(spark, sf), path)
    return _store_out(st.read(spark, path))


@register("one_hot_dense")
def one_hot_dense(spark, sf):
    """sparse source indicators as dense arrays."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("s:"), F.coalesce("source", F.lit(""))).alias("source"))
    d = StringIndexer(inputCol="source", outputCol="i", stringOrderType="alphabetAsc").fit(d).transform(d)
    d = OneHotEncoder(inputCol="i", outputCol="v", dropLast=False).fit(d).transform(d)
    dense = vx.sparse_to_dense("v")
    return d.select("doc_id", F.size(dense).alias("n"), F.array_position(dense, F.lit(1.0)).alias("place"))


@register("truncated_ids")
def truncated_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.truncate_id("url", 20).alias("short_id"))


@register("complete_rows")
def complete_rows(spark, sf):
    """Labelled documents only."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf, "documents").select("doc_id", "source")
    return cu.drop_any_null(d.join(lab, "doc_id", "left"))


@register("record_lookup")
def record_lookup(spark, sf):
    from reclink.operators.search import lookup
    return lookup(table(spark, sf, "documents"), QUERY_ID, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@register("title_search_regex")
def title_search_regex(spark, sf):
    from reclink.operators.search import title_search as ts
    return ts(records(spark, sf), "^[A-M].*[aeiou]S", 10, literal=False).select(F.col("id").alias("doc_id"), "title")


def _token_arrays(spark, sf):
    r = records(spark, sf)
    return r.select(F.col("id").alias("doc_id"), tx.tokens(compose_text("plain", title="title", abstract="abstract")).alias("terms"))


@register("distinct_links")
def distinct_links(spark, sf):
    return rel.distinct_links(_token_arrays(spark, sf), "terms", "term")


@register("sorted_distinct")
def sorted_distinct(spark, sf):
    return _token_arrays(spark, sf).select("doc_id", F.md5(F.array_join(rel.sorted_distinct("terms"), " ")).alias("terms_md5"))


@register("step_counts")
def step_counts(spark, sf):
    n_in, n_out, _ = rel.step_counts(records(spark, sf), lambda d: cu.min_length(d, cu.PROJECT_MIN))
    return spark.createDataFrame([(n_in, n_out)], "rows_in long, rows_out long")


@register("head_orders")
def head_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rel.head(o, 20, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@register("top_k_orders")
def top_k_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.top_k(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@register("append_rows")
def append_rows(spark, sf):
    """Batches with different columns."""
    return rel.append_batches(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("quality", "doc_id"))


@register("saved_model")
def saved_model(spark, sf):
    """The document vectors of a model before it was saved and after it was loaded."""
    from pyspark.ml.feature import Word2VecModel
    docs = _spread_token_docs(spark, sf)
    model, path = tp.fit_doc2vec(docs, passes=1), _fresh(spark, "model")
    tp.save_model(model, path)
    a = tp.doc_vectors(docs, model).select("id", "vec")
    b = tp.doc_vectors(docs, tp.load_model(Word2VecModel, path)).select("id", F.col("vec").alias("again"))
    return a.join(b, "id").select(F.col("id").alias("doc_id"), (F.col("vec") == F.col("again")).alias("same"))


# ---------------------------------------------------------------- bucketed store, title index

@register("store_buckets")
def store_buckets(spark, sf):
    """S9 on the bucketed store: a batch, compaction, and part of the batch once more."""
    from reclink.sources.buckets import BucketStore
    store, batch = _store_and_batch(spark, sf)
    b = BucketStore(spark, _fresh(spark, "buckets"), buckets=16)
    b.upsert(store)
    b.upsert(materialize(batch), order="nth")
    b.compact()
    b.upsert(b.current().where("id % 10 = 0"))
    return _store_out(b.current())


@register("store_buckets_append")
def store_buckets_append(spark, sf):
    from reclink.sources.buckets import BucketStore
    store, batch = _store_and_batch(spark, sf)
    b = BucketStore(spark, _fresh(spark, "buckets"), buckets=16)
    b.append(store)
    b.append(batch, order="nth")
    return _store_out(b.current())


@register("title_index")
def title_index_q(spark, sf):
    from reclink.operators import title_index
    path = _fresh(spark, "titles")
    title_index.build(records(spark, sf), path)
    return title_index.search(spark, path, "The ", 10).select(F.col("id").alias("doc_id"), "title")
