"""Paged SOAP/XML exports -> records.

One page file is one row (``text(wholetext=True)``; pages hold at most about a
thousand records, so a row stays small), the raw text is sanitised with
``regexp_replace``, and one permissive ``from_xml`` per page yields the fault
element, the ``total`` attribute, the records and a corrupt-record marker
at once.  Records are exploded and projected with higher-order functions;
nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclink.functions import text as tx

# fixed values: characters kept by the two sanitisers
XML_KEEP_UNICODE = r"[^\x09\x0A\x0D\x20-\x7E\x{80}-\x{FFFF}]"
XML_KEEP_ASCII = r"[^\x20-\x7E\t\n\r]"

# fixed values: attributes removed from legacy pages, and the declaration prepended
LEGACY_STRIP = [
    ' xmlns="http://fris.ewi.be/response"',
    ' xmlns="urn:xmlns:org:eurocris:cerif-1.5-1-FRIS"',
    ' xmlns="urn:xmlns:org:eurocris:cerif-1.5-1"',
    ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"',
    ' xsi:nil="true"',
]
LEGACY_DECLARATION = '<?xml version="1.0" encoding="ISO-8859-1"?>'

_S, _A, _L = T.StringType(), T.ArrayType, T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LOCALISED = _struct(texts=_struct(text=_A(_struct(_VALUE=_S, _locale=_S))))
ORG = _struct(name=LOCALISED)
ORGS = dict(organisation=_A(ORG), organisations=_struct(organisation=_A(ORG)))
PERSON = _struct(person=_struct(name=_struct(firstName=_S, lastName=_S), **ORGS), **ORGS)
COMMON = dict(
    **ORGS,
    participants=_struct(participant=_A(PERSON)),
    disciplines=_struct(discipline=_A(_struct(description=LOCALISED))),
    flemishDisciplines=_struct(flemishDisciplines=_A(_struct(_term=_S, description=LOCALISED))),
    dataProvider=_S,
)
PROJECT = _struct(_uuid=_S, name=LOCALISED, projectAbstract=LOCALISED, **COMMON)
PUBLICATION = _struct(_uuid=_S, title=LOCALISED, researchAbstract=LOCALISED,
                      researchOutputProjects=_struct(researchOutputProject=_A(_struct(project=_struct(_uuid=_S)))),
                      **COMMON)

# (response element, record element, record schema) per entity
ENTITIES = {
    "project": ("getProjectsResponse", "project", PROJECT),
    "journalContribution": ("getResearchOutputResponse", "journalContribution", PUBLICATION),
    "contributionToConference": ("getResearchOutputResponse", "contributionToConference", PUBLICATION),
}

_XML_OPTS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def page_schema(entity: str) -> T.StructType:
    response, record, rec_schema = ENTITIES[entity]
    qr = _struct(_total=_L, **{record: _A(rec_schema)})
    body = _struct(Fault=_struct(faultcode=_S, faultstring=_S), **{response: _struct(queryResult=qr)})
    return _struct(Body=body, _corrupt_record=_S)


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """``export, path, page_no, xml``: one row per page file (page{n}.xml)."""
    raw = spark.read.text(path, wholetext=True)
    fp = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(fp, r"^(.*)/[^/]*$", 1).alias("export"),
        fp.alias("path"),
        F.regexp_extract(fp, r"page(\d+)\.xml$", 1).try_cast("int").alias("page_no"),
        F.col("value").alias("xml"))


def sanitize_xml(c, mode: str = "unicode"):
    """Drop characters XML 1.0 forbids ('unicode'), or all non-ASCII ('ascii')."""
    pat = XML_KEEP_UNICODE if mode == "unicode" else XML_KEEP_ASCII
    return F.regexp_replace(tx.col_(c), pat, "")


def strip_namespaces(c):
    """Remove the fixed namespace/nil attributes and prepend the declaration."""
    x = tx.col_(c)
    for s in LEGACY_STRIP:
        x = F.replace(x, F.lit(s), F.lit(""))
    return F.concat(F.lit(LEGACY_DECLARATION), x)


def parse_pages(pages: DataFrame, entity: str = "project", sanitize: str | None = "unicode") -> DataFrame:
    """Page rows -> page rows with a parsed ``p`` struct (permissive)."""
    x = F.col("xml") if sanitize is None else sanitize_xml("xml", sanitize)
    # the XML declaration is not an element; from_xml wants the root element first
    x = F.regexp_replace(x, r"^\s*<\?xml[^>]*\?>\s*", "")
    return pages.withColumn("p", F.from_xml(x, page_schema(entity), _XML_OPTS))


def _records_of(parsed: DataFrame, entity: str) -> DataFrame:
    response, record, _ = ENTITIES[entity]
    recs = F.col("p.Body").getField(response).getField("queryResult").getField(record)
    return parsed.select("page_no", F.explode_outer(recs).alias("r")).where(F.col("r").isNotNull())


def _en(loc_col, locale="en"):
    return F.filter(loc_col.getField("texts").getField("text"), lambda t: t["_locale"] == F.lit(locale))


def _common(r, locale="en"):
    parts = r.getField("participants").getField("participant")
    none = F.array().cast(_A(ORG))
    at = lambda x: F.concat(F.coalesce(x["organisation"], none), F.coalesce(x["organisations"]["organisation"], none))
    nested = F.flatten(F.transform(F.coalesce(parts, F.array().cast(_A(PERSON))), lambda p: F.concat(at(p), at(p["person"]))))
    orgs = F.transform(F.concat(at(r), nested), lambda o: tx.pick_locale(o["name"]["texts"]["text"], locale))
    return [
        tx.full_names(F.transform(parts, lambda p: p["person"]["name"])).alias("participants"),
        tx.discipline_terms(r.getField("disciplines").getField("discipline"), locale).alias("disciplines"),
        tx.coded_disciplines(r.getField("flemishDisciplines").getField("flemishDisciplines"), locale)
          .alias("flemishDisciplines"),
        F.coalesce(tx.organisations(orgs), F.array().cast("array<string>")).alias("organization"),
        tx.default_provider(r.getField("dataProvider")).alias("dataProvider"),
    ]


def _localised_text(loc_col, locale="en"):
    hit = F.get(_en(loc_col, locale), 0)
    # element present -> text (empty element gives ''), element absent -> NULL (row skipped)
    return F.when(hit.isNotNull(), tx.html_to_text(hit["_VALUE"]))


def _texts_of(entity: str) -> tuple[str, str]:
    """Title and abstract element of an entity."""
    return ("name", "projectAbstract") if entity == "project" else ("title", "researchAbstract")


def _record_columns(entity: str, locale: str) -> list:
    """The columns of a record ``r``: of a project (S1) or of a publication."""
    r = F.col("r")
    title, abstract = _texts_of(entity)
    if entity == "project":
        ids = [r.getField("_uuid").alias("projId")]
    else:
        ids = [r.getField("_uuid").alias("id"),
               F.coalesce(tx.project_ids(r.getField("researchOutputProjects").getField("researchOutputProject")),
                          F.array().cast("array<string>")).alias("projId")]
    return [*ids, _localised_text(r.getField(title), locale).alias("title"),
            _localised_text(r.getField(abstract), locale).alias("abstract"), *_common(r, locale)]


def extract_projects(parsed: DataFrame, locale: str = "en") -> DataFrame:
    """S1 projection: id, title, abstract, participants[], disciplines[],
    flemishDisciplines[], organization[], dataProvider.  Records without an
    en title or abstract element, or without a uuid, are skipped."""
    out = _records_of(parsed, "project").select(*_record_columns("project", locale))
    return out.where(F.col("projId").isNotNull() & F.col("title").isNotNull() & F.col("abstract").isNotNull())


def extract_publications(parsed: DataFrame, entity: str = "journalContribution", locale: str = "en") -> DataFrame:
    """S2 projection: id, projId[] (linked projects), title, abstract, ... as S1."""
    out = _records_of(parsed, entity).select(*_record_columns(entity, locale))
    return out.where(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("abstract").isNotNull())


def read_projects(spark: SparkSession, path: str, min_lengths: dict | None = None) -> DataFrame:
    """Project pages -> curated project records (abstract >= 150, title >= 5)."""
    from reclink.operators.curate import PROJECT_MIN, min_length
    recs = extract_projects(parse_pages(read_raw_pages(spark, path), "project", "ascii"))
    return min_length(recs, min_lengths or PROJECT_MIN)


def read_publications(spark: SparkSession, path: str, row_tag: str = "journalContribution",
                      min_lengths: dict | None = None) -> DataFrame:
    """Publication pages -> curated publication records (abstract >= 50, title >= 5)."""
    from reclink.operators.curate import PUBLICATION_MIN, min_length
    recs = extract_publications(parse_pages(read_raw_pages(spark, path), row_tag, "unicode"), row_tag)
    return min_length(recs, min_lengths or PUBLICATION_MIN)


LEGACY_PUBLICATION = _struct(cfPublId=_S, cfProj_ResPubl=_A(_struct(cfProjId=_S)))
LEGACY_PROJECT = _struct(cfProjId=_S, cfAbstr=_S,
                         cfPers=_A(_struct(cfFirstNames=_S, cfFamilyNames=_S)))


def legacy_projects(pages: DataFrame, min_abstract: int = 50) -> DataFrame:
    """S3 over page rows (``xml``): sanitised (S4), namespaces stripped (S5), projects
    of at least ``min_abstract`` characters of abstract (P1)."""
    names = tx.full_names(F.col("r.cfPers"), "cfFirstNames", "cfFamilyNames")
    return (_legacy(pages, cfProj=_A(LEGACY_PROJECT)).select(F.explode("p.cfProj").alias("r"))
            .select(F.col("r.cfProjId").alias("projId"), F.col("r.cfAbstr").alias("abstract"), F.array_join(names, ",").alias("participants"))
            .where(F.length("abstract") >= min_abstract))


def legacy_publications(pages: DataFrame) -> DataFrame:
    """S3 over page rows: ``id`` and linked ``projId``s joined by ',' (NULL when none)."""
    ids = tx.project_ids(F.col("r.cfProj_ResPubl"), ("cfProjId",))
    return (_legacy(pages, cfResPubl=_A(LEGACY_PUBLICATION)).select(F.explode("p.cfResPubl").alias("r"))
            .select(F.col("r.cfPublId").alias("id"), F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("projId")))


def _legacy(pages: DataFrame, **records) -> DataFrame:
    x = F.regexp_replace(strip_namespaces(sanitize_xml("xml")), r"^\s*(<\?xml[^>]*\?>\s*)+", "")
    return pages.select(F.from_xml(x, _struct(**records), {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("p"))


def read_legacy(spark: SparkSession, path: str, row_tag: str = "cfProj") -> DataFrame:
    """S3: legacy CERIF records (record-level XML source).

    Projects: ``projId, abstract, participants`` (names joined by ','); publications
    (``row_tag='cfResPubl'``): ``id, projId`` (ids joined by ',', NULL when none).
    """
    schema = LEGACY_PROJECT if row_tag == "cfProj" else LEGACY_PUBLICATION
    df = (spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true")
          .schema(schema).load(path))
    if row_tag == "cfProj":
        names = tx.full_names(F.col("cfPers"), "cfFirstNames", "cfFamilyNames")
        return df.select(F.col("cfProjId").alias("projId"), F.col("cfAbstr").alias("abstract"),
                         F.array_join(names, ",").alias("participants"))
    ids = F.transform(F.col("cfProj_ResPubl"), lambda x: x["cfProjId"])
    return df.select(F.col("cfPublId").alias("id"),
                     F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("projId"))


def audit_pages(parsed: DataFrame, entity: str = "project", page_size: int = 1000) -> DataFrame:
    """Per page -- status fault/unparseable/empty/ok, record count, first uuid,
    repeat of the previous page's first uuid, expected page count from ``total``.

    The previous page is found by an equi-join on the page number, so an export of
    any number of pages is spread; of a page number that occurs twice the least first
    uuid is compared.
    """
    response, record, _ = ENTITIES[entity]
    qr = F.col("p.Body").getField(response).getField("queryResult")
    recs = qr.getField(record)
    n = F.coalesce(F.size(recs), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    status = (F.when(F.col("p.Body.Fault").isNotNull(), "fault")
               .when(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull() | F.col("p.Body").isNull(),
                     "unparseable")
               .when(n == 0, "empty")
               .otherwise("ok"))
    first = F.get(recs, 0).getField("_uuid")
    base = parsed.select("export", "page_no", status.alias("status"), n.cast("int").alias("n_records"),
                         first.alias("first_uuid"), qr.getField("_total").alias("total"))
    previous = (base.groupBy(F.col("export").alias("_e"), (F.col("page_no") + 1).alias("_p"))
                    .agg(F.min("first_uuid").alias("_u")))
    return (base.join(previous, (F.col("export") == F.col("_e")) & (F.col("page_no") == F.col("_p")), "left")
                .withColumn("is_repeat", F.coalesce(F.col("first_uuid") == F.col("_u"), F.lit(False)))
                .drop("_e", "_p", "_u")
                .withColumn("expected_pages", (F.floor(F.col("total") / page_size) + 1).cast("int")))


def _outcome_rows(parsed: DataFrame, entity: str, locale: str) -> DataFrame:
    """``export, page_no, reason, r``: a row for every rejected page, without r, and one for every record."""
    response, record, rec_schema = ENTITIES[entity]
    title, abstract = _texts_of(entity)
    page = (F.when(F.col("p.Body.Fault").isNotNull(), "fault")
             .when(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull() | F.col("p.Body").isNull(), "unparseable"))
    recs = F.col("p.Body").getField(response).getField("queryResult").getField(record)
    of = lambda r: F.struct(F.when(r.getField("_uuid").isNull(), "no uuid")
                             .when(F.get(_en(r.getField(title), locale), 0).isNull(), "no title")
                             .when(F.get(_en(r.getField(abstract), locale), 0).isNull(), "no abstract").alias("reason"), r.alias("r"))
    none = F.array().cast(_A(_struct(reason=_S, r=rec_schema)))
    whole = F.when(page.isNotNull(), F.array(F.struct(page.alias("reason"), F.lit(None).cast(rec_schema).alias("r")))).otherwise(none)
    items = F.concat(whole, F.coalesce(F.transform(recs, of), none))
    return (parsed.select("export", "page_no", F.explode(items).alias("i"))
                  .select("export", "page_no", F.col("i.reason").alias("reason"), F.col("i.r").alias("r")))


def outcomes(parsed: DataFrame, entity: str = "project", locale: str = "en") -> DataFrame:
    """What ``extract_*`` keeps and what ``rejects`` tells, in one pass over the pages.

    ``export, page_no, uuid, reason`` and the columns of ``extract_*``; records that
    are kept have no reason.
    """
    return _outcome_rows(parsed, entity, locale).select("export", "page_no", F.col("r._uuid").alias("uuid"), "reason",
                                                        *_record_columns(entity, locale))


def rejects(parsed: DataFrame, entity: str = "project", locale: str = "en") -> DataFrame:
    """What ``extract_*`` leaves out: (export, page_no, uuid, reason).

    A page is rejected as ``fault`` or ``unparseable``; a record for ``no uuid``,
    ``no title`` or ``no abstract`` (in the locale), the first that holds.
    """
    return (_outcome_rows(parsed, entity, locale).where(F.col("reason").isNotNull())
            .select("export", "page_no", F.col("r._uuid").alias("uuid"), "reason"))


def records_to_pages(records: DataFrame, page_size: int, *, entity: str = "project", id_col: str = "id",
                     page_col: str = "page_no") -> DataFrame:
    """Render record rows as SOAP export pages (``page_no, xml``), ``page_size`` per page.

    Used to build XML inputs from tabular data.  ``records`` carries ``id,
    title, abstract, lang, dataProvider`` and ``page_no``, and may carry arrays:
    ``people`` (struct first, last), ``terms``, ``coded`` (struct code, term),
    ``orgs`` (under the participants), ``own_orgs`` (of the record itself) and
    ``proj_ids``.  A page gathers at most ``page_size`` records, so the per-page
    collect is bounded.
    """
    response, record, _ = ENTITIES[entity]
    title_el = "name" if entity == "project" else "title"
    abs_el = "projectAbstract" if entity == "project" else "researchAbstract"

    def esc(c):
        x = F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
        x = F.replace(x, F.lit("<"), F.lit("&lt;"))
        return F.replace(x, F.lit(">"), F.lit("&gt;"))

    def loc(el, c):
        return F.concat(F.lit(f"<fris:{el}><fris:texts><fris:text locale=\""), F.col("lang"), F.lit("\">"),
                        esc(c), F.lit(f"</fris:text></fris:texts></fris:{el}>"))

    def safe(x):
        return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def many(column, item, el):
        """<el>item item ...</el> of an optional array column."""
        if column not in records.columns:
            return F.lit("")
        return F.concat(F.lit(f"<fris:{el}>"), F.array_join(F.transform(column, item), ""), F.lit(f"</fris:{el}>"))

    def en(x):
        return F.concat(F.lit('<fris:texts><fris:text locale="en">'), safe(x), F.lit("</fris:text></fris:texts>"))

    def wrap(el, x, attr=""):
        return F.concat(F.lit(f"<fris:{el}{attr}>"), x, F.lit(f"</fris:{el}>"))

    person = lambda p: wrap("participant", wrap("person", wrap("name", F.concat(
        F.when(p["first"].isNotNull(), wrap("firstName", safe(p["first"]))).otherwise(F.lit("")),
        F.when(p["last"].isNotNull(), wrap("lastName", safe(p["last"]))).otherwise(F.lit(""))))))
    org = lambda o: wrap("organisation", wrap("name", en(o)))
    parts = F.lit("")
    if "people" in records.columns:
        with_orgs = F.lit("")
        if "orgs" in records.columns:
            with_orgs = F.array_join(F.transform("orgs", lambda o: wrap("participant", org(o))), "")
        parts = F.concat(F.lit("<fris:participants>"), F.array_join(F.transform("people", person), ""), with_orgs,
                         F.lit("</fris:participants>"))
    fields = F.concat(
        parts, many("own_orgs", org, "organisations"),
        many("terms", lambda d: wrap("discipline", wrap("description", en(d))), "disciplines"),
        many("coded", lambda d: F.concat(F.lit('<fris:flemishDisciplines term="'), safe(d["code"]), F.lit('">'),
                                         wrap("description", en(d["term"])), F.lit("</fris:flemishDisciplines>")), "flemishDisciplines"),
        many("proj_ids", lambda i: F.concat(F.lit('<fris:researchOutputProject><fris:project uuid="'), i.cast("string"),
                                            F.lit('"/></fris:researchOutputProject>')), "researchOutputProjects"))
    rec = F.concat(F.lit(f"<fris:{record} uuid=\""), F.col(id_col).cast("string"), F.lit("\">"),
                   loc(title_el, "title"), loc(abs_el, "abstract"),
                   fields, F.lit("<fris:dataProvider>"), esc("dataProvider"), F.lit("</fris:dataProvider>"),
                   F.lit(f"</fris:{record}>"))
    total = records.count()
    head = (f'<?xml version="1.0" encoding="UTF-8"?><soap:Envelope xmlns:soap="http://schemas.xmlsoap.org/soap/'
            f'envelope/"><soap:Body><fris:{response} xmlns:fris="http://fris.ewi.be/"><queryResult total="{total}">')
    tail = f"</queryResult></fris:{response}></soap:Body></soap:Envelope>"
    pages = (records.select(page_col, F.struct(F.col(id_col).alias("k"), rec.alias("x")).alias("e"))
                    .groupBy(page_col)
                    .agg(F.array_sort(F.collect_list("e")).alias("es")))
    return pages.select(F.lit("derived").alias("export"), F.col(page_col).alias("page_no"),
                        F.concat(F.lit(head), F.array_join(F.transform("es", lambda e: e["x"]), ""), F.lit(tail))
                        .alias("xml"))
