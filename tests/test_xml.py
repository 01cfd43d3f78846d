"""Hand-written export pages: quirks of record extraction and the page audit."""

import os
import tempfile

from pyspark.sql import functions as F

from reclink.sources import xml_pages as xp

NS = 'xmlns:soap="http://schemas.xmlsoap.org/soap/envelope/"'


def page(records: str, total: int = 3, response="getProjectsResponse") -> str:
    return (f'<?xml version="1.0" encoding="UTF-8"?><soap:Envelope {NS}><soap:Body>'
            f'<fris:{response} xmlns:fris="http://fris.ewi.be/"><queryResult total="{total}">{records}'
            f'</queryResult></fris:{response}></soap:Body></soap:Envelope>')


def loc(el, en=None, nl="x"):
    t = f'<fris:text locale="nl">{nl}</fris:text>'
    if en is not None:
        t += f'<fris:text locale="en">{en}</fris:text>'
    return f"<fris:{el}><fris:texts>{t}</fris:texts></fris:{el}>"


ABS = "word " * 40
P1 = ('<fris:project uuid="p1">' + loc("name", "A &lt;b&gt;bold&lt;/b&gt; title\x07") + loc("projectAbstract", ABS)
      + '<fris:participants><fris:participant><fris:person><fris:name><fris:firstName>Ann</fris:firstName>'
        '<fris:lastName>Lee</fris:lastName></fris:name></fris:person><fris:organisation>'
      + loc("name", "Org B") + '</fris:organisation></fris:participant>'
        '<fris:participant><fris:person><fris:name><fris:firstName>NoLast</fris:firstName></fris:name>'
        '</fris:person><fris:organisation>' + loc("name", "Org A") + '</fris:organisation></fris:participant>'
        '</fris:participants>'
        '<fris:flemishDisciplines><fris:flemishDisciplines term="010101">'
        '<fris:description>' + loc("x", "Algebra")[len("<fris:x>"):-len("</fris:x>")].join(["", ""])
      + '</fris:description></fris:flemishDisciplines></fris:flemishDisciplines>'
        '<fris:dataProvider>UGent</fris:dataProvider></fris:project>')
P2 = '<fris:project uuid="p2">' + loc("name", None) + loc("projectAbstract", ABS) + '</fris:project>'  # no en title
P3 = '<fris:project uuid="p3">' + loc("name", "Short") + loc("projectAbstract", "") + '</fris:project>'  # empty abs
FAULT = f'<soap:Envelope {NS}><soap:Body><soap:Fault><faultstring>busy</faultstring></soap:Fault></soap:Body></soap:Envelope>'
BROKEN = f'<soap:Envelope {NS}><soap:Body><queryResult>'


def write_pages(pages: dict) -> str:
    d = tempfile.mkdtemp(prefix="reclink-xml-")
    for n, body in pages.items():
        with open(os.path.join(d, f"page{n}.xml"), "w", encoding="utf-8") as f:
            f.write(body)
    return d


def test_extract_projects_quirks(spark):
    d = write_pages({0: page(P1 + P2 + P3)})
    parsed = xp.parse_pages(xp.read_raw_pages(spark, d), "project", "unicode")
    rows = {r.projId: r for r in xp.extract_projects(parsed).collect()}
    assert set(rows) == {"p1", "p3"}          # p2 has no en title element: skipped
    p1 = rows["p1"]
    assert p1.title == "A bold title"          # HTML removed, control char sanitised away
    assert p1.abstract == ABS.strip()
    assert p1.participants == ["Ann Lee"]      # person without a last name skipped
    assert p1.organization == ["Org A", "Org B"]
    assert p1.dataProvider == "UGent"
    assert rows["p3"].abstract == ""           # empty element: '' (falls to the length filter)
    curated = xp.read_projects(spark, d).collect()
    assert [r.projId for r in curated] == ["p1"]


def test_publication_links(spark):
    def pub(uid, links):
        lk = "".join(f'<fris:researchOutputProject><fris:project uuid="{x}"/></fris:researchOutputProject>'
                     for x in links)
        return (f'<fris:journalContribution uuid="{uid}">' + loc("title", "Some title") + loc("researchAbstract", ABS)
                + f"<fris:researchOutputProjects>{lk}</fris:researchOutputProjects></fris:journalContribution>")
    d = write_pages({0: page(pub("a", []) + pub("b", ["p1"]) + pub("c", ["p1", "p2"]),
                             response="getResearchOutputResponse")})
    rows = {r.id: r.projId for r in xp.read_publications(spark, d).collect()}
    assert rows == {"a": [], "b": ["p1"], "c": ["p1", "p2"]}


def test_page_audit(spark):
    d = write_pages({0: page(P1 + P3, total=2500), 1: page(P1, total=2500), 2: FAULT, 3: BROKEN,
                     4: page("", total=2500)})
    parsed = xp.parse_pages(xp.read_raw_pages(spark, d), "project", "unicode")
    a = {r.page_no: r for r in xp.audit_pages(parsed, "project", 1000).collect()}
    assert [a[i].status for i in range(5)] == ["ok", "ok", "fault", "unparseable", "empty"]
    assert a[0].n_records == 2 and a[0].first_uuid == "p1" and a[0].expected_pages == 3
    assert a[1].is_repeat and not a[0].is_repeat


def test_sanitize_and_strip(spark):
    df = spark.createDataFrame([("a\x01b\U0001F600c é",)], "x string")
    r = df.select(xp.sanitize_xml("x", "unicode").alias("u"), xp.sanitize_xml("x", "ascii").alias("a"),
                  xp.strip_namespaces(F.lit('<r xmlns="http://fris.ewi.be/response" xsi:nil="true"/>')).alias("s")
                  ).first()
    assert r.u == "abc é" and r.a == "abc "
    assert r.s == '<?xml version="1.0" encoding="ISO-8859-1"?><r/>'


def test_organisations_of_the_record_itself(spark):
    own = "<organisations><organisation><name><texts><text locale='en'>Own Institute</text></texts></name></organisation></organisations>"
    src = write_pages({0: page(P1.replace("</project>", own + "</project>").replace("</fris:project>", own + "</fris:project>"))})
    parsed = xp.parse_pages(xp.read_raw_pages(spark, src), "project", "ascii")
    assert "Own Institute" in xp.extract_projects(parsed).first().organization


def test_outcomes_are_the_extracted_records_and_the_rejects_in_one_pass(spark):
    no_id = "<fris:project>" + loc("name", "T") + loc("projectAbstract", "A") + "</fris:project>"
    d = write_pages({0: page(P1 + P2 + P3 + no_id), 1: FAULT, 2: BROKEN, 3: page(""), 4: page(P1.replace("bold&lt;/b&gt;", "caf&amp;eacute;  &lt; 3\n\n\tx"))})
    parsed = xp.parse_pages(xp.read_raw_pages(spark, d), "project", "unicode")
    got = xp.outcomes(parsed, "project")
    kept = got.where("reason IS NULL").select(*xp.extract_projects(parsed).columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, xp.extract_projects(parsed).collect()))
    assert [r.title for r in kept.collect() if "caf" in r.title] == ["A café < 3 x title"]
    told = sorted((r.page_no, r.uuid, r.reason) for r in got.where("reason IS NOT NULL").collect() if r.uuid)
    assert told == [(0, "p2", "no title")]
    assert sorted((r.page_no, r.reason) for r in xp.rejects(parsed, "project").where("uuid IS NULL").collect()) == [
        (0, "no uuid"), (1, "fault"), (2, "unparseable")]
    plan = xp.rejects(parsed, "project")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml(") == 1  # pages and records of one parse
