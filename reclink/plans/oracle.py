"""DuckDB oracle SQL for the registered queries (same column names and rounding)."""

from __future__ import annotations

ORACLE: dict = {}

# squared L2 distance in double precision between q.embedding and s.embedding
_L2SQ = ("list_sum(list_transform(range(1, len(q.embedding) + 1), "
         "lambda i: pow(q.embedding[i]::DOUBLE - s.embedding[i]::DOUBLE, 2)))")


def _knn_ranked(k: int, same_provider: bool = False) -> str:
    """CTEs ``pairs`` (all ordered pairs, no self pairs) and ``ranked`` (row_number)."""
    ctes = []
    join = ""
    if same_provider:
        ctes.append("""prov AS (SELECT e.vec_id, coalesce(d.source, '') AS p
           FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)""")
        join = "JOIN prov pq ON pq.vec_id = q.vec_id JOIN prov ps ON ps.vec_id = s.vec_id AND ps.p = pq.p"
    ctes.append(f"""pairs AS (
    SELECT q.vec_id AS qid, s.vec_id AS sid, q.label AS q_label, s.label AS s_label, {_L2SQ} AS d
    FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id {join})""")
    ctes.append("""ranked AS (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk FROM pairs)""")
    return "WITH " + ",\n  ".join(ctes) + "\n"


ORACLE["knn_exact"] = _knn_ranked(10) + """
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist FROM ranked WHERE rnk <= 10
"""


def _hit_rate_sql(ks: list, same_provider: bool = False) -> str:
    kmax = max(ks)
    grid = ", ".join(str(k) for k in ks)
    return _knn_ranked(kmax, same_provider) + f""",
  fr AS (
    SELECT e.vec_id AS qid,
           min(r.rnk) FILTER (WHERE r.q_label = r.s_label AND r.rnk <= {kmax}) AS first_rank
    FROM embeddings e LEFT JOIN ranked r ON r.qid = e.vec_id
    GROUP BY e.vec_id),
  g AS (SELECT CAST(unnest([{grid}]) AS INTEGER) AS k)
SELECT g.k AS k, count(*) AS n_queries, count(*) FILTER (WHERE fr.first_rank <= g.k) AS hits,
       round(100.0 * count(*) FILTER (WHERE fr.first_rank <= g.k) / count(*), 6) AS hit_rate
FROM fr CROSS JOIN g GROUP BY g.k
"""


ORACLE["hit_rate_at_k"] = _hit_rate_sql([1, 2, 3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100])


# ---------------------------------------------------------------- shared SQL pieces

from reclink.functions.stopwords import ENGLISH_STOPWORDS  # noqa: E402
from reclink.functions.templates import INSTRUCT_PROJ, INSTRUCT_PUB  # noqa: E402
from reclink.operators.curate import BOILERPLATE_ABSTRACTS  # noqa: E402
from reclink.plans.tables import MARKUP  # noqa: E402


# White space, as in the specification of F1 and F17
_WS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RECS = """recs AS (
    SELECT doc_id AS id,
           CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
           CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract,
           source AS dataProvider, lang, text
    FROM documents)"""


# References that occur in the driver tables and in MARKUP, with their code points; "&amp;" comes last.
_REFERENCES = [("&nbsp;", 160), ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&apos;", 39), ("&#39;", 39), ("&middot;", 183),
               ("&copy;", 169), ("&mdash;", 8212), ("&eacute;", 233), ("&#233;", 233), ("&#x27;", 39), ("&beta;", 946), ("&amp;", 38)]

def html_to_text_sql(c: str) -> str:
    """A tag opens with a letter, "/" and a letter, "!" or "?" after "<"; any other "<" is text."""
    x = f"coalesce({c}, '')"
    for body in ("<!--.*?-->", "<script\\b[^>]*>.*?</script\\s*>", "<style\\b[^>]*>.*?</style\\s*>"):
        x = f"regexp_replace({x}, {lit(body)}, ' ', 'gis')"
    x = f"regexp_replace({x}, '<(/?[A-Za-z]|[!?])[^>]*>', ' ', 'g')"
    for ref, code in _REFERENCES:
        x = f"replace({x}, {lit(ref)}, chr({code}))"
    return squash_sql(x)


def squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(_WS + '+')}, ' ', 'g'))"


def participants_raw_sql(c: str = "text") -> str:
    return f"regexp_replace({c}, '[.][ \\n]*', ', ', 'g')"


def disciplines_raw_sql(c: str = "text") -> str:
    return f"replace({c}, chr(10), ';')"


def clean_participants_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(string_split(coalesce({c}, ''), ', '))), ', ')"


def clean_disciplines_sql(c: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_transform(string_split(coalesce({c}, ''), ';'), "
            f"lambda x: substr(x, 8)))), ', ')")


SW_SQL = "[" + ", ".join(lit(w) for w in ENGLISH_STOPWORDS) + "]"


def stopword_clean_sql(c: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split(coalesce({c}, ''), ' '), lambda x: lower(x)), "
            f"lambda x: NOT list_contains({SW_SQL}, x)), ' ')")


TEMPLATES_SQL = {
    "plain": "title || ' ' || abstract",
    "labelled": "'Title: ' || title || ' Abstract: ' || abstract",
    "labelled_tight": "'Title: ' || title || ' Abstract:' || abstract",
    "labelled_disc": "'Title: ' || title || ' Abstract: ' || abstract || ' Disciplines: ' || disciplines",
    "instruct_pub": f"{lit(INSTRUCT_PUB)} || title || ' ' || abstract",
    "instruct_pub_labelled": f"{lit(INSTRUCT_PUB + ' Title: ')} || title || ' Abstract: ' || abstract",
    "instruct_proj": (f"{lit(INSTRUCT_PROJ + ' Title: ')} || title || ' Abstract: ' || abstract "
                      "|| ' Disciplines: ' || disciplines"),
}


def break_abstract_sql(c: str) -> str:
    ws = _WS
    return f"regexp_replace({c}, {lit(ws + '*Abstract:' + ws + '*')}, chr(10) || 'Abstract: ')"


# ---------------------------------------------------------------- text functions

ORACLE["html_to_text"] = f"SELECT page_id, {html_to_text_sql(lit(MARKUP) + " || coalesce(html, '')")} AS text FROM pages"

ORACLE["clean_participants"] = (f"SELECT doc_id, {clean_participants_sql(participants_raw_sql())} AS participants "
                                "FROM documents")

ORACLE["clean_disciplines"] = (f"SELECT doc_id, {clean_disciplines_sql(disciplines_raw_sql())} AS disciplines "
                               "FROM documents")

ORACLE["compose_text"] = f"WITH {RECS}, r AS (SELECT *, {clean_disciplines_sql(disciplines_raw_sql())} AS disciplines FROM recs)\n" + \
    "\nUNION ALL\n".join(
        f"SELECT id AS doc_id, {lit(n)} AS template, md5({e}) AS text_md5, CAST(length({e}) AS INTEGER) AS n_chars FROM r"
        for n, e in TEMPLATES_SQL.items())

ORACLE["stopword_clean"] = (f"WITH {RECS} SELECT id AS doc_id, {stopword_clean_sql(TEMPLATES_SQL['plain'])} AS cleaned "
                            "FROM recs")

ORACLE["break_abstract"] = (f"WITH {RECS} SELECT id AS doc_id, {break_abstract_sql(TEMPLATES_SQL['labelled'])} "
                            "AS result FROM recs")

# ---------------------------------------------------------------- curation

ORACLE["min_length_filter"] = f"WITH {RECS} SELECT id AS doc_id FROM recs WHERE length(abstract) >= 150 AND length(title) >= 5"

ORACLE["boilerplate_filter"] = f"""WITH {RECS},
  copies AS (SELECT text FROM recs GROUP BY text HAVING count(*) > 1)
SELECT id AS doc_id FROM recs
WHERE abstract NOT IN ({', '.join(lit(t) for t in BOILERPLATE_ABSTRACTS)})
  AND text NOT IN (SELECT text FROM copies)"""

ORACLE["linked_only"] = "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"

ORACLE["dedup_keep_first"] = """SELECT doc_id, source FROM (
    SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""

ORACLE["merge_by_title"] = f"""WITH {RECS},
  r AS (SELECT title, id, abstract, {participants_raw_sql()} AS participants, lang AS disciplines, dataProvider FROM recs)
SELECT title, min(id) AS id,
       md5(arg_min(abstract, id) FILTER (WHERE abstract IS NOT NULL)) AS abstract_md5,
       md5(array_to_string(list_sort(list_distinct(flatten(list(string_split(participants, ', '))
           FILTER (WHERE participants IS NOT NULL)))), ', ')) AS participants_md5,
       array_to_string(list_sort(list_distinct(flatten(list(string_split(disciplines, ', '))
           FILTER (WHERE disciplines IS NOT NULL)))), ', ') AS disciplines,
       array_to_string(list_sort(list_distinct(list(dataProvider) FILTER (WHERE dataProvider IS NOT NULL))), ', ')
           AS dataProvider
FROM r WHERE title IS NOT NULL GROUP BY title"""

ORACLE["title_search"] = f"""WITH {RECS}
SELECT id AS doc_id, title FROM recs
WHERE title IS NOT NULL AND contains(lower(title), 'the')
ORDER BY title, id LIMIT 10"""


# ---------------------------------------------------------------- sampling and linkage joins

_SEEDS = list(range(20))

ORACLE["left_join_participants"] = """
SELECT o.o_orderkey, o.o_custkey, c.c_name AS participants
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderkey IS NOT NULL AND o.o_custkey IS NOT NULL AND o.o_orderstatus IS NOT NULL
  AND o.o_totalprice IS NOT NULL AND o.o_orderdate IS NOT NULL AND o.o_orderpriority IS NOT NULL"""

ORACLE["sample_linked"] = """
WITH linked AS (SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
  s AS (SELECT id FROM linked ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 100),
  sl AS (SELECT o_custkey AS pub_id, o_orderkey AS proj_id FROM orders WHERE o_custkey IN (SELECT id FROM s)),
  kp AS (SELECT o_orderkey AS id FROM orders
         WHERE o_totalprice > 200000.0 AND o_orderkey IN (SELECT proj_id FROM sl)),
  kpub AS (SELECT id FROM s WHERE id IN (SELECT pub_id FROM sl WHERE proj_id IN (SELECT id FROM kp)))
SELECT 'pub' AS role, id FROM kpub UNION ALL SELECT 'proj' AS role, id FROM kp"""

ORACLE["replicate_samples"] = f"""
WITH linked AS (SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
  seeds AS (SELECT CAST(unnest({_SEEDS}) AS INTEGER) AS replicate_id),
  s AS (SELECT replicate_id, id FROM (
          SELECT seeds.replicate_id, linked.id,
                 row_number() OVER (PARTITION BY seeds.replicate_id
                                    ORDER BY md5(CAST(linked.id AS VARCHAR) || '|' || CAST(seeds.replicate_id AS VARCHAR)),
                                             linked.id) AS rn
          FROM linked CROSS JOIN seeds) WHERE rn <= 100),
  sl AS (SELECT s.replicate_id, o.o_custkey AS pub_id, o.o_orderkey AS proj_id
         FROM orders o JOIN s ON s.id = o.o_custkey),
  kp AS (SELECT DISTINCT sl.replicate_id, o.o_orderkey AS id FROM sl JOIN orders o ON o.o_orderkey = sl.proj_id
         WHERE o.o_totalprice > 200000.0),
  kpub AS (SELECT DISTINCT sl.replicate_id, sl.pub_id AS id FROM sl
           JOIN kp ON kp.replicate_id = sl.replicate_id AND kp.id = sl.proj_id)
SELECT 'pub' AS role, replicate_id, id FROM kpub UNION ALL SELECT 'proj' AS role, replicate_id, id FROM kp"""

# ---------------------------------------------------------------- vectors, embedding, store

_CHECKSUM_E = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * i))"
_NORM_E = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"

ORACLE["l2_normalize"] = f"""
SELECT vec_id,
       round(CASE WHEN {_NORM_E} > 0 THEN {_CHECKSUM_E} / {_NORM_E} ELSE {_CHECKSUM_E} END, 6) AS checksum,
       round({_NORM_E}, 6) AS norm
FROM embeddings"""


def hashed_vectors_sql(src: str, text: str, name: str, dim: int = 64) -> str:
    """CTEs: ``{name}`` (id, dim, x) sparse float32 hashed bag-of-words of ``text`` over ``src``."""
    return f"""{name}_t AS (SELECT id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {src}),
  {name}_b AS (SELECT id, CAST((('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim}) AS INTEGER) AS dim,
                      CAST(count(*) AS DOUBLE) AS c
               FROM {name}_t GROUP BY ALL),
  {name}_n AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {name}_b GROUP BY id),
  {name} AS (SELECT b.id, b.dim, CAST(CAST(b.c / n.nrm AS FLOAT) AS DOUBLE) AS x
             FROM {name}_b b JOIN {name}_n n USING (id))"""


ORACLE["embed_hash"] = f"""WITH {RECS},
  {hashed_vectors_sql('recs', "title || ' ' || abstract", 'hv')}
SELECT r.id AS doc_id, count(hv.dim) AS nnz, round(coalesce(sum((hv.dim + 1) * hv.x), 0), 6) AS checksum
FROM recs r LEFT JOIN hv ON hv.id = r.id GROUP BY r.id"""

ORACLE["blend_vectors"] = f"""WITH {RECS},
  {hashed_vectors_sql('recs', 'title', 'va')},
  {hashed_vectors_sql('recs', 'abstract', 'vb')},
  w AS (SELECT coalesce(va.id, vb.id) AS id, coalesce(va.dim, vb.dim) AS dim,
               0.2 * coalesce(va.x, 0) + 0.8 * coalesce(vb.x, 0) AS x
        FROM va FULL OUTER JOIN vb ON va.id = vb.id AND va.dim = vb.dim),
  wn AS (SELECT id, sqrt(sum(x * x)) AS nrm FROM w GROUP BY id)
SELECT r.id AS doc_id,
       round(coalesce(sum((w.dim + 1) * CASE WHEN wn.nrm > 0 THEN w.x / wn.nrm ELSE w.x END), 0), 6) AS checksum
FROM recs r LEFT JOIN w ON w.id = r.id LEFT JOIN wn ON wn.id = r.id GROUP BY r.id"""

_BATCH = f"""lab AS (SELECT l.doc_id AS id, l.quality AS label, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  {hashed_vectors_sql('lab', 'text', 'bv')},
  batch AS (SELECT lab.id, CASE WHEN lab.id % 4 = 0 THEN lab.label + 10 ELSE lab.label END AS label, round(coalesce(sum((bv.dim + 1) * bv.x), 0), 6) AS checksum
            FROM lab LEFT JOIN bv ON bv.id = lab.id GROUP BY lab.id, lab.label),
  store AS (SELECT vec_id AS id, label, round({_CHECKSUM_E}, 6) AS checksum FROM embeddings)"""

ORACLE["store_upsert"] = f"""WITH {_BATCH}
SELECT id, label, checksum FROM batch
UNION ALL SELECT id, label, checksum FROM store WHERE id NOT IN (SELECT id FROM batch)"""

ORACLE["store_append"] = f"""WITH {_BATCH}
SELECT id, label, checksum FROM store
UNION ALL SELECT id, label, checksum FROM batch WHERE id NOT IN (SELECT id FROM store)"""

ORACLE["store_scan"] = "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)"

# ---------------------------------------------------------------- kNN variants and evaluation

ORACLE["knn_filtered"] = _knn_ranked(10, same_provider=True) + """
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist FROM ranked WHERE rnk <= 10
"""

ORACLE["hit_rate_filtered"] = _hit_rate_sql([1, 2, 3, 5, 10], same_provider=True)

ORACLE["knn_single"] = f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
  d AS (SELECT s.vec_id AS sid, {_L2SQ} AS d FROM embeddings s, q)
SELECT CAST(row_number() OVER (ORDER BY round(d, 9), sid) AS INTEGER) AS rank, sid, round(d, 6) AS dist
FROM d ORDER BY round(d, 9), sid LIMIT 10"""

ORACLE["missed_queries"] = _knn_ranked(30) + """,
  fr AS (
    SELECT e.vec_id AS qid,
           CAST(min(r.rnk) FILTER (WHERE r.q_label = r.s_label AND r.rnk <= 30) AS INTEGER) AS first_rank
    FROM embeddings e LEFT JOIN ranked r ON r.qid = e.vec_id
    GROUP BY e.vec_id)
SELECT qid, first_rank FROM fr WHERE first_rank IS NULL OR first_rank > 10"""

ORACLE["hit_rate_variance"] = _knn_ranked(10) + f""",
  fr AS (
    SELECT e.vec_id AS qid,
           min(r.rnk) FILTER (WHERE r.q_label = r.s_label AND r.rnk <= 10) AS first_rank
    FROM embeddings e LEFT JOIN ranked r ON r.qid = e.vec_id
    GROUP BY e.vec_id),
  seeds AS (SELECT CAST(unnest({_SEEDS}) AS INTEGER) AS replicate_id),
  reps AS (SELECT replicate_id, qid FROM (
             SELECT seeds.replicate_id, e.vec_id AS qid,
                    row_number() OVER (PARTITION BY seeds.replicate_id
                                       ORDER BY md5(CAST(e.vec_id AS VARCHAR) || '|' || CAST(seeds.replicate_id AS VARCHAR)),
                                                e.vec_id) AS rn
             FROM embeddings e CROSS JOIN seeds) WHERE rn <= 100),
  g AS (SELECT CAST(unnest([1, 2, 3, 5, 10]) AS INTEGER) AS k),
  rates AS (
    SELECT reps.replicate_id, g.k,
           100.0 * count(*) FILTER (WHERE fr.first_rank <= g.k) / count(*) AS hit_rate
    FROM reps JOIN fr ON fr.qid = reps.qid CROSS JOIN g GROUP BY reps.replicate_id, g.k)
SELECT k, count(replicate_id) AS n_replicates, round(avg(hit_rate), 6) AS mean_hit_rate,
       round(stddev_samp(hit_rate), 6) AS sd_hit_rate, round(min(hit_rate), 6) AS min_hit_rate,
       round(max(hit_rate), 6) AS max_hit_rate
FROM rates GROUP BY k"""

ORACLE["correlated_lookup"] = f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
  d AS (SELECT s.vec_id AS sid, {_L2SQ} AS d FROM embeddings s, q),
  top AS (SELECT CAST(row_number() OVER (ORDER BY round(d, 9), sid) AS INTEGER) AS rank, sid, d
          FROM d ORDER BY round(d, 9), sid LIMIT 5)
SELECT top.rank, top.sid, top.d AS dist,
       {break_abstract_sql("doc.text || ' ' || chr(10) || ' Similarity Score: ' || printf('%.6f', top.d)")} AS result
FROM top JOIN documents doc ON doc.doc_id = top.sid"""

# ---------------------------------------------------------------- bag of words

_TOKENS = f"""{RECS},
  tk AS (SELECT id AS doc_id, unnest(string_split({stopword_clean_sql(TEMPLATES_SQL['plain'])}, ' ')) AS term FROM recs)"""

ORACLE["bow_counts"] = f"""WITH {_TOKENS},
  c AS (SELECT doc_id, term, count(*) AS c FROM tk GROUP BY doc_id, term)
SELECT doc_id, count(*) AS n_terms, sum(c) AS n_tokens FROM c GROUP BY doc_id"""

ORACLE["dictionary"] = f"""WITH {_TOKENS},
  c AS (SELECT doc_id, term, count(*) AS c FROM tk GROUP BY doc_id, term)
SELECT term, count(*) AS doc_freq, sum(c) AS n_tokens FROM c GROUP BY term"""


# ---------------------------------------------------------------- XML pages

def _ascii(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x20-\\x7E\\t\\n\\r]', '', 'g')"


ORACLE["xml_projects"] = f"""WITH {RECS},
  p AS (SELECT CAST(id AS VARCHAR) AS projId, {html_to_text_sql(_ascii('title'))} AS title,
               {html_to_text_sql(_ascii('abstract'))} AS abstract, {_ascii('dataProvider')} AS dataProvider
        FROM recs WHERE lang = 'en')
SELECT projId, title, md5(abstract) AS abstract_md5, dataProvider FROM p
WHERE length(abstract) >= 150 AND length(title) >= 5"""

_PAGES = """n AS (SELECT count(*) AS total, CAST(max(doc_id) // 50 AS INTEGER) AS last FROM documents),
  pg AS (SELECT CAST(doc_id // 50 AS INTEGER) AS page_no, CAST(count(*) AS INTEGER) AS n_records,
                CAST(min(doc_id) AS VARCHAR) AS first_uuid FROM documents GROUP BY doc_id // 50)"""

ORACLE["page_audit"] = f"""WITH {_PAGES}
SELECT 'derived' AS export, page_no, 'ok' AS status, n_records, first_uuid, total, false AS is_repeat,
       CAST(total // 50 + 1 AS INTEGER) AS expected_pages FROM pg, n
UNION ALL SELECT 'derived', last + 1, 'ok', n_records, first_uuid, total, true, CAST(total // 50 + 1 AS INTEGER)
  FROM pg, n WHERE page_no = last
UNION ALL SELECT 'derived', last + 2, 'fault', 0, NULL, NULL, false, NULL FROM n
UNION ALL SELECT 'derived', last + 3, 'empty', 0, NULL, 0, false, 1 FROM n
UNION ALL SELECT 'derived', last + 4, 'unparseable', 0, NULL, NULL, false, NULL FROM n
UNION ALL SELECT 'derived', last + 5, 'ok', 4, NULL, 4, false, 1 FROM n"""

ORACLE["xml_rejects"] = f"""WITH {_PAGES}
SELECT CAST(doc_id // 50 AS INTEGER) AS page_no, CAST(doc_id AS VARCHAR) AS uuid, 'no title' AS reason FROM documents WHERE lang <> 'en'
UNION ALL SELECT last + 1, CAST(doc_id AS VARCHAR), 'no title' FROM documents, n WHERE lang <> 'en' AND doc_id // 50 = last
UNION ALL SELECT last + 2, NULL, 'fault' FROM n
UNION ALL SELECT last + 4, NULL, 'unparseable' FROM n
UNION ALL SELECT last + 5, NULL, 'no uuid' FROM n
UNION ALL SELECT last + 5, 'no-title', 'no title' FROM n
UNION ALL SELECT last + 5, 'no-abstract', 'no abstract' FROM n"""


def _unicode(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{{80}}-\\x{{FFFF}}]', '', 'g')"


ORACLE["xml_publications"] = f"""WITH {RECS},
  p AS (SELECT id, {html_to_text_sql(_unicode('title'))} AS title, {html_to_text_sql(_unicode('abstract'))} AS abstract, dataProvider, lang
        FROM recs WHERE lang = 'en')
SELECT CAST(id AS VARCHAR) AS id,
       array_to_string(list_filter([id - 1, id + 1], lambda x: ((x % 3) + 3) % 3 <> 0), '|') AS projId,
       md5(title) AS title_md5, md5(abstract) AS abstract_md5,
       'Ann ' || dataProvider || '|B&b ' || lang AS participants,
       dataProvider || '|' || lang || ' <studies>' AS disciplines, '0101:' || dataProvider AS flemishDisciplines,
       'Alpha|Institute ' || lang || '|Org ' || dataProvider AS organization, dataProvider
FROM p WHERE length(abstract) >= 50 AND length(title) >= 5"""

ORACLE["legacy_projects"] = f"""WITH {RECS}, p AS (SELECT id, {_unicode('abstract')} AS a, dataProvider, lang FROM recs)
SELECT CAST(id AS VARCHAR) AS projId, md5({squash_sql('a')}) AS abstract_md5, 'Ann ' || dataProvider || ',Bo ' || lang AS participants
FROM p WHERE length(regexp_replace(a, '^[\\s]+|[\\s]+$', '', 'g')) >= 50"""

ORACLE["legacy_publications"] = """SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(doc_id + 1 AS VARCHAR) ELSE (doc_id + 1) || ',' || (doc_id + 2) END AS projId
FROM documents"""

ORACLE["csv_roundtrip"] = f"""WITH {RECS}
SELECT CAST(id AS VARCHAR) AS projId, md5(title) AS title_md5, md5(abstract) AS abstract_md5,
       CAST(len(string_split({participants_raw_sql('title')}, ', ')) AS INTEGER) AS n_participants,
       lang || '|' || dataProvider AS disciplines, dataProvider
FROM recs"""

ORACLE["csv_ranges"] = ORACLE["csv_roundtrip"]

ORACLE["ingest_pages"] = f"""WITH {RECS},
  p AS (SELECT id, {html_to_text_sql(_ascii('title'))} AS title, {html_to_text_sql(_ascii('abstract'))} AS abstract, dataProvider
        FROM recs WHERE lang = 'en'),
  d AS (SELECT id, title || ' ' || abstract AS doc, dataProvider FROM p WHERE length(abstract) >= 150 AND length(title) >= 5),
  {hashed_vectors_sql('d', 'doc', 'hv')}
SELECT CAST(d.id AS VARCHAR) AS id, md5(any_value(d.doc)) AS doc_md5, round(coalesce(sum((hv.dim + 1) * hv.x), 0), 6) AS checksum,
       any_value(d.dataProvider) AS dataProvider
FROM d LEFT JOIN hv ON hv.id = d.id GROUP BY d.id"""

ORACLE["normalize_store"] = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS embedding FROM embeddings)
SELECT vec_id AS id, round(CASE WHEN {_NORM_E} > 0 THEN {_CHECKSUM_E} / {_NORM_E} ELSE {_CHECKSUM_E} END, 6) AS checksum FROM v"""

ORACLE["store_convert"] = """SELECT e.vec_id AS doc_id, e.label, coalesce(d.source, '') AS dataProvider
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""

ORACLE["store_cached"] = "SELECT doc_id AS id, md5(text) AS digest FROM documents"

ORACLE["knn_blocked"] = ORACLE["knn_exact"]

_DOT = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * s.v[i]))"
ORACLE["knn_cosine"] = f"""
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7 * 1000)) AS v FROM embeddings
           UNION ALL SELECT -1, list_transform(embedding, lambda x: 0.0::DOUBLE) FROM embeddings WHERE vec_id = 0),
  n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e),
  d AS (SELECT q.id AS qid, s.id AS sid, CASE WHEN q.nrm = 0 OR s.nrm = 0 THEN 1.0 ELSE 1 - {_DOT} / (q.nrm * s.nrm) END AS d
        FROM n q JOIN n s ON q.id <> s.id)
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk FROM d) WHERE rnk <= 10"""

ORACLE["knn_duplicates"] = f"""
WITH s AS (SELECT vec_id + unnest([0, 1000000, 2000000]) AS vec_id, embedding FROM embeddings),
  d AS (SELECT q.vec_id AS qid, s.vec_id AS sid, {_L2SQ} AS d FROM embeddings q JOIN s ON q.vec_id <> s.vec_id)
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk FROM d) WHERE rnk <= 10"""


def _lsh_sql(tables: int = 8, bits: int = 6, dim: int = 64, seed: int = 42) -> str:
    """The sign of a plane's component is the parity of the first digit of md5('seed|table|bit|component')."""
    return f"""
WITH planes AS (SELECT t, b, list(CASE WHEN ascii(substr(md5('{seed}|' || t || '|' || b || '|' || i), 1, 1)) % 2 = 1
                                       THEN CASE WHEN substr(md5('{seed}|' || t || '|' || b || '|' || i), 1, 1) >= 'a' THEN -1.0 ELSE 1.0 END
                                       ELSE CASE WHEN substr(md5('{seed}|' || t || '|' || b || '|' || i), 1, 1) >= 'a' THEN 1.0 ELSE -1.0 END END
                                  ORDER BY i) AS plane
                FROM range({tables}) t(t), range({bits}) b(b), range({dim}) i(i) GROUP BY t, b),
  h AS (SELECT vec_id, t, sum(CASE WHEN list_sum(list_transform(range(1, {dim} + 1), lambda i: embedding[i]::DOUBLE * plane[i])) > 0
                                   THEN 1 << b ELSE 0 END) AS bucket
        FROM embeddings, planes GROUP BY vec_id, t),
  c AS (SELECT DISTINCT a.vec_id AS qid, b.vec_id AS sid FROM h a JOIN h b ON a.t = b.t AND a.bucket = b.bucket AND a.vec_id <> b.vec_id),
  d AS (SELECT c.qid, c.sid, {_L2SQ} AS d FROM c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings s ON s.vec_id = c.sid)
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk FROM d) WHERE rnk <= 10"""


ORACLE["knn_lsh"] = _lsh_sql()


def _sparse_distances(q: str, s: str) -> str:
    """(qid, sid, d) between all rows of two sparse vector tables (id, dim, x)."""
    return f"""(SELECT a.id AS qid, b.id AS sid, a.n + b.n - 2 * coalesce(p.dot, 0) AS d
     FROM (SELECT id, sum(x * x) AS n FROM {q} GROUP BY id) a CROSS JOIN (SELECT id, sum(x * x) AS n FROM {s} GROUP BY id) b
     LEFT JOIN (SELECT u.id AS qid, w.id AS sid, sum(u.x * w.x) AS dot FROM {q} u JOIN {s} w ON u.dim = w.dim GROUP BY u.id, w.id) p
       ON p.qid = a.id AND p.sid = b.id)"""


def _rates_sql(ks: list, extra: str = "") -> str:
    """From fr(qid, first_rank): the hit rate per k."""
    grid = ", ".join(map(str, ks))
    return f"""SELECT {extra} g.k AS k, count(*) AS n_queries, count(*) FILTER (WHERE fr.first_rank <= g.k) AS hits,
       round(100.0 * count(*) FILTER (WHERE fr.first_rank <= g.k) / count(*), 6) AS hit_rate
FROM fr CROSS JOIN (SELECT CAST(unnest([{grid}]) AS INTEGER) AS k) g GROUP BY ALL"""


_HASHED_MODEL = f"""WITH {RECS},
  src AS (SELECT r.id, r.title || ' ' || r.abstract AS doc, e.label FROM recs r JOIN embeddings e ON e.vec_id = r.id),
  {hashed_vectors_sql('src', 'doc', 'hv')},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk
             FROM {_sparse_distances('hv', 'hv')} WHERE qid <> sid),
  fr AS (SELECT q.id AS qid, min(r.rnk) FILTER (WHERE r.rnk <= 10 AND s.label = q.label) AS first_rank
         FROM src q LEFT JOIN ranked r ON r.qid = q.id LEFT JOIN src s ON s.id = r.sid GROUP BY q.id)
""" + _rates_sql([1, 2, 3, 5, 10])

ORACLE["compare_models"] = (
    "SELECT 'all_store' AS model, * FROM (" + _hit_rate_sql([1, 2, 3, 5, 10]) + ")\nUNION ALL\n"
    "SELECT 'same_provider' AS model, * FROM (" + _hit_rate_sql([1, 2, 3, 5, 10], same_provider=True) + ")\nUNION ALL\n"
    "SELECT 'hashed_text' AS model, * FROM (" + _HASHED_MODEL + ")")


def _link_sql(same_provider: bool) -> str:
    by = "AND s.dataProvider = q.dataProvider" if same_provider else ""
    ks = [1, 2, 3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
    fr = lambda test: f"""SELECT q.id AS qid, min(r.rnk) FILTER (WHERE r.rnk <= 100 AND {test}) AS first_rank
         FROM smp q LEFT JOIN ranked r ON r.qid = q.id GROUP BY q.id"""  # noqa: E731
    head = f"""WITH {RECS}, rd AS (SELECT *, {clean_disciplines_sql(disciplines_raw_sql())} AS disciplines FROM recs),
  proj AS (SELECT id, {TEMPLATES_SQL['labelled_disc']} AS doc, dataProvider FROM rd WHERE id % 2 = 0),
  smp AS (SELECT id, {TEMPLATES_SQL['instruct_pub']} AS doc, dataProvider FROM rd WHERE id % 2 = 1
          ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id LIMIT 100),
  {hashed_vectors_sql('proj', 'doc', 'sv')},
  {hashed_vectors_sql('smp', 'doc', 'qv')},
  ranked AS (SELECT p.qid, p.sid, row_number() OVER (PARTITION BY p.qid ORDER BY round(p.d, 9), p.sid) AS rnk
             FROM {_sparse_distances('qv', 'sv')} p JOIN smp q ON q.id = p.qid JOIN proj s ON s.id = p.sid {by})"""
    exact = head + ", fr AS (" + fr("r.sid IN (q.id - 1, q.id + 1)") + ")\n" + _rates_sql(ks, "'exact' AS compat,")
    sub = head + ", fr AS (" + fr("contains((q.id - 1) || ',' || (q.id + 1), CAST(r.sid AS VARCHAR))") + ")\n" + _rates_sql(ks, "'substring' AS compat,")
    return f"SELECT * FROM ({exact}) UNION ALL SELECT * FROM ({sub})"


ORACLE["link_eval"] = _link_sql(False)
ORACLE["link_eval_provider"] = _link_sql(True)

# ---------------------------------------------------------------- pruned and probed kNN, content cache, ingest

ORACLE["knn_pruned"] = ORACLE["knn_exact"]

# every vector has 10 neighbours, or as many as there are others
ORACLE["knn_multiprobe"] = """SELECT CAST(count(*) * least(10, count(*) - 1) AS BIGINT) AS n_pairs, true AS recall_reached FROM embeddings"""

ORACLE["knn_where"] = f"""WITH pairs AS (
    SELECT q.vec_id AS qid, s.vec_id AS sid, {_L2SQ} AS d FROM embeddings q JOIN embeddings s ON q.vec_id <> s.vec_id AND s.label < 5)
SELECT qid, sid, CAST(rnk AS INTEGER) AS rank, round(d, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), sid) AS rnk FROM pairs) WHERE rnk <= 5"""

ORACLE["store_fingerprint"] = """SELECT doc_id AS id, md5(text) AS digest,
       CAST(CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR text IS NULL) THEN 1 ELSE 2 END AS INTEGER) AS computed_in FROM documents"""

ORACLE["embed_distinct"] = ORACLE["embed_hash"]

ORACLE["ingest_rejects"] = f"""WITH {_PAGES}
SELECT CAST(doc_id // 50 AS INTEGER) AS page_no, CAST(doc_id AS VARCHAR) AS uuid, 'no title' AS reason FROM documents WHERE lang <> 'en'
UNION ALL SELECT last + 2, NULL, 'fault' FROM n
UNION ALL SELECT last + 4, NULL, 'unparseable' FROM n
UNION ALL SELECT last + 5, NULL, 'no uuid' FROM n
UNION ALL SELECT last + 5, 'no-title', 'no title' FROM n
UNION ALL SELECT last + 5, 'no-abstract', 'no abstract' FROM n"""

ORACLE["ingest_publications"] = f"""WITH {RECS},
  p AS (SELECT id, {html_to_text_sql(_unicode('title'))} AS title, {html_to_text_sql(_unicode('abstract'))} AS abstract, dataProvider
        FROM recs WHERE lang = 'en')
SELECT CAST(id AS VARCHAR) AS id, md5(title || ' ' || abstract) AS doc_md5, dataProvider
FROM p WHERE length(abstract) >= 50 AND length(title) >= 5"""

# ---------------------------------------------------------------- small operators on their own

ORACLE["store_flat"] = f"SELECT vec_id AS id, label, round({_CHECKSUM_E}, 6) AS checksum FROM embeddings"

ORACLE["one_hot_dense"] = """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS place, count(*) OVER () AS n
           FROM (SELECT DISTINCT coalesce(source, '') AS source FROM documents))
SELECT d.doc_id, CAST(s.n AS INTEGER) AS n, s.place FROM documents d JOIN s ON s.source = coalesce(d.source, '')"""

ORACLE["truncated_ids"] = "SELECT page_id, substr(url, 1, 20) AS short_id FROM pages"

ORACLE["complete_rows"] = """SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE d.source IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL"""

ORACLE["record_lookup"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id = 0"

ORACLE["title_search_regex"] = f"""WITH {RECS}
SELECT id AS doc_id, title FROM recs WHERE regexp_matches(lower(title), '^[a-m].*[aeiou]s') ORDER BY title, id LIMIT 10"""

ORACLE["distinct_links"] = f"WITH {_TOKENS} SELECT DISTINCT term FROM tk"

ORACLE["sorted_distinct"] = f"""WITH {_TOKENS}
SELECT doc_id, md5(string_agg(term, ' ' ORDER BY term)) AS terms_md5 FROM (SELECT DISTINCT doc_id, term FROM tk) GROUP BY doc_id"""

ORACLE["step_counts"] = f"""WITH {RECS}
SELECT count(*) AS rows_in, count(*) FILTER (WHERE length(abstract) >= 150 AND length(title) >= 5) AS rows_out FROM recs"""

ORACLE["head_orders"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"

ORACLE["top_k_orders"] = """SELECT o_custkey, o_orderkey, o_totalprice, CAST(n AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3"""

ORACLE["append_rows"] = """SELECT doc_id, lang, NULL AS quality FROM documents
UNION ALL SELECT doc_id, NULL, quality FROM labels"""

ORACLE["saved_model"] = "SELECT doc_id, true AS same FROM documents"

ORACLE["store_buckets"] = ORACLE["store_upsert"]
ORACLE["store_buckets_append"] = ORACLE["store_append"]

ORACLE["title_index"] = f"""WITH {RECS}
SELECT id AS doc_id, title FROM recs WHERE contains(lower(title), 'the ') ORDER BY title, id LIMIT 10"""
