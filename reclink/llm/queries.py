"""The registered opN_* queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reclink.llm import chat_windows, decontaminate, hard_negatives, langid, merkle, mixing, near_dups, secrets, shards, token_files, toxicity, url_rules, vector_tree
from reclink.llm.common import shared_path, table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
MIX_ALPHA = 0.8  # target weight of a source: its rows to this power


def op1_token_files(spark, sf_dir):
    out = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_file(), end_id=2, words=True)
    return token_files.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pfair_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = mixing.temper(mixing.source_counts(docs), MIX_ALPHA)
    return mixing.mix(docs.select("doc_id", "source", F.crc32(F.col("text").cast("binary")).alias("text")), weights).select(
        F.col("row.doc_id").alias("doc_id"), "source", "epoch", "pos", "slot", "block", "release", "deadline")


def op3_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_rules(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op5_vector_tree(spark, sf_dir):
    return vector_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op7_chat_windows(spark, sf_dir):
    extra = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string"))
    return chat_windows.digests(chat_windows.format_windows(turns, tokenizer_file(), words=True))


def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.digest_text(F.col("base")), 256).alias("base_sha256"),
        secrets.digest_text(F.array_sort(F.concat("base", "markov"))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"))


def op9_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_byte_shards(spark, sf_dir):
    out = shards.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_toxicity(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    learned = lambda df: df.where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(learned(docs), learned(labels))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_merkle_manifest(spark, sf_dir):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(table(spark, sf_dir, "documents"), fields, where=tampered,
                          claimed=[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    folded = merkle.fold(F.col("claim"), F.col("path"))
    return (out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pfair_mix, op3_decontaminate, op5_vector_tree, op6_language, op7_chat_windows, op4_url_rules, op8_secret_scan, op9_near_duplicates, op10_byte_shards, op11_hard_negatives, op12_toxicity, op13_merkle_manifest)}

ORACLE = {
    "op4_url_rules": r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
         ELSE translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
         ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path
                       ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op13_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT *, '+' || lang AS lg,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    xor(4294967295, list_reduce(list_transform(range(1, len(doc_id::VARCHAR)::BIGINT + 1), lambda i: ord(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT),
      lambda crc, b: list_reduce([1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, b)), 4294967295)) % 7 = 0 AS tampered
  FROM documents),
d AS (
  SELECT doc_id, coalesce(lg, '') AS g, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    CASE WHEN tampered THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS other FROM f),
r AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (
  SELECT 0 AS l, g, n, i, leaf AS h FROM r
  UNION ALL SELECT l + 1, g, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY l, g, n, i // 2),
s AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS l, n, i, subroot AS h FROM s
  UNION ALL SELECT l + 1, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, n, i // 2),
p AS (
  SELECT doc_id, leaf, g, 0 AS l, n, i, coalesce(other, leaf) AS fold, '' AS proof FROM r
  UNION ALL SELECT p.doc_id, p.leaf, p.g, p.l + 1, (p.n + 1) // 2, p.i // 2,
    sha256(CASE WHEN t.h IS NULL THEN p.fold WHEN p.i % 2 = 0 THEN p.fold || t.h ELSE t.h || p.fold END), p.proof || coalesce(t.h, '')
  FROM p LEFT JOIN t ON t.l = p.l AND t.g = p.g AND t.i = xor(p.i, 1) WHERE p.n > 1),
q AS (
  SELECT p.doc_id, p.leaf, s.subroot, 0 AS l, s.n, s.i, p.fold, p.proof FROM p JOIN s USING (g) WHERE p.n = 1
  UNION ALL SELECT q.doc_id, q.leaf, q.subroot, q.l + 1, (q.n + 1) // 2, q.i // 2,
    sha256(CASE WHEN u.h IS NULL THEN q.fold WHEN q.i % 2 = 0 THEN q.fold || u.h ELSE u.h || q.fold END), q.proof || coalesce(u.h, '')
  FROM q LEFT JOIN u ON u.l = q.l AND u.i = xor(q.i, 1) WHERE q.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = (SELECT h FROM u WHERE n = 1) AS verified
FROM q WHERE n = 1
""",
    "op11_hard_negatives": """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
