"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.llm import chat, importance, line_dedup, mixing, negatives, packing, passages, pii, quality, simhash, token_files, topk, url_filter
from dialoglake.llm.common import shared_folder, table
from dialoglake.llm.tokens import find_tokenizer

#: A name without a folder: each worker looks it up where its tokenizers are.
TOKENIZER = "word_bpe_49k.json"

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), topk.whole_parts(F.col("embedding")).alias("vec"))
    vectors = vectors.where("id is not null and vec is not null")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP4_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
n AS (SELECT *, row_number() OVER () AS i FROM u),
m AS (
  SELECT n.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM n LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""

def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.withColumn("base_failed", ~quality.passes("base")).withColumn("kept", quality.passes("v1"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, read off the ledger's bits."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), "v1")


OP2_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT i, ws, unnest(range(1, len(ws) - 6)) AS p FROM w),
k AS (SELECT i, p, count(*) OVER (PARTITION BY i, array_to_string(ws[p:p+7], ' ')) AS c FROM p),
r AS (SELECT i, count(DISTINCT p + o) AS n FROM k, range(8) t(o) WHERE c > 1 GROUP BY i),
l AS (SELECT i, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY i),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (i) LEFT JOIN d USING (i)),
f AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT)::BIGINT AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept FROM f
"""
ABLATION_SQL = OP2_SQL.replace("SELECT *, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept FROM f", """
SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS failing, count(*) FILTER (WHERE failed = bit) AS only_this, count(*) FILTER (WHERE failed = bit OR failed = 0) AS kept_without
FROM f, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32)) r(rule, bit) GROUP BY rule""")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def tokenizer_path() -> str:
    return find_tokenizer(TOKENIZER)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies_by_row(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k.name) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, chat FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND d.l[1:c.n] = c.l) AND NOT EXISTS (SELECT 1 FROM c d WHERE d.l = c.l AND d.conv_id < c.conv_id)
"""

def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_removed")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS i, doc_id, text FROM documents),
l AS (SELECT i, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
w AS (SELECT i, n, row_number() OVER (PARTITION BY i ORDER BY n) AS k, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (
  SELECT *, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY i ORDER BY k)),
r AS (SELECT i, k, row_number() OVER (PARTITION BY win ORDER BY i, k) > 1 AS later FROM t WHERE win IS NOT NULL),
g AS (SELECT DISTINCT w.i, w.n FROM r JOIN w ON w.i = r.i AND w.k BETWEEN r.k AND r.k + 2 WHERE later),
c AS (
  SELECT l.i, string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL) AS text, count(g.n) AS n_removed
  FROM l LEFT JOIN g ON g.i = l.i AND g.n = l.n GROUP BY l.i)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN c USING (i)
"""


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("first").alias("first_word"), F.col("end").alias("end_word"), F.col("from_id").alias("source_doc_id"), "matched")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), topk.whole_parts(F.col("embedding")).alias("vec"))
    return negatives.hard_negatives(rows.where("id % 50 = 0"), rows)


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS MATERIALIZED (
  SELECT a.i, a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS own, list_inner_product(a.vec, c.vec)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.vec) = len(c.vec) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, other_id) AS k FROM s WHERE own QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.i, p.k ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s ON p.i = s.i AND NOT s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return token_files.read_token_files(spark, folder).withColumnRenamed("id", "doc_id")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


WORDS_OF = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH tb AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS i, {WORDS_OF} AS ws FROM documents),
b AS (SELECT unnest({WORDS_OF}) AS w FROM benchmark),
u AS (SELECT i, unnest(ws) AS w FROM d),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM u UNION SELECT w FROM b)),
k AS MATERIALIZED (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, tb),
sc AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (w) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM sc)::DOUBLE AS sn, (SELECT coalesce(sum(t), 0) FROM tc)::DOUBLE AS tn),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tn + 10000))))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket), n),
m AS (SELECT i, count(*) AS n, sum(gain) AS total FROM u JOIN k USING (w) JOIN g USING (bucket) GROUP BY i),
q AS (SELECT doc_id, i, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (i)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, i) AS k, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * able // 100 THEN k END AS rank FROM r
"""


QUERIES = {f.__name__: f for f in (op1_topk, op2_quality, op3_mixing, op4_url_rules, op5_line_dedup, op6_pii, op7_simhash, op8_packing, op9_chat, op10_passages, op11_hard_negatives, op12_token_files, op13_importance, quality_ablation)}
ORACLES = {"op1_topk": OP1_SQL, "op2_quality": OP2_SQL, "quality_ablation": ABLATION_SQL, "op4_url_rules": OP4_SQL, "op5_line_dedup": OP5_SQL, "op9_chat": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_importance": OP13_SQL}
