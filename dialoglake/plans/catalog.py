"""Every registered query on the driver's tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoglake.functions import text as tx
from dialoglake.functions import timecode as tc
from dialoglake.operators import chains, cleaning, clips, evaluation, matching, sinks, speakers, stats, voices
from dialoglake.plans import jobs
from dialoglake.sources import adapters as src
from dialoglake.sources import files
from dialoglake.sources.documents import write_documents
from dialoglake.sources.embedding_store import EmbeddingStore
from dialoglake.sources.storage import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the adapters in SQL

UTT = """utt0 AS (SELECT conv_id AS media_id, turn AS seq, role AS speaker, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM conversations),
utt AS (SELECT media_id, seq, speaker, text, (b * 60)::DOUBLE / 1000 AS start, ((b + length(text)) * 60)::DOUBLE / 1000 AS "end" FROM utt0)"""
EVT = """evt AS (SELECT strftime(ts, '%Y-%m-%d') AS media_id, event_id, event_type, 'c' || (user_id % 5)::VARCHAR AS cluster_id, ((epoch_us(ts) % 86400000000) // 1000)::DOUBLE / 1000 AS start, ((epoch_us(ts) % 86400000000) // 1000 + round(value * 1000))::DOUBLE / 1000 AS "end", props AS text FROM events),
turns AS (SELECT media_id, event_id AS track_seq, cluster_id, start, "end" FROM evt WHERE event_type NOT IN ('view', 'click')),
segs AS (SELECT media_id, event_id AS seq, start, "end", text FROM evt WHERE event_type IN ('view', 'click'))"""
VOICE = """first AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
reg AS (SELECT printf('speaker_%05d', label) AS speaker, label AS reg_order, embedding FROM embeddings SEMI JOIN first USING (label, vec_id)),
clu AS (SELECT vec_id % 20 AS media_id, printf('c%08d', vec_id) AS cluster_id, embedding FROM embeddings ANTI JOIN first USING (label, vec_id)),
unit AS (SELECT media_id, cluster_id, embedding::DOUBLE[] AS v FROM clu),
runit AS (SELECT speaker, reg_order, embedding::DOUBLE[] AS v FROM reg),
dist AS (SELECT media_id, cluster_id, speaker, reg_order, 1 - list_cosine_similarity(u.v, r.v) AS d FROM unit u, runit r),
best AS (SELECT media_id, cluster_id, arg_min(speaker, (round(d, 9), reg_order)) AS near, min(d) AS distance FROM dist GROUP BY ALL),
named AS (SELECT media_id, cluster_id, CASE WHEN distance <= 0.8 THEN near ELSE 'Unknown_' || printf('%02d', row_number() OVER (PARTITION BY media_id, distance <= 0.8 ORDER BY cluster_id)) END AS speaker, distance FROM best)"""
ENT = """ent0 AS (SELECT user_id % 20 AS media_id, ts, event_id, event_type, props AS body, (2000 + round(value * 100))::BIGINT AS ms FROM events),
ent1 AS (SELECT *, sum(ms) OVER o AS upto, row_number() OVER o AS entry_no FROM ent0 WINDOW o AS (PARTITION BY media_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
ent AS (SELECT media_id, entry_no, (upto - ms)::DOUBLE / 1000 AS start, upto::DOUBLE / 1000 AS "end", CASE WHEN event_id % 7 = 0 THEN [event_type, 'guest'] WHEN event_id % 11 = 0 THEN []::VARCHAR[] ELSE [event_type] END AS speakers, body FROM ent1)"""
STT = f"""{UTT},
stt AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1 AS id, start, "end", text[1:length(text) - length(text) // 8] AS text, '' AS stt_speaker FROM utt WHERE seq % 5 <> 4),
script AS (SELECT conv_id AS media_id, turn AS id, role AS speaker, text AS dialogue FROM conversations)"""


def cut_sql(sec: str) -> str:
    """``seconds_to_time_str`` in SQL."""
    s = f"greatest({sec}, 0)"
    return f"printf('%02d:%02d:%02d,%03d', (floor({s})::BIGINT // 3600), (floor({s})::BIGINT // 60) % 60, floor({s})::BIGINT % 60, floor(({s} * 1000) % 1000)::BIGINT)"


def even_sql(sec: str) -> str:
    """``format_time`` in SQL."""
    m = f"round_even(greatest({sec}, 0) * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d:%03d', {m} // 3600000, ({m} // 60000) % 60, ({m} // 1000) % 60, {m} % 1000)"


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(translate({0}, '（）', '  '), '\[[^\n]*?\]', ' ', 'g'), '[、,。．.]', ' ', 'g'), '\s+', ' ', 'g'))"
REPEAT_NORM = r"regexp_replace({0}, '[\s、。，．,\.!！?？…‥・「」『』（）\(\)\-―ー~〜:：;；]+', '', 'g')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- scalar functions


@query(f"""WITH {UTT} SELECT media_id, seq, {even_sql('start')} AS even_tc, {cut_sql('start')} AS cut_tc, {even_sql('"end"').replace("%02d:%03d", "%02d,%03d")} AS comma_tc,
round(floor("end") + floor(("end" * 1000) % 1000)::DOUBLE / 1000, 3) AS back, abs(start * 1000 - round_even(start * 1000, 0)) <= 1e-6 AS whole_ms FROM utt""")
def sc1_4_timecode(spark: SparkSession, sf: str) -> DataFrame:
    u, end = src.utterances(spark, sf), F.col("end")
    return u.select("media_id", "seq", tc.format_time(F.col("start")).alias("even_tc"), tc.seconds_to_time_str(F.col("start")).alias("cut_tc"), tc.colon_ms_to_comma_ms(tc.format_time(end)).alias("comma_tc"), F.round(tc.time_str_to_seconds(tc.seconds_to_time_str(end)), 3).alias("back"), tc.is_integer_ms(F.col("start")).alias("whole_ms"))


@query(f"SELECT doc_id AS media_id, g - 1 AS seq, {NORM.format('l')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents)")
def sc6_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return src.lines(spark, sf).select("media_id", F.col("seq").cast("long").alias("seq"), tx.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id AS media_id, g - 1 AS seq, {REPEAT_NORM.format('l')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents)")
def sc5_normalize_for_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return src.lines(spark, sf).select("media_id", F.col("seq").cast("long").alias("seq"), tx.normalize_for_repeat(F.col("text")).alias("norm"))


@query(r"""SELECT page_id, split_part(CASE WHEN instr(f, '.') > 1 THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END, '_', 1) AS base,
CASE WHEN trim(f) <> '' AND NOT starts_with(trim(f), '.') AND NOT regexp_matches(f, '[/\\:*?"<>|]') THEN trim(f) END AS name FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages)""")
def sc18_f7_names(spark: SparkSession, sf: str) -> DataFrame:
    p = src.table(spark, sf, "pages")
    return p.select("page_id", tx.voice_base_name(F.col("url")).alias("base"), tx.valid_name(F.regexp_extract("url", r"([^/]*)$", 1)).alias("name"))


@query(f"""WITH n AS (SELECT doc_id AS media_id, g - 1 AS seq, l, {NORM.format('l')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents))
SELECT media_id, seq, length(norm) >= 2 AND regexp_matches(norm, '[぀-ヿ一-鿿a-zA-Z0-9]') AND NOT (len(string_split(norm, ' ')) >= 2 AND len(list_distinct(string_split(norm, ' '))) = 1) AS meaningful FROM n""")
def f3_meaningful(spark: SparkSession, sf: str) -> DataFrame:
    return src.lines(spark, sf).select("media_id", F.col("seq").cast("long").alias("seq"), tx.is_meaningful(F.col("text")).alias("meaningful"))


PLAIN_TEXT = "trim(translate(text, '()[]（）［］' || chr(10), '         '))"


@query(f"""WITH {UTT}, p AS (SELECT media_id, seq, speaker, {PLAIN_TEXT} AS t FROM utt)
SELECT media_id, seq, [speaker, '（a）b'] AS speakers, ['music', '効果音'] AS non_speech_labels, t AS body, {NORM.format("'   ' || t || '   '")} AS key,
['x' || speaker, speaker] AS square_speakers, ['拍手', 'BGM'] AS square_sounds, [speaker, '／a'] AS plain_speakers, t || '[note](n)' AS square_body FROM p""")
def sc7_9_labels(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.trim(F.translate("text", "()[]（）［］\n", " " * 9))
    said = src.utterances(spark, sf).withColumn("text", plain)
    round_ = F.concat(F.lit("（"), "speaker", F.lit("） "), "text", F.lit(" [music] （（a）b）\n（効果音）"))
    square = F.concat(F.lit("[x"), "speaker", F.lit("]（"), "speaker", F.lit("] "), "text", F.lit("[note](n) [拍手) （[BGM]）"))
    noted = F.concat(F.lit("（"), "speaker", F.lit("（VTR）／x・y）（／a） "), "text")
    key = F.concat(F.lit("（"), "speaker", F.lit("）[a]"), "text", F.lit("[music](a(b)c)"))
    mode = tx.split_labels(square, tx.LabelRules(square_is_speaker=True)).alias("s")
    rows = said.select("media_id", "seq", tx.split_labels(round_).alias("l"), tx.match_key(key).alias("key"), mode, tx.split_labels(noted, tx.LabelRules(strip_suffix=True)).alias("n"))
    return rows.select("media_id", "seq", "l.*", "key", F.col("s.speakers").alias("square_speakers"), F.col("s.non_speech_labels").alias("square_sounds"), F.col("s.body").alias("square_body"), F.col("n.speakers").alias("plain_speakers"))


# ---- sources


@query(f"""WITH {UTT}, c AS (SELECT media_id, seq, CASE WHEN seq % 3 <> 1 THEN start END AS s, CASE WHEN seq % 4 <> 2 THEN "end" END AS e, text FROM utt),
p AS (SELECT *, coalesce(s, last_value(coalesce(e, s) IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM c)
SELECT media_id, seq, start, coalesce(e, start) AS "end", text FROM p""")
def src9_repair_asr_chunks(spark: SparkSession, sf: str) -> DataFrame:
    u = src.utterances(spark, sf)
    holes = u.select("media_id", "seq", F.when(F.col("seq") % 3 != 1, F.col("start")).alias("start"), F.when(F.col("seq") % 4 != 2, F.col("end")).alias("end"), "text")
    return files.repair_asr_chunks(holes)


@query(r"""WITH l AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents),
k AS (SELECT media_id, g, trim(raw) AS line FROM l WHERE trim(raw) <> ''),
t AS (SELECT *, starts_with(line, '#') AS h, regexp_matches(line, '^\s*[（(](.+)[)）]\s*$') AS a, regexp_matches(line, '^\s*([^\s:：（(][^:：]{0,30}?)\s*[:：]\s*(.+)$') AS n FROM k)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY g)::INTEGER AS id, '' AS scene_id, CASE WHEN h OR a THEN 'scene' ELSE 'dialogue' END AS type,
CASE WHEN NOT h AND NOT a AND n THEN trim(regexp_extract(line, '^\s*([^\s:：（(][^:：]{0,30}?)\s*[:：]\s*(.+)$', 1)) ELSE '' END AS speaker,
CASE WHEN h THEN trim(regexp_replace(line, '^#+', '')) WHEN a THEN trim(regexp_extract(line, '^\s*[（(](.+)[)）]\s*$', 1)) WHEN n THEN trim(regexp_extract(line, '^\s*([^\s:：（(][^:：]{0,30}?)\s*[:：]\s*(.+)$', 2)) ELSE line END AS contents FROM t""")
def src5_script_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return files.script_from_text(src.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "text"))


def _srt_texts(spark: SparkSession, sf: str, mark: tuple[str, str]) -> DataFrame:
    """The utterances of each conversation as one subtitle text."""
    u = src.utterances(spark, sf)
    block = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), tc.seconds_to_time_str(F.col("start")), F.lit(" --> "), tc.seconds_to_time_str(F.col("end")), F.lit("\n" + mark[0]), "speaker", F.lit(mark[1]), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n"))
    return u.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))


@query(f"""WITH {UTT}, p AS (SELECT media_id, seq, {cut_sql('start')} AS start_tc, {cut_sql('"end"')} AS end_tc, ltrim(replace(text, chr(10), ' ')) AS text, speaker AS stt_speaker, {NORM.format('text')} AS norm FROM utt)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1)::INTEGER AS id, start_tc, end_tc, rtrim(text) AS text, stt_speaker FROM p
WHERE end_tc > start_tc AND length(norm) >= 2 AND regexp_matches(norm, '[a-zA-Z0-9]') AND NOT (len(string_split(norm, ' ')) >= 2 AND len(list_distinct(string_split(norm, ' '))) = 1)""")
def src3_parse_stt_srt(spark: SparkSession, sf: str) -> DataFrame:
    return files.parse_stt_srt(_srt_texts(spark, sf, ("[", "] "))).select("media_id", "id", "start_tc", "end_tc", F.rtrim("text").alias("text"), "stt_speaker")


@query(f"""WITH {UTT}, p AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq)::INTEGER AS index FROM utt)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY floor(start) + floor((start * 1000) % 1000) / 1000, index)::INTEGER AS entry_no, index, round(floor(start) + floor((start * 1000) % 1000) / 1000, 3) AS start, [speaker] AS speakers, trim(replace(text, chr(10), ' ')) AS body FROM p""")
def src2_parse_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    e = files.parse_subtitles(_srt_texts(spark, sf, ("（", "）")))
    return e.select("media_id", "entry_no", "index", F.round("start", 3).alias("start"), "speakers", "body")


@query(f"""WITH {EVT} SELECT media_id, track_seq, cluster_id, round(start, 3) AS start, round("end", 3) AS "end" FROM turns""")
def src6_parse_rttm(spark: SparkSession, sf: str) -> DataFrame:
    t = src.turns(spark, sf)
    line = F.format_string("SPEAKER x 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("start"), F.col("end") - F.col("start"), F.col("cluster_id"))
    junk = t.select("media_id", F.col("track_seq").alias("line_no"), F.lit("SPEAKER x 1 zero").alias("line"))
    got = files.parse_rttm(t.select("media_id", F.col("track_seq").alias("line_no"), line.alias("line")).unionByName(junk))
    return got.select("media_id", "track_seq", "cluster_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("""WITH l AS (SELECT conv_id AS media_id, turn AS line, CASE WHEN turn % 4 = 3 THEN 'scene' ELSE 'dialogue' END AS type, role, text FROM conversations)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY line) - 1)::INTEGER AS id, role AS speaker, text AS dialogue FROM l WHERE type = 'dialogue'""")
def src4_script_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    c = src.table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("line"), F.when(F.col("turn") % 4 == 3, "scene").otherwise("dialogue").alias("type"), F.col("role").alias("speaker"), F.concat("text", F.lit(files.ANNOTATION)).alias("contents"))
    return files.script_dialogue(rows)


# ---- transcripts


def _phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Stock phrases, and every line of the benchmark passages."""
    return files.load_phrases(spark, src.table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")))


STOCK = ", ".join(f"('{p}')" for p in files.STOCK_PHRASES)
REASONS = f"""n AS (SELECT *, {REPEAT_NORM.format('text')} AS norm FROM l),
u AS (SELECT *, CASE WHEN trim(text) = '' THEN 'blank' WHEN norm = '' THEN NULL WHEN norm IN (SELECT norm FROM ph) THEN 'phrase'
  WHEN list_bool_or([length(norm) // k >= 3 AND length(norm) % k = 0 AND repeat(norm[1:k], length(norm) // k) = norm FOR k IN [1, 2, 3, 4]]) THEN 'repeat' END AS r FROM n),
d AS (SELECT *, lag(norm) OVER (PARTITION BY media_id, r IS NULL AND norm <> '' ORDER BY seq) AS before FROM u),
rs AS (SELECT * EXCLUDE (norm, r, before), CASE WHEN r IS NULL AND norm <> '' AND norm = before THEN 'duplicate' ELSE r END AS reason FROM d)"""


@query(f"""WITH pl AS (SELECT trim(unnest(string_split(text, chr(10)))) AS p FROM benchmark UNION ALL VALUES {STOCK}),
ph AS (SELECT DISTINCT {REPEAT_NORM.format("p")} AS norm FROM pl WHERE p <> '' AND NOT starts_with(p, '#')),
l AS (SELECT doc_id AS media_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), {REASONS} FROM rs""")
def f6_w3_hallucinations(spark: SparkSession, sf: str) -> DataFrame:
    marked = cleaning.mark_hallucinations(src.lines(spark, sf), _phrases(spark, sf))
    return marked.select("media_id", F.col("seq").cast("long").alias("seq"), "text", "reason")


@query(f"""WITH {EVT} SELECT media_id, cluster_id, r[2] AS rep_start, r[3] AS rep_end FROM (SELECT media_id, cluster_id, arg_max([round("end" - start, 6), start, "end"], (round("end" - start, 6), -start)) AS r FROM turns GROUP BY ALL)""")
def g3_representative(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.representative_segment(src.turns(spark, sf))


DOMINANT = """met AS (SELECT s.media_id, s.seq, t.cluster_id, sum(round((least(s."end", t."end") - greatest(s.start, t.start)) * 1000000)::BIGINT) AS us, min(t.track_seq) AS first
  FROM segs s JOIN turns t ON s.media_id = t.media_id AND round(least(s."end", t."end") - greatest(s.start, t.start), 6) > 0 GROUP BY ALL),
dom AS (SELECT media_id, seq, arg_max(cluster_id, (us, -first)) AS cluster_id, max(us)::DOUBLE / 1000000 AS overlap FROM met GROUP BY ALL)"""


@query(f"""WITH {EVT}, {DOMINANT} SELECT s.media_id, s.seq, s.start, s."end", s.text, cluster_id, overlap FROM segs s LEFT JOIN dom USING (media_id, seq)""")
def j1_dominant_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return speakers.dominant_cluster(src.segments(spark, sf), src.turns(spark, sf))


@query(f"""WITH {EVT}, {DOMINANT} SELECT s.media_id, s.seq, {even_sql('s.start')} AS start, {even_sql('s."end"')} AS "end", s.text,
CASE WHEN dom.cluster_id IS NULL THEN 'Unknown' ELSE 'Unknown_' || printf('%02d', r.n) END AS speaker, '' AS cosine_distance
FROM segs s LEFT JOIN dom USING (media_id, seq) LEFT JOIN (SELECT media_id, cluster_id, row_number() OVER (PARTITION BY media_id ORDER BY cluster_id) AS n FROM (SELECT DISTINCT media_id, cluster_id FROM turns)) r ON r.media_id = s.media_id AND r.cluster_id = dom.cluster_id""")
def j2_resolved_transcript(spark: SparkSession, sf: str) -> DataFrame:
    turns = src.turns(spark, sf)
    named = speakers.label_all_unknown(turns.select("media_id", "cluster_id").distinct()).withColumn("distance", F.lit(None).cast("double"))
    rows = speakers.resolve_speaker(speakers.dominant_cluster(src.segments(spark, sf), turns), named)
    return sinks.transcript_rows(rows)


def _cluster_voices(spark: SparkSession, sf: str) -> DataFrame:
    """A voice for most clusters of the turns: every recording's cluster takes a vector that isn't registered, some find none."""
    named = src.turns(spark, sf).select("media_id", "cluster_id").distinct()
    vectors = src.voiceprints(spark, sf)[1].select(F.substring("cluster_id", 2, 9).cast("long").alias("vec_id"), "embedding")
    size = F.broadcast(src.table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("_size")))  # one row
    number = (F.unix_date(F.to_date("media_id")) * 5 + F.substring("cluster_id", 2, 9).cast("int")) % F.col("_size")
    return named.join(size).withColumn("vec_id", number.cast("long")).join(vectors, "vec_id").drop("vec_id", "_size")


@query(f"""WITH {EVT}, {VOICE.replace("clu AS (SELECT vec_id % 20 AS media_id, printf('c%08d', vec_id) AS cluster_id, embedding FROM embeddings ANTI JOIN first USING (label, vec_id))",
"clu AS (SELECT DISTINCT t.media_id, t.cluster_id, e.embedding FROM turns t JOIN (FROM embeddings ANTI JOIN first USING (label, vec_id)) e ON e.vec_id = ((t.media_id::DATE - DATE '1970-01-01') * 5 + t.cluster_id[2:]::INT) % (SELECT max(vec_id) + 1 FROM embeddings))").replace("ORDER BY cluster_id)) END AS speaker", "ORDER BY cluster_id) + CASE WHEN distance <= 0.8 THEN 0 ELSE (SELECT count(*) FROM novoice v WHERE v.media_id = best.media_id) END) END AS speaker").replace("named AS (", "novoice AS (SELECT DISTINCT media_id, cluster_id FROM turns ANTI JOIN clu USING (media_id, cluster_id)), named AS (")},
who AS (SELECT media_id, cluster_id, speaker, distance FROM named UNION ALL SELECT media_id, cluster_id, 'Unknown_' || printf('%02d', row_number() OVER (PARTITION BY media_id ORDER BY cluster_id)), NULL FROM novoice),
ph AS (SELECT {REPEAT_NORM.format("p")} AS norm FROM (VALUES {STOCK}) t(p)), l AS (FROM segs), {REASONS}, {DOMINANT}
SELECT s.media_id, s.seq, {even_sql('s.start')} AS start, {even_sql('s."end"')} AS "end", s.text, CASE WHEN dom.cluster_id IS NULL THEN 'Unknown' ELSE speaker END AS speaker, coalesce(printf('%.6f', distance), '') AS cosine_distance
FROM rs s LEFT JOIN dom USING (media_id, seq) LEFT JOIN who ON who.media_id = s.media_id AND who.cluster_id = dom.cluster_id WHERE reason IS NULL""")
def job1_build_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    registry, _ = src.voiceprints(spark, sf)
    return jobs.build_transcripts(src.segments(spark, sf), src.turns(spark, sf), _cluster_voices(spark, sf), registry, files.load_phrases(spark), 0.8, 1)["transcript"]


@query(f"WITH {VOICE} SELECT media_id, cluster_id, speaker, round(distance, 6) AS distance FROM named")
def j4_w4_identify(spark: SparkSession, sf: str) -> DataFrame:
    registry, clusters = src.voiceprints(spark, sf)
    return speakers.identify(clusters, registry, 0.8, 1).select("media_id", "cluster_id", "speaker", F.round("distance", 6).alias("distance"))


@query("""WITH r AS (SELECT 's' || (vec_id // 6)::VARCHAR AS speaker, vec_id AS reg_order, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
q AS (SELECT vec_id % 20 AS media_id, 'c' || vec_id::VARCHAR AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
d AS (SELECT media_id, cluster_id, speaker, min((round(1 - list_cosine_similarity(q.v, r.v), 9), reg_order)) AS d FROM q, r GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id, cluster_id ORDER BY d) AS rank FROM d)
SELECT media_id, cluster_id, rank, speaker, round(d[1], 6) AS distance FROM n WHERE rank <= 3""")
def j4_nearest_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every second vector is a registered voice, three to a name, and the others are clusters; blocks of 64 voices, so that some can be skipped."""
    e = src.table(spark, sf, "embeddings")
    registry = e.where("vec_id % 2 = 0").select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 6)).alias("speaker"), F.col("vec_id").alias("reg_order"), "embedding")
    clusters = e.where("vec_id % 2 = 1").select((F.col("vec_id") % 20).alias("media_id"), F.concat(F.lit("c"), "vec_id").alias("cluster_id"), "embedding")
    near = voices.nearest_voices(clusters, registry, 3, tile_bytes=1 << 15, places=9)
    each = near.select("media_id", "cluster_id", F.posexplode("candidates").alias("rank", "c"))
    return each.select("media_id", "cluster_id", (F.col("rank") + 1).cast("long").alias("rank"), "c.speaker", F.round("c.distance", 6).alias("distance"))


@query(f"WITH {VOICE} SELECT media_id, cluster_id, speaker, round(d, 6) AS d FROM dist")
def sc12_cosine_distances(spark: SparkSession, sf: str) -> DataFrame:
    registry, clusters = src.voiceprints(spark, sf)
    each = speakers.distances(clusters, registry).select("media_id", "cluster_id", F.explode("candidates").alias("c"))
    return each.select("media_id", "cluster_id", "c.speaker", F.round("c.distance", 6).alias("d"))


@query(f"""WITH {UTT}, m AS (SELECT DISTINCT media_id, speaker, 'Speaker ' || speaker AS new FROM utt WHERE media_id % 2 = 0 AND speaker = 'user')
SELECT media_id, seq, coalesce(new, speaker) AS speaker, CASE WHEN new IS NULL THEN 0.25::DOUBLE END AS distance, new IS NOT NULL AS replaced FROM utt LEFT JOIN m USING (media_id, speaker)""")
def j3_relabel(spark: SparkSession, sf: str) -> DataFrame:
    u = src.utterances(spark, sf).select("media_id", "seq", "speaker", F.lit(0.25).alias("distance"))
    mapping = u.where("media_id % 2 = 0 and speaker = 'user'").select("media_id", F.col("speaker").alias("old"), F.concat(F.lit("Speaker "), "speaker").alias("speaker"), F.lit(None).cast("double").alias("distance")).distinct()
    return speakers.relabel(u, mapping)


#: After labels ``l`` (media_id, cluster_id, name): the new voices, the last of each name, and the nearest voice of every unknown among old and new.
REMATCH = """nv AS (SELECT name, arg_max(v, (media_id, cluster_id)) AS v FROM l JOIN unit USING (media_id, cluster_id) GROUP BY name),
nd AS (SELECT u.media_id, u.cluster_id, n.name, 1 - list_cosine_similarity(u.v, n.v) AS d FROM named k JOIN unit u USING (media_id, cluster_id), nv n WHERE k.speaker LIKE 'Unknown%'),
nb AS (SELECT media_id, cluster_id, arg_min(name, (round(d, 9), name)) AS name, min(d) AS d FROM nd GROUP BY ALL),
rm AS (SELECT n.media_id, n.cluster_id, n.speaker AS old, l.name, CASE WHEN round(nb.d, 9) < round(b.distance, 9) THEN nb.name ELSE b.near END AS near, CASE WHEN n.speaker LIKE 'Unknown%' THEN least(b.distance, nb.d) ELSE n.distance END AS distance
  FROM named n JOIN best b USING (media_id, cluster_id) LEFT JOIN nb ON nb.media_id = n.media_id AND nb.cluster_id = n.cluster_id LEFT JOIN l ON l.media_id = n.media_id AND l.cluster_id = n.cluster_id),
rh AS (SELECT *, CASE WHEN name IS NOT NULL THEN 'manual' WHEN old LIKE 'Unknown%' AND distance <= 0.9 THEN 'auto' END AS how FROM rm)"""


@query(f"""WITH {VOICE}, l AS (SELECT media_id, min(cluster_id) AS cluster_id, 'Named ' || media_id::VARCHAR AS name FROM named WHERE speaker LIKE 'Unknown%' GROUP BY media_id), {REMATCH}
SELECT media_id, cluster_id, old, coalesce(name, CASE WHEN how = 'auto' THEN near END, old) AS speaker, CASE WHEN name IS NULL THEN round(distance, 6) END AS distance, how FROM rh""")
def j15_rematch_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    registry, clusters = src.voiceprints(spark, sf)
    named = speakers.identify(clusters, registry, 0.8).join(clusters, ["media_id", "cluster_id"])
    labelled = named.where(tx.is_unknown(F.col("speaker"))).groupBy("media_id").agg(F.min("cluster_id").alias("cluster_id")).withColumn("name", F.concat(F.lit("Named "), F.col("media_id").cast("string")))
    return speakers.rematch_unknowns(named, registry, labelled, 0.9).withColumn("distance", F.round("distance", 6))


@query("""WITH f AS (SELECT 'n' AS namespace, doc_id::VARCHAR AS path, sha256(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM f WHERE path::BIGINT % 3 = 0)
SELECT path, h AS content_sha256, 'hit' AS outcome FROM f WHERE h IN (FROM c) UNION ALL SELECT min(path), h, 'miss' FROM f WHERE h NOT IN (FROM c) GROUP BY h""")
def j16_missing_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    f = src.table(spark, sf, "documents").select(F.lit("n").alias("namespace"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    cache = f.where(F.col("path").cast("long") % 3 == 0).select("namespace", F.sha2("content", 256).alias("content_sha256"), F.lit(1.0).alias("embedding")).distinct()
    hits, misses = speakers.missing_embeddings(f, cache)
    return hits.select("path", "content_sha256", F.lit("hit").alias("outcome")).unionByName(misses.select("path", "content_sha256", F.lit("miss").alias("outcome")))


@query("""WITH r AS (SELECT 'db' || (label % 3)::VARCHAR AS db, printf('speaker_%05d', label) AS speaker, vec_id, label FROM embeddings)
SELECT db, speaker, max(vec_id) AS version FROM r GROUP BY ALL""")
def j17_upsert_voiceprints(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "embeddings").select(F.concat(F.lit("db"), (F.col("label") % 3).cast("string")).alias("db"), F.format_string("speaker_%05d", "label").alias("speaker"), F.col("vec_id").alias("version"))
    old = e.groupBy("db", "speaker").agg(F.min("version").alias("version"))
    bad = e.select("db", F.lit(".hidden").alias("speaker"), "version", F.col("version").alias("seq"))
    return speakers.upsert_voiceprints(old, e.withColumn("seq", F.col("version")).unionByName(bad))


@query("""WITH r AS (SELECT DISTINCT 'db' || (label % 3)::VARCHAR AS db, printf('speaker_%05d', label) AS speaker FROM embeddings)
SELECT db, CASE WHEN db = 'db1' AND speaker = 'speaker_00001' THEN 'Chair' ELSE speaker END AS speaker FROM r""")
def j17_rename_speaker(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "embeddings").select(F.concat(F.lit("db"), (F.col("label") % 3).cast("string")).alias("db"), F.format_string("speaker_%05d", "label").alias("speaker")).distinct()
    return speakers.rename_speaker(e, "db1", "speaker_00001", "Chair")


@query("""WITH f AS (SELECT page_id, 'db' || (page_id % 3)::VARCHAR AS db, CASE WHEN page_id % 50 = 7 THEN '' ELSE 'v' || (page_id // 2)::VARCHAR END AS speaker FROM pages WHERE page_id % 4 <> 3)
SELECT page_id AS size, db, speaker, CASE WHEN speaker = '' THEN 'no name' WHEN count(*) OVER (PARTITION BY db, speaker) > 1 THEN 'duplicate' END AS problem FROM f""")
def src7_scan_voice_files(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("page_id")
    ending = F.when(n % 4 == 3, ".txt").when(n % 4 == 1, ".WAV").otherwise(".flac")
    name = F.when(n % 50 == 7, "").otherwise(F.concat(F.lit("v"), F.floor(n / 2).cast("string")))
    listed = src.table(spark, sf, "pages").select(F.concat(F.lit("file:/voices/db"), (n % 3).cast("string"), F.lit("/"), name, ending).alias("path"), n.alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return files.scan_voice_files(listed).select("size", "db", "speaker", "problem")


@query("SELECT 'db' || (label % 3)::VARCHAR AS db, count(DISTINCT label) AS speakers FROM embeddings GROUP BY ALL")
def g15_database_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "embeddings").select(F.concat(F.lit("db"), (F.col("label") % 3).cast("string")).alias("db"), F.col("label").alias("speaker")).distinct()
    return speakers.database_summary(e)


@query("SELECT event_id, CASE WHEN value / 50 >= 1.5 THEN 0.5::DOUBLE END AS crop_start, CASE WHEN value / 50 >= 1.5 THEN value / 50 - 0.5 END AS crop_end FROM events")
def f8_registration_crop(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select("event_id", (F.col("value") / 50).alias("duration"))
    return speakers.registration_crop(e).select("event_id", "crop_start", "crop_end")


# ---- figures


@query(f"""WITH {EVT}, e AS (SELECT media_id, round(start * 1000000)::BIGINT AS t, 1 AS d FROM turns WHERE "end" > start UNION ALL SELECT media_id, round("end" * 1000000)::BIGINT, -1 FROM turns WHERE "end" > start),
n AS (SELECT media_id, t, sum(d) AS d FROM e GROUP BY ALL), h AS (SELECT media_id, sum(d) OVER o AS depth, lead(t) OVER o - t AS span FROM n WINDOW o AS (PARTITION BY media_id ORDER BY t))
SELECT media_id, round(sum(CASE WHEN depth >= 2 THEN span ELSE 0 END) / sum(CASE WHEN depth >= 1 THEN span ELSE 0 END), 9) AS overlap_time_ratio FROM h GROUP BY media_id""")
def g4_overlap_time_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return stats.overlap_time_ratio(src.turns(spark, sf)).withColumn("overlap_time_ratio", F.round("overlap_time_ratio", 9))


SPEECH = "(len(speakers) > 0 OR trim(body) <> '')"


@query(f"""WITH {ENT}, x AS (SELECT media_id, entry_no, unnest(speakers) AS speaker, generate_subscripts(speakers, 1) AS p FROM ent WHERE {SPEECH}),
c AS (SELECT media_id, speaker, count(*) AS n, min((entry_no, p)) AS f FROM x GROUP BY ALL)
SELECT media_id, string_agg(speaker || ':' || n::VARCHAR, ' ' ORDER BY n DESC, f) AS utterances FROM c GROUP BY media_id""")
def g2_sc16_utterance_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.utterance_counts(src.entries(spark, sf), ["media_id"]).select("media_id", tx.speaker_utterances(F.col("utterance_counts")).alias("utterances"))


VARS = f"""sp AS (SELECT * FROM ent WHERE {SPEECH}),
nm AS (SELECT media_id, speakers[1] AS who, lag(speakers[1]) OVER (PARTITION BY media_id ORDER BY entry_no) AS prev FROM sp WHERE coalesce(speakers[1], '') <> ''),
ch AS (SELECT media_id, coalesce(sum((who <> prev)::BIGINT), 0)::BIGINT AS changes FROM nm GROUP BY ALL),
vs AS (SELECT media_id, count(*) AS utterance_count, sum((len(speakers) >= 2)::BIGINT)::BIGINT AS overlap_entry_count, sum(greatest(0, "end" - start)) AS secs, max("end") AS duration, len(list_distinct(flatten(list(speakers))))::BIGINT AS speaker_count FROM sp GROUP BY ALL)"""


@query(f"""WITH {ENT}, {VARS} SELECT media_id, round(duration, 3) AS duration, utterance_count, speaker_count, changes AS speaker_change_count, round(changes / (duration / 60), 6) AS speaker_change_per_min, overlap_entry_count,
round(overlap_entry_count / utterance_count, 6) AS overlap_entry_ratio, round(secs / duration, 6) AS speech_time_ratio FROM vs JOIN ch USING (media_id)""")
def g1_w1_clip_variables(spark: SparkSession, sf: str) -> DataFrame:
    e = src.entries(spark, sf)
    d = e.where(stats.is_speech()).groupBy("media_id").agg(F.max("end").alias("duration"))
    v = stats.clip_variables(e, ["media_id"], d).drop("utterance_counts").withColumn("duration", F.round("duration", 3))
    return v.withColumns({c: F.round(c, 6) for c in ("speaker_change_per_min", "overlap_entry_ratio", "speech_time_ratio")})


@query(f"""WITH {ENT} SELECT media_id, entry_no FROM ent WHERE {SPEECH}""")
def f2_speech(spark: SparkSession, sf: str) -> DataFrame:
    return src.entries(spark, sf).where(stats.is_speech()).select("media_id", F.col("entry_no").cast("long").alias("entry_no"))


@query(f"""WITH {EVT}, t AS (SELECT media_id, unnest([start + 0.0001 * (seq % 3), "end"]) AS t FROM segs) SELECT media_id, sum((abs(t * 1000 - round_even(t * 1000, 0)) <= 1e-6)::BIGINT)::BIGINT AS whole_ms, count(*) AS total FROM t GROUP BY ALL""")
def g12_ms_precision_audit(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ms_precision_audit(src.segments(spark, sf).withColumn("start", F.col("start") + 0.0001 * (F.col("seq") % 3)))


@query(f"""WITH {EVT}, t AS (SELECT media_id, seq, unnest(['start', 'end']) AS edge, unnest([start + 0.0001 * (seq % 3), "end"]) AS t FROM segs) SELECT media_id, seq, edge, round(t, 6) AS t FROM t WHERE abs(t * 1000 - round_even(t * 1000, 0)) > 1e-6""")
def g12_ms_precision_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.segments(spark, sf).withColumn("start", F.col("start") + 0.0001 * (F.col("seq") % 3))
    return stats.ms_precision_violations(rows).withColumn("t", F.round("t", 6))


@query("""WITH a AS (SELECT doc_id % 20 AS media_id, unnest(string_split(text, chr(10))) AS l FROM documents), b AS (SELECT media_id, count(*) AS lines FROM a WHERE trim(l) <> '' GROUP BY ALL),
c AS (SELECT user_id % 20 AS media_id, count(*) AS utterances FROM events WHERE NOT (event_id % 11 = 0 AND event_id % 7 <> 0 AND trim(props) = '') GROUP BY ALL)
SELECT media_id, coalesce(lines, 0) AS lines, coalesce(utterances, 0) AS utterances, coalesce(lines, 0) = coalesce(utterances, 0) AS same FROM b FULL JOIN c USING (media_id)""")
def g13_utterance_count_check(spark: SparkSession, sf: str) -> DataFrame:
    l = src.lines(spark, sf).select((F.col("media_id") % 20).alias("media_id"), F.col("text").alias("line"))
    return stats.utterance_count_check(l, src.entries(spark, sf))


@query(f"""WITH {ENT}, s AS (SELECT media_id, list_sort(list_distinct(flatten(list(speakers)))) AS speakers FROM ent GROUP BY ALL) SELECT media_id, speakers, ['bell'] AS sounds, len(speakers)::BIGINT AS speaker_labels, 1::BIGINT AS sound_labels FROM s""")
def g14_label_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return stats.label_inventory(src.entries(spark, sf).withColumn("non_speech_labels", F.array(F.lit("bell"))))


# ---- clips


OPTIONS = clips.ClipOptions(length=60.0, tolerance=5.0, target_speakers=4)
WIN = f"""sp AS (SELECT * FROM ent WHERE {SPEECH}), bo AS (SELECT DISTINCT media_id, "end" AS e FROM sp),
nx AS (SELECT s.media_id, s.entry_no, s.start, min(e) AS "end" FROM sp s JOIN bo b ON b.media_id = s.media_id AND e >= s.start + 60 - 1e-6 AND e <= s.start + 70 GROUP BY ALL),
win AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start, entry_no)::INTEGER AS window_no, start, "end" FROM nx WHERE abs("end" - start - 60) <= 5),
mem AS (SELECT w.media_id, w.window_no, w.start AS w_start, w."end" AS w_end, e.entry_no, e.start, e."end", e.speakers, e.body FROM win w JOIN ent e ON e.media_id = w.media_id AND e.start >= w.start - 1e-6 AND e."end" <= w."end" + 1e-6)"""
WVAR = f"""wsp AS (SELECT * FROM mem WHERE {SPEECH}),
wnm AS (SELECT media_id, window_no, speakers[1] AS who, lag(speakers[1]) OVER (PARTITION BY media_id, window_no ORDER BY entry_no) AS prev FROM wsp WHERE coalesce(speakers[1], '') <> ''),
wch AS (SELECT media_id, window_no, coalesce(sum((who <> prev)::BIGINT), 0)::BIGINT AS changes FROM wnm GROUP BY ALL),
wvs AS (SELECT media_id, window_no, count(*) AS n, sum((len(speakers) >= 2)::BIGINT)::BIGINT AS two, len(list_distinct(flatten(list(speakers))))::BIGINT AS speaker_count FROM wsp GROUP BY ALL),
wv AS (SELECT w.*, n, two, speaker_count, changes / (("end" - start) / 60) AS cpm, two / n AS ratio FROM win w JOIN wvs USING (media_id, window_no) JOIN wch USING (media_id, window_no)),
sc AS (SELECT *, coalesce((cpm - avg(cpm) OVER m) / nullif(stddev_pop(cpm) OVER m, 0), 0) + coalesce((ratio - avg(ratio) OVER m) / nullif(stddev_pop(ratio) OVER m, 0), 0) - abs(speaker_count - 4) * 0.5 AS score FROM wv WINDOW m AS (PARTITION BY media_id))"""


@query(f'WITH {ENT}, {WIN} SELECT media_id, window_no, start, "end" FROM win')
def j7_windows(spark: SparkSession, sf: str) -> DataFrame:
    return clips.enumerate_windows(src.entries(spark, sf), OPTIONS)


@query(f"WITH {ENT}, {WIN} SELECT media_id, window_no, entry_no FROM mem")
def j8_window_members(spark: SparkSession, sf: str) -> DataFrame:
    e = src.entries(spark, sf)
    return clips.window_members(clips.enumerate_windows(e, OPTIONS), e).select("media_id", "window_no", F.col("entry_no").cast("long").alias("entry_no"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    e = src.entries(spark, sf)
    return clips.score_windows(clips.window_variables(clips.enumerate_windows(e, OPTIONS), e, OPTIONS).cache(), OPTIONS)


@query(f"WITH {ENT}, {WIN}, {WVAR} SELECT media_id, window_no, speaker_count, round(cpm, 6) AS cpm, round(ratio, 6) AS ratio, round(score, 6) AS score FROM sc")
def g10_score_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("media_id", "window_no", "speaker_count", F.round("speaker_change_per_min", 6).alias("cpm"), F.round("overlap_entry_ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query(f"""WITH {ENT}, {WIN}, {WVAR}, pr AS (SELECT a.media_id, a.window_no AS i, b.window_no AS j, a.score AS si, b.score AS sj FROM sc a JOIN sc b ON a.media_id = b.media_id AND a.window_no < b.window_no AND b.start >= a."end" - 1e-6),
bt AS (SELECT media_id, max(round(abs(si - sj), 6)) AS difference FROM pr GROUP BY ALL) SELECT DISTINCT sc.media_id, difference, CASE WHEN difference IS NULL THEN 'no disjoint pair' ELSE 'ok' END AS status FROM sc LEFT JOIN bt USING (media_id)""")
def j9_select_clip_pair(spark: SparkSession, sf: str) -> DataFrame:
    return clips.select_clip_pair(_scored(spark, sf)).select("media_id", F.round("difference", 6).alias("difference"), "status")


@query(f"""WITH {ENT}, {WIN}, {WVAR.replace("wvs AS (SELECT media_id, window_no, count(*) AS n,", 'wvs AS (SELECT media_id, window_no, sum(greatest(0, "end" - start)) AS secs, count(*) AS n,').replace("SELECT w.*, n, two,", "SELECT w.*, n, two, secs, changes,")},
pr AS (SELECT a.media_id, a.window_no AS i, b.window_no AS j, a.score AS si, b.score AS sj FROM sc a JOIN sc b ON a.media_id = b.media_id AND a.window_no < b.window_no AND b.start >= a."end" - 1e-6),
ch AS (SELECT media_id, arg_max((i, j, si, sj), (round(abs(si - sj), 9), -i, -j)) AS p FROM pr GROUP BY media_id),
pk AS (SELECT media_id, 'hard' AS kind, CASE WHEN p[3] >= p[4] THEN p[1] ELSE p[2] END AS window_no FROM ch UNION ALL SELECT media_id, 'calm', CASE WHEN p[3] >= p[4] THEN p[2] ELSE p[1] END FROM ch)
SELECT media_id, media_id::VARCHAR || '_' || kind AS name, kind, window_no, {even_sql('start')} AS start_tc, {even_sql('"end"')} AS end_tc, round(start, 3) AS start, round("end", 3) AS "end", round("end" - start, 6) AS duration, n AS utterance_count, speaker_count,
changes AS speaker_change_count, round(cpm, 6) AS speaker_change_per_min, two AS overlap_entry_count, round(ratio, 6) AS overlap_entry_ratio, round(secs / ("end" - start), 6) AS speech_time_ratio, round(score, 6) AS score FROM pk JOIN sc USING (media_id, window_no)""")
def job5_select_clips(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.select_clips(src.entries(spark, sf), OPTIONS)["report"].withColumns({c: F.round(c, 6) for c in ("duration", "speaker_change_per_min", "overlap_entry_ratio", "speech_time_ratio", "score")})


@query(f"""WITH {ENT}, {WIN}, f AS (SELECT *, row_number() OVER (PARTITION BY media_id, window_no ORDER BY entry_no) AS index FROM mem)
SELECT media_id, window_no::BIGINT AS window_no, index, round(greatest(0, start - w_start), 6) AS start, round(greatest(0, "end" - w_start), 6) AS "end", printf('%.3f', w_start) AS cut FROM f""")
def f9_f10_shift_and_cut(spark: SparkSession, sf: str) -> DataFrame:
    e = src.entries(spark, sf)
    windows = clips.enumerate_windows(e, OPTIONS).cache()
    moved = clips.shift_entries(clips.window_members(windows, e), ["media_id", "window_no"], "w_start")
    cuts = clips.clip_cut_list(windows.withColumn("name", F.format_string("%s %s", "media_id", "window_no"))).select("media_id", F.split("output", "[ .]")[1].cast("int").alias("window_no"), F.col("start").alias("cut"))
    return moved.join(cuts, ["media_id", "window_no"]).select("media_id", F.col("window_no").cast("long").alias("window_no"), F.col("index").cast("long").alias("index"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "cut")


@query(f"WITH {ENT}, {WIN}, {WVAR} SELECT media_id, max(two) = 0 AS no_overlap_signal FROM sc GROUP BY media_id")
def g19_overlap_signal_check(spark: SparkSession, sf: str) -> DataFrame:
    return clips.overlap_signal_check(_scored(spark, sf))


# ---- scripts


GRAMS = """sp0 AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY id) - 1 AS ix FROM {t}),
gr AS (SELECT a.media_id, n, a.ix AS start_index, list(b.id ORDER BY b.ix) AS original_ids, string_agg(b.{c}, ' ' ORDER BY b.ix) AS text, count(*) AS k, {d} AS voices
  FROM sp0 a, range(1, 4) r(n) JOIN sp0 b ON b.media_id = a.media_id AND b.ix >= a.ix AND b.ix < a.ix + n GROUP BY a.media_id, n, a.ix)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY n, start_index) - 1 AS ngram_id, n, start_index, start_index + n - 1 AS end_index, original_ids, text, {norm} AS normalized_text FROM gr WHERE k = n AND voices = 1"""


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query(f"WITH {STT}, " + GRAMS.format(t="script", c="dialogue", d="count(DISTINCT b.speaker)", norm=NORM.format("text")))
def w5_script_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    g = matching.ngrams(src.script_lines(spark, sf), "dialogue", by_speaker=True).drop("speaker")
    return _longs(g, "ngram_id", "n", "start_index", "end_index").withColumn("original_ids", F.col("original_ids").cast("array<long>"))


@query(f"WITH {STT}, " + GRAMS.format(t="stt", c="text", d="1", norm=NORM.format("text")))
def w5_stt_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    g = matching.ngrams(src.stt_lines(spark, sf), "text", timed=True).drop("start_time", "end_time")
    return _longs(g, "ngram_id", "n", "start_index", "end_index").withColumn("original_ids", F.col("original_ids").cast("array<long>"))


@query("""WITH v AS (SELECT vec_id % 20 AS media_id, vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS v FROM embeddings),
s AS (SELECT q.media_id, q.vec_id AS q, x.vec_id AS x, round(list_inner_product(q.v, x.v), 6) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, x.v), 6) DESC, x.vec_id) - 1 AS rank FROM v q JOIN v x USING (media_id) WHERE q.vec_id % 3 = 0 AND x.vec_id % 3 <> 0)
SELECT media_id, q AS script_ngram_id, rank::INTEGER AS rank, s AS similarity FROM s WHERE rank < 10""")
def j5_t3_knn(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("media_id"), F.col("vec_id").alias("ngram_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("vec"))
    near = matching.knn_join(e.where("ngram_id % 3 = 0"), e.where("ngram_id % 3 <> 0"))
    return near.select("media_id", "script_ngram_id", "rank", F.round("similarity", 6).alias("similarity"))


def _grams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return matching.ngrams(src.script_lines(spark, sf), "dialogue", by_speaker=True), matching.ngrams(src.stt_lines(spark, sf), "text", timed=True)


@query()
def ud1_j6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _grams(spark, sf)
    near = matching.knn_join(*[matching.encode_texts(g).select("media_id", "ngram_id", "vec") for g in (a, b)])
    return matching.candidate_pairs(near, a, b)


@query()
def w9_weighted_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chains.weighted_chain(ud1_j6_candidates(spark, sf))


def _fixed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as script with the turn before, itself and the next as recognised, in quarters of weight."""
    u = src.utterances(spark, sf)
    s, t = F.col("s"), F.col("t")
    asks = u.select("media_id", F.col("seq").alias("s"), F.explode(F.array(*[F.col("seq") + d for d in (-1, 0, 1)])).alias("t"))
    met = asks.join(u.select("media_id", F.col("seq").alias("t"), F.col("start").alias("start_time"), F.col("end").alias("end_time")), ["media_id", "t"])
    weight = (((s * 7 + t * 3) % 5) - 1) / 4.0
    return met.select("media_id", s.alias("script_ngram_id"), t.alias("stt_ngram_id"), (t - s + 1).alias("rank"), weight.alias("similarity"), s.alias("script_start"), (s + s % 2).alias("script_end"), t.alias("stt_start"), t.alias("stt_end"), "start_time", "end_time", weight.alias("weighted_similarity"))


@query(f"""WITH RECURSIVE {UTT},
c AS (SELECT a.media_id, a.seq AS s, a.seq + a.seq % 2 AS e, b.seq AS t, b.start AS lo, b."end" AS hi, (((7 * a.seq + 3 * b.seq) % 5 - 1) / 4)::DOUBLE AS w FROM utt a JOIN utt b ON a.media_id = b.media_id AND b.seq BETWEEN a.seq - 1 AND a.seq + 1),
l AS (SELECT media_id, list(s ORDER BY s, t) AS s, list(e ORDER BY s, t) AS e, list(t ORDER BY s, t) AS t, list(lo ORDER BY s, t) AS lo, list(hi ORDER BY s, t) AS hi, list(w ORDER BY s, t) AS w, count(*) AS n FROM c GROUP BY media_id),
st AS (SELECT media_id, 1::BIGINT AS i, [w[1]] AS best, [0::BIGINT] AS back FROM l
  UNION ALL SELECT media_id, i + 1, best || [w[i + 1] + greatest(list_max(r), 0)], back || [CASE WHEN list_max(r) > 0 THEN list_position(r, list_max(r))::BIGINT ELSE 0 END]
  FROM (SELECT st.*, l.w, list_transform(range(1, i + 1), lambda j: CASE WHEN l.e[j] < l.s[i + 1] AND l.hi[j] <= l.lo[i + 1] THEN best[j] ELSE -1e18 END) AS r FROM st JOIN l USING (media_id) WHERE i < n)),
tr AS (SELECT media_id, list_position(best, list_max(best))::BIGINT AS k, back FROM st JOIN l USING (media_id) WHERE i = n UNION ALL SELECT media_id, back[k], back FROM tr WHERE back[k] > 0)
SELECT media_id, l.s[k] AS script_start, l.t[k] AS stt_start, row_number() OVER (PARTITION BY media_id ORDER BY k) - 1 AS chain_no FROM tr JOIN l USING (media_id)""")
def w9_t1_chain_of_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The chain over blocks of four script positions, so that frontiers are handed on."""
    return chains.weighted_chain(_fixed_candidates(spark, sf), 4).select("media_id", "script_start", "stt_start", "chain_no")


def _given(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A fixed match of single lines: the n-th recognised line with the script line that it was made from, every third left out."""
    script, stt = src.script_lines(spark, sf), src.stt_lines(spark, sf)
    a, b = _grams(spark, sf)
    pairs = stt.where("id % 3 <> 2").select("media_id", F.col("id").alias("sid"), (F.col("id") + F.floor(F.col("id") / 4)).cast("int").alias("cid"))
    a1 = a.where("n = 1").select("media_id", F.col("ngram_id").alias("script_ngram_id"), F.element_at("original_ids", 1).alias("cid"))
    b1 = b.where("n = 1").select("media_id", F.col("ngram_id").alias("stt_ngram_id"), F.element_at("original_ids", 1).alias("sid"))
    chosen = pairs.join(a1, ["media_id", "cid"]).join(b1, ["media_id", "sid"]).select("media_id", "script_ngram_id", "stt_ngram_id", F.lit(1.0).alias("similarity"), F.lit(1).alias("script_n"), F.lit(1).alias("stt_n"))
    return matching.matched_rows(chosen, a, b, stt), script, stt


GIVEN = f"""{STT},
mt AS (SELECT t.media_id, s.id AS script_id, t.id AS stt_id, s.speaker, s.dialogue, t.start, t."end", t.text, t.stt_speaker FROM stt t JOIN script s ON s.media_id = t.media_id AND s.id = t.id + t.id // 4 WHERE t.id % 3 <> 2)"""


@query(f"""WITH {GIVEN} SELECT media_id, 'Matched' AS type, script_id AS script_start_id, stt_id AS stt_end_id, {cut_sql('start')} AS start_time, {cut_sql('"end"')} AS end_time, speaker, dialogue AS subtitle_text FROM mt""")
def j12_matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = _given(spark, sf)[0].select("media_id", "type", "script_start_id", "stt_end_id", "start_time", "end_time", "speaker", "subtitle_text")
    return _longs(m, "script_start_id", "stt_end_id")


@query(f"""WITH {GIVEN} SELECT 'script' AS side, media_id, id FROM script s WHERE NOT EXISTS (FROM mt WHERE mt.media_id = s.media_id AND script_id = id)
UNION ALL SELECT 'stt', media_id, id FROM stt s WHERE NOT EXISTS (FROM mt WHERE mt.media_id = s.media_id AND stt_id = id)""")
def j10_u3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    m, script, stt = _given(spark, sf)
    parts = [matching.unmatched(lines, m, ids).select(F.lit(side).alias("side"), "media_id", F.col("id").cast("long").alias("id")) for side, lines, ids in (("script", script, "script_ids"), ("stt", stt, "stt_ids"))]
    return parts[0].unionByName(parts[1])


CORR = f"""tm AS (SELECT media_id, 'Matched' AS type, script_id, stt_id, start, "end", speaker, dialogue AS subtitle_text, 0 AS p FROM mt
  UNION ALL SELECT media_id, 'Unmatched_STT', NULL, id, start, "end", stt_speaker, text, 1 FROM stt s WHERE NOT EXISTS (FROM mt WHERE mt.media_id = s.media_id AND stt_id = s.id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start, p, stt_id, script_id) AS pos FROM tm),
us AS (SELECT media_id, id AS script_id, speaker, dialogue FROM script s WHERE NOT EXISTS (FROM mt WHERE mt.media_id = s.media_id AND script_id = s.id)),
up AS (SELECT us.*, coalesce((SELECT min(pos) FROM tp WHERE tp.media_id = us.media_id AND tp.type = 'Matched' AND tp.script_id > us.script_id), 2147483647) AS pos FROM us),
al AS (SELECT media_id, type, script_id, stt_id, start, "end", speaker, subtitle_text, pos, 1 AS part FROM tp UNION ALL SELECT media_id, 'Unmatched_Script', script_id, NULL, NULL, NULL, speaker, dialogue, pos, 0 FROM up),
rn AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos, part, CASE WHEN part = 0 THEN script_id END) AS row_no FROM al)"""


@query(f"WITH {GIVEN}, {CORR} SELECT media_id, row_no, type, script_id AS script_start_id, stt_id AS stt_start_id, speaker, subtitle_text FROM rn")
def j11_u1_t4_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    t = matching.correspondence(*_given(spark, sf)).select("media_id", "row_no", "type", "script_start_id", "stt_start_id", "speaker", "subtitle_text")
    return _longs(t, "row_no", "script_start_id", "stt_start_id")


def back_sql(sec: str) -> str:
    """``time_str_to_seconds`` of ``seconds_to_time_str`` in SQL."""
    text = f"{cut_sql(sec)}"
    return f"({text}[1:2]::INTEGER * 3600.0::DOUBLE + {text}[4:5]::INTEGER * 60.0::DOUBLE + replace({text}[7:12], ',', '.')::DOUBLE)"


FILLED = f"""fl AS (SELECT *, coalesce(last_value(CASE WHEN part = 1 THEN {back_sql('"end"')} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS a,
  first_value(CASE WHEN part = 1 THEN {back_sql('start')} END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b0, sum(part) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM rn WINDOW w AS (PARTITION BY media_id ORDER BY row_no)),
f2 AS (SELECT *, coalesce(b0, a) AS b, count(*) OVER (PARTITION BY media_id, run, part) AS size, row_number() OVER (PARTITION BY media_id, run, part ORDER BY row_no) AS k FROM fl),
f3 AS (SELECT *, list_reduce([a] || list_transform(range(k - 1), lambda i: (b - a) / size), lambda x, y: x + y) AS pt FROM f2),
ft AS (SELECT *, CASE WHEN part = 1 THEN {cut_sql('start')} WHEN b > a THEN {cut_sql('pt')} ELSE {cut_sql('a')} END AS start_time,
  CASE WHEN part = 1 THEN {cut_sql('"end"')} WHEN b > a AND k < size THEN {cut_sql('(pt + (b - a) / size)')} ELSE {cut_sql('b')} END AS end_time FROM f3)"""


@query(f"WITH {GIVEN}, {CORR}, {FILLED} SELECT media_id, row_no, start_time, end_time FROM ft")
def w7_fill_unmatched_times(spark: SparkSession, sf: str) -> DataFrame:
    t = matching.correspondence(*_given(spark, sf))
    return t.select("media_id", F.col("row_no").cast("long").alias("row_no"), "start_time", "end_time")


@query(f"""WITH {GIVEN}, s AS (SELECT media_id, count(*) AS script_total FROM script GROUP BY ALL), t AS (SELECT media_id, count(*) AS stt_total FROM stt GROUP BY ALL), m AS (SELECT media_id, count(*) AS matches FROM mt GROUP BY ALL)
SELECT media_id, coalesce(matches, 0) AS matches, coalesce(matches, 0) AS script_used, script_total, round(coalesce(matches, 0) / script_total * 100, 6) AS script_percent, coalesce(matches, 0) AS stt_used, coalesce(stt_total, 0) AS stt_total, CASE WHEN stt_total > 0 THEN round(coalesce(matches, 0) / stt_total * 100, 6) ELSE 0 END AS stt_percent FROM s LEFT JOIN t USING (media_id) LEFT JOIN m USING (media_id)""")
def g11_usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return matching.usage_stats(*_given(spark, sf)).withColumns({c: F.round(c, 6) for c in ("script_percent", "stt_percent")})


@query()
def job3_match_script(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.match_script(src.script_lines(spark, sf), src.stt_lines(spark, sf))["table"]


@query(f"""WITH {GIVEN}, {CORR}, {FILLED}, us0 AS (SELECT media_id, row_no, start_time, end_time, trim(speaker) AS who, subtitle_text AS text FROM ft WHERE start_time <> '' AND end_time <> '' AND subtitle_text <> ''),
us1 AS (SELECT *, lag(nullif(who, '')) OVER w AS prev, row_number() OVER w AS n FROM us0 WINDOW w AS (PARTITION BY media_id ORDER BY row_no))
SELECT media_id, string_agg(n::VARCHAR || chr(10) || start_time || ' --> ' || end_time || chr(10) || CASE WHEN who <> '' AND prev IS DISTINCT FROM who THEN '(' || who || ')' ELSE '' END || text || chr(10), chr(10) ORDER BY n) AS document FROM us1 GROUP BY media_id""")
def job4_export_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    matched, script, stt = _given(spark, sf)
    return jobs.export_subtitles(matching.correspondence(matched.cache(), script, stt))


# ---- evaluation


def _tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reference entries, generated ones (some renamed, shifted or unknown), their given pairs, and the registered speakers."""
    ref = src.entries(spark, sf)
    who = F.when(F.col("entry_no") % 5 == 0, F.array(F.lit("Unknown_01"))).when(F.col("entry_no") % 7 == 3, F.array().cast("array<string>")).otherwise(F.col("speakers"))
    gen = ref.where("entry_no % 9 <> 4").withColumn("speakers", who).withColumn("start", F.col("start") + (F.col("entry_no") % 4) * 0.25)
    pairs = ref.join(gen.select("media_id", "entry_no", F.col("entry_no").alias("app_no")), ["media_id", "entry_no"], "left").select("media_id", F.col("entry_no").alias("pair_no"), F.col("entry_no").alias("gt_no"), "app_no")
    return ref, gen, pairs, spark.createDataFrame([("view",), ("click",)], "speaker string")


TRACKS = f"""{ENT}, gen AS (SELECT media_id, entry_no, start + (entry_no % 4) * 0.25 AS start, "end", CASE WHEN entry_no % 5 = 0 THEN ['Unknown_01'] WHEN entry_no % 7 = 3 THEN [] ELSE speakers END AS speakers, body FROM ent WHERE entry_no % 9 <> 4),
rf AS (SELECT media_id, entry_no, start, coalesce(last_value(nullif(coalesce(speakers[1], ''), '') IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY entry_no ROWS UNBOUNDED PRECEDING), '') AS speaker FROM ent WHERE {SPEECH}),
gf AS (SELECT media_id, entry_no, start, coalesce(last_value(nullif(coalesce(speakers[1], ''), '') IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY entry_no ROWS UNBOUNDED PRECEDING), '') AS speaker FROM gen WHERE {SPEECH}),
jd AS (SELECT r.media_id, r.entry_no AS gt_no, abs(r.start - g.start) AS error, r.speaker AS gt_speaker, g.speaker AS app_speaker,
  CASE WHEN r.speaker = g.speaker THEN 'correct' WHEN trim(g.speaker) = '' OR regexp_matches(trim(g.speaker), '(?i)^unknown(_[0-9]+)?$') THEN CASE WHEN r.speaker IN ('view', 'click') THEN 'false_negative' ELSE 'correct_unknown' END ELSE 'false_positive' END AS judgement
  FROM rf r JOIN gf g USING (media_id, entry_no))"""


@query(f"WITH {TRACKS} SELECT media_id, entry_no, speaker FROM gf")
def w2_fill_omitted_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.fill_omitted_speakers(_tracks(spark, sf)[1]).select("media_id", F.col("entry_no").cast("long").alias("entry_no"), "speaker")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    ref, gen, pairs, registered = _tracks(spark, sf)
    return evaluation.judged_pairs(pairs, evaluation.fill_omitted_speakers(ref), evaluation.fill_omitted_speakers(gen), registered)


@query(f"WITH {TRACKS} SELECT media_id, gt_no, round(error, 3) AS error, gt_speaker, app_speaker, judgement FROM jd")
def g9_g18_j14_detail(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.evaluation_detail(_judged(spark, sf)).select("media_id", F.col("gt_no").cast("long").alias("gt_no"), "error", "gt_speaker", "app_speaker", "judgement")


@query(f"""WITH {TRACKS}, sd AS (SELECT media_id, count(*) FILTER (WHERE entry_no % 9 <> 4) AS matched_count, count(*) FILTER (WHERE entry_no % 9 = 4) AS unmatched_gt_count FROM ent GROUP BY ALL),
ag AS (SELECT media_id, round(avg(error), 6) AS in_point_mean_error, round(median(error), 6) AS in_point_median_error, round(max(error), 6) AS in_point_max_error, count(*) FILTER (WHERE judgement = 'correct') AS correct_count, count(*) FILTER (WHERE judgement = 'false_negative') AS false_negative_count, count(*) FILTER (WHERE judgement = 'false_positive') AS false_positive_count, count(*) FILTER (WHERE judgement = 'correct_unknown') AS correct_unknown_count FROM jd GROUP BY ALL)
SELECT sd.*, 0::BIGINT AS unmatched_app_count, ag.* EXCLUDE (media_id), round(correct_count / matched_count, 6) AS speaker_accuracy FROM sd JOIN ag USING (media_id)""")
def g5_evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.evaluation_summary(_tracks(spark, sf)[2], _judged(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("in_point_mean_error", "in_point_median_error", "in_point_max_error", "speaker_accuracy")})


@query(f"WITH {TRACKS} SELECT media_id, t AS tolerance, count(*) FILTER (WHERE error <= t) AS hits, round(avg((error <= t)::INTEGER), 6) AS accuracy FROM jd, unnest([0.3::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE]) u(t) GROUP BY ALL")
def g6_in_point_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.in_point_accuracy(_judged(spark, sf), (0.3, 0.6, 1.0)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {TRACKS} SELECT media_id, gt_speaker, app_speaker, count(*) AS count, row_number() OVER (PARTITION BY media_id ORDER BY count(*) DESC, gt_speaker, app_speaker)::INTEGER AS rank FROM jd GROUP BY media_id, gt_speaker, app_speaker")
def g7_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf))


@query(f"""WITH {ENT}, s AS (SELECT DISTINCT media_id, unnest(speakers) AS s FROM ent)
SELECT media_id, list(s ORDER BY s) AS speakers, count(*) FILTER (WHERE s IN ('view', 'click')) AS registered_speaker_count, count(*) FILTER (WHERE s NOT IN ('view', 'click')) AS unregistered_speaker_count FROM s GROUP BY ALL""")
def g8_appearing_speakers(spark: SparkSession, sf: str) -> DataFrame:
    ref, _, _, registered = _tracks(spark, sf)
    return evaluation.appearing_speakers(ref, registered)


def _chat_tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u = src.utterances(spark, sf).select("media_id", (F.col("seq") + 1).alias("entry_no"), "start", "end", F.array("speaker").alias("speakers"), F.col("text").alias("body"))
    heard = src.stt_lines(spark, sf).select("media_id", (F.col("id") + 1).alias("entry_no"), "start", "end", F.array(F.when(F.col("id") % 3 == 2, "Unknown_01").otherwise("user")).alias("speakers"), F.col("text").alias("body"))
    return u, heard


@query()
def j13_align_entries(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.align_entries(*_chat_tracks(spark, sf))


@query()
def job6_g16_evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    ref, gen = _chat_tracks(spark, sf)
    return jobs.evaluate_subtitles(ref, gen, spark.createDataFrame([("user",)], "speaker string"), (0.3, 1.0), _entry_turns(ref))["report"].drop("utterance_counts")


def _entry_turns(entries: DataFrame) -> DataFrame:
    """Each entry's first speaker as a turn; two of three run on into the next."""
    spoken = entries.where(F.size("speakers") > 0)
    return spoken.select("media_id", F.col("entry_no").alias("track_seq"), F.element_at("speakers", 1).alias("cluster_id"), "start", (F.col("end") + (F.col("entry_no") % 3) * 0.5).alias("end"))


@query(f"""WITH {TRACKS}, {VARS},
sd AS (SELECT media_id, count(*) FILTER (WHERE entry_no % 9 <> 4) AS matched_count, count(*) FILTER (WHERE entry_no % 9 = 4) AS unmatched_gt_count FROM ent GROUP BY ALL),
ag AS (SELECT media_id, round(avg(error), 3) AS in_point_mean_error, round(median(error), 3) AS in_point_median_error, round(max(error), 3) AS in_point_max_error, count(*) FILTER (WHERE judgement = 'correct') AS correct_count, count(*) FILTER (WHERE judgement = 'false_negative') AS false_negative_count,
  count(*) FILTER (WHERE judgement = 'false_positive') AS false_positive_count, count(*) FILTER (WHERE judgement = 'correct_unknown') AS correct_unknown_count, round(avg((error <= 0.3)::INTEGER), 4) AS within_03, round(avg((error <= 1.0)::INTEGER), 4) AS within_10 FROM jd GROUP BY ALL),
nm2 AS (SELECT DISTINCT media_id, unnest(speakers) AS s FROM ent WHERE {SPEECH}),
rg AS (SELECT media_id, count(*) FILTER (WHERE s IN ('view', 'click')) AS registered_speaker_count, count(*) FILTER (WHERE s NOT IN ('view', 'click')) AS unregistered_speaker_count FROM nm2 GROUP BY ALL),
tn AS (SELECT media_id, start, "end" + (entry_no % 3) * 0.5 AS "end" FROM ent WHERE len(speakers) > 0),
ed AS (SELECT media_id, round(start * 1000000)::BIGINT AS t, 1 AS d FROM tn UNION ALL SELECT media_id, round("end" * 1000000)::BIGINT, -1 FROM tn), nt AS (SELECT media_id, t, sum(d) AS d FROM ed GROUP BY ALL),
ho AS (SELECT media_id, sum(d) OVER o AS depth, lead(t) OVER o - t AS span FROM nt WINDOW o AS (PARTITION BY media_id ORDER BY t)),
ov AS (SELECT media_id, round(sum(CASE WHEN depth >= 2 THEN span ELSE 0 END) / sum(CASE WHEN depth >= 1 THEN span ELSE 0 END), 4) AS overlap_time_ratio FROM ho GROUP BY media_id)
SELECT sd.*, 0::BIGINT AS unmatched_app_count, ag.* EXCLUDE (media_id), round(correct_count / matched_count, 4) AS speaker_accuracy, rg.* EXCLUDE (media_id), round(duration, 3) AS duration, utterance_count, speaker_count, changes AS speaker_change_count, round(changes / (duration / 60), 6) AS speaker_change_per_min,
overlap_entry_count, round(overlap_entry_count / utterance_count, 6) AS overlap_entry_ratio, round(secs / duration, 6) AS speech_time_ratio, overlap_time_ratio FROM sd JOIN ag USING (media_id) JOIN rg USING (media_id) JOIN vs USING (media_id) JOIN ch USING (media_id) JOIN ov USING (media_id)""")
def g16_report_of_given(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report on given pairs, with turns and a list of registered speakers."""
    ref, _, pairs, registered = _tracks(spark, sf)
    judged = _judged(spark, sf)
    parts = evaluation.evaluation_summary(pairs, judged), evaluation.in_point_accuracy(judged, (0.3, 1.0)), evaluation.appearing_speakers(ref, registered)
    report = evaluation.evaluation_report(*parts, ref, _entry_turns(ref)).drop("utterance_counts")
    within = {f"within_{name}": F.element_at("in_point_accuracies", F.lit(t)) for name, t in (("03", 0.3), ("10", 1.0))}
    rounded = {c: F.round(c, 6) for c in ("speaker_change_per_min", "overlap_entry_ratio", "speech_time_ratio")}
    return report.withColumns(within | rounded | {"duration": F.round("duration", 3)}).drop("in_point_accuracies")


# ---- documents that go out


@query(f"""WITH {UTT}, t AS (SELECT media_id, seq, start, "end", CASE seq % 4 WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE speaker || ' ' END AS who, CASE WHEN seq % 6 = 5 THEN '  ' ELSE ' ' || text || ' ' END AS said FROM utt),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n, trim(coalesce(who, '')) AS name FROM t WHERE trim(said) <> '')
SELECT media_id, string_agg(n::VARCHAR || chr(10) || replace({even_sql('start')}[1:8], ':', ':') || ',' || {even_sql('start')}[10:12] || ' --> ' || {even_sql('"end"')}[1:8] || ',' || {even_sql('"end"')}[10:12] || chr(10) || CASE WHEN name <> '' THEN '[' || name || '] ' ELSE '' END || regexp_replace(said, '^\\s+|\\s+$', '', 'g') || chr(10), chr(10) ORDER BY n) AS document FROM r GROUP BY media_id""")
def snk4_transcript_srt(spark: SparkSession, sf: str) -> DataFrame:
    u, seq = src.utterances(spark, sf).withColumn("distance", F.lit(None).cast("double")), F.col("seq")
    u = u.withColumn("speaker", F.when(seq % 4 == 2, "  ").when(seq % 4 != 3, F.concat("speaker", F.lit(" ")))).withColumn("text", F.when(seq % 6 == 5, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))))
    return sinks.render_transcript_srt(sinks.transcript_rows(u))


@query(f"""WITH {UTT}, r AS (SELECT *, lag(nullif(who, '')) OVER (PARTITION BY media_id ORDER BY seq) AS prev, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n FROM (SELECT media_id, seq, CASE WHEN seq % 4 = 2 THEN '' ELSE speaker END AS who, start, "end", text FROM utt WHERE seq % 6 <> 5))
SELECT media_id, string_agg(n::VARCHAR || chr(10) || {cut_sql('start')} || ' --> ' || {cut_sql('"end"')} || chr(10) || CASE WHEN who <> '' AND prev IS DISTINCT FROM who THEN '(' || who || ')' ELSE '' END || text || chr(10), chr(10) ORDER BY n) AS document FROM r GROUP BY media_id""")
def snk3_f1_w8_sc15_subtitles(spark: SparkSession, sf: str) -> DataFrame:
    u = src.utterances(spark, sf)
    rows = u.select("media_id", F.col("seq").alias("row_no"), tc.seconds_to_time_str(F.col("start")).alias("start_time"), tc.seconds_to_time_str(F.col("end")).alias("end_time"), F.when(F.col("seq") % 4 == 2, "").otherwise(F.col("speaker")).alias("speaker"), F.when(F.col("seq") % 6 == 5, "").otherwise(F.col("text")).alias("subtitle_text"))
    return sinks.render_subtitles(rows)


@query(f"""WITH {ENT} SELECT media_id, string_agg(entry_no::VARCHAR || chr(10) || {cut_sql('start')} || ' --> ' || {cut_sql('"end"')} || chr(10) || CASE WHEN entry_no % 2 = 0 THEN body ELSE array_to_string(list_transform(speakers, lambda s: '（' || s || '）'), '') || body END || chr(10), chr(10) ORDER BY entry_no) AS document FROM ent GROUP BY media_id""")
def snk5_clip_srt(spark: SparkSession, sf: str) -> DataFrame:
    e = src.entries(spark, sf).withColumn("index", F.col("entry_no"))
    return sinks.render_clip_srt(e.withColumn("non_speech_labels", F.array(F.lit("拍手"))).withColumn("raw_text", F.when(F.col("entry_no") % 2 == 0, F.col("body")).otherwise("")))


@query(f"""WITH {EVT}, r AS (SELECT *, CASE WHEN cluster_id <> 'c3' THEN 'Voice ' || cluster_id ELSE cluster_id END AS who FROM turns)
SELECT media_id, string_agg(printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', media_id, start, "end" - start, who) || chr(10), '' ORDER BY track_seq) AS document FROM r GROUP BY media_id""")
def snk6_rttm(spark: SparkSession, sf: str) -> DataFrame:
    t = src.turns(spark, sf)
    names = t.where("cluster_id <> 'c3'").select("media_id", "cluster_id").distinct().withColumn("speaker", F.concat(F.lit("Voice "), "cluster_id"))
    return sinks.render_rttm(t, names)


@query(f"""WITH {EVT}, {DOMINANT}, sj AS (SELECT media_id, '[' || string_agg('{{"start":' || s.start::VARCHAR || ',"end":' || s."end"::VARCHAR || ',"text":' || to_json(s.text)::VARCHAR || CASE WHEN cluster_id IS NULL THEN '' ELSE ',"cluster_id":"' || cluster_id || '"' END || '}}', ',' ORDER BY s.seq) || ']' AS j FROM segs s LEFT JOIN dom USING (media_id, seq) GROUP BY media_id),
r AS (SELECT media_id, cluster_id, arg_max((start, "end"), (round("end" - start, 6), -start)) AS b FROM turns GROUP BY ALL),
cj AS (SELECT media_id, '{{' || string_agg('"' || cluster_id || '":{{"start":' || b[1]::VARCHAR || ',"end":' || b[2]::VARCHAR || '}}', ',' ORDER BY cluster_id) || '}}' AS j, count(*) AS n FROM r GROUP BY media_id)
SELECT media_id, '{{"segments":' || coalesce(sj.j, '[]') || coalesce(',"clusters":' || cj.j, '') || ',"num_speakers":' || coalesce(n, 0)::VARCHAR || '}}' AS document FROM sj FULL JOIN cj USING (media_id)""")
def snk8_recording_document(spark: SparkSession, sf: str) -> DataFrame:
    t = src.turns(spark, sf)
    return sinks.recording_document(speakers.dominant_cluster(src.segments(spark, sf), t), speakers.representative_segment(t))


@query(f"""WITH {EVT}, n AS (SELECT media_id, cluster_id, row_number() OVER (PARTITION BY media_id ORDER BY cluster_id) AS k FROM (SELECT DISTINCT media_id, cluster_id FROM turns)),
r AS (SELECT media_id, cluster_id, arg_max((start, "end"), (round("end" - start, 6), -start)) AS b FROM turns GROUP BY ALL)
SELECT media_id, cluster_id, 'Unknown_' || printf('%02d', k) AS label, 'clip_' || cluster_id || '.wav' AS clip, b[1] AS start, b[2] AS "end" FROM n JOIN r USING (media_id, cluster_id)""")
def snk9_unknown_manifest(spark: SparkSession, sf: str) -> DataFrame:
    reps = speakers.representative_segment(src.turns(spark, sf))
    named = speakers.label_all_unknown(reps.select("media_id", "cluster_id")).withColumn("distance", F.lit(None).cast("double")).withColumn("candidates", F.lit(None).cast("map<string,double>"))
    return sinks.unknown_cluster_manifest(named, reps).drop("distance", "candidates")


@query(f"""WITH {VOICE}, l AS (SELECT media_id, min(cluster_id) AS cluster_id, 'Host' AS name FROM named WHERE speaker LIKE 'Unknown%' GROUP BY media_id), {REMATCH}
SELECT media_id, '00:00:00:000' AS start, '00:00:01:000' AS "end", coalesce(name, CASE WHEN how = 'auto' THEN near END, old) AS speaker, cluster_id AS text, CASE WHEN name IS NULL THEN round(CASE WHEN how = 'auto' THEN distance ELSE kept END, 6) END AS distance, how IS NOT NULL AS replaced
FROM rh JOIN (SELECT media_id, cluster_id, distance AS kept FROM named) USING (media_id, cluster_id)""")
def job2_label_and_rematch(spark: SparkSession, sf: str) -> DataFrame:
    registry, clusters = src.voiceprints(spark, sf)
    named = speakers.identify(clusters, registry, 0.8).join(clusters, ["media_id", "cluster_id"])
    rows = named.select("media_id", F.monotonically_increasing_id().alias("seq"), F.lit("00:00:00:000").alias("start"), F.lit("00:00:01:000").alias("end"), "speaker", F.col("cluster_id").alias("text"), "distance")
    labelled = named.where(tx.is_unknown(F.col("speaker"))).groupBy("media_id").agg(F.min("cluster_id").alias("cluster_id")).withColumn("name", F.lit("Host"))
    return jobs.label_and_rematch(rows, named, registry, labelled, 0.9)["transcript"].drop("seq").withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT 's' || (page_id % 97)::VARCHAR AS speaker, regexp_replace(hex(encode(html)), '.(.)', '\\1', 'g') AS h, printf('%012d', page_id) AS path FROM pages),
c AS (SELECT speaker, path, list_transform(['0','1','2','3','4','5','6','7','8','9','A','B','C','D','E','F'], lambda d: (length(h) - length(replace(h, d, '')))::DOUBLE) AS v FROM p),
k AS (SELECT speaker, arg_max(v, path) AS v FROM c WHERE list_sum(v) > 0 GROUP BY speaker)
SELECT 'db' AS db, speaker, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS embedding FROM k""")
def job7_build_registry(spark: SparkSession, sf: str) -> DataFrame:
    pages = src.table(spark, sf, "pages")
    f = pages.select(F.lit("n").alias("namespace"), F.lit("db").alias("db"), F.concat(F.lit("s"), (F.col("page_id") % 97).cast("string")).alias("speaker"), F.format_string("%012d", "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    cache = f.limit(0).select("namespace", F.lit("").alias("content_sha256"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    return jobs.build_registry(f, cache, byte_counts)[0].select("db", "speaker", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query(ORACLES["job7_build_registry"])
def job7_j16_registry_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every third file's vector is stored by a first run; a second computes the rest, and a third, which makes the registry, none."""
    pages = src.table(spark, sf, "pages")
    f = pages.select("page_id", F.lit("n").alias("namespace"), F.lit("db").alias("db"), F.concat(F.lit("s"), (F.col("page_id") % 97).cast("string")).alias("speaker"), F.format_string("%012d", "page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    store = EmbeddingStore(scratch_folder(spark))
    jobs.build_registry_from_store(f.where("page_id % 3 = 0"), store, byte_counts)
    jobs.build_registry_from_store(f, store, byte_counts)
    registry, computed = jobs.build_registry_from_store(f, store, byte_counts)
    if computed:
        raise ValueError(f"{computed} stored vectors were computed again")
    return registry.select("db", "speaker", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def byte_counts(contents: list[bytes]):
    """A stand-in for a voice model: how often each of 16 byte classes occurs."""
    import numpy as np

    return [np.bincount(np.frombuffer(c, "u1") % 16, minlength=16) for c in contents]


# ---- files written and read again


@query(f"""WITH {UTT} SELECT media_id::VARCHAR AS media_id, {even_sql('start')} AS start, {even_sql('"end"')} AS "end", speaker, text, '' AS cosine_distance FROM utt""")
def snk1_src1_transcript_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_transcript_csv(sinks.transcript_rows(src.utterances(spark, sf).withColumn("distance", F.lit(None).cast("double"))), path)
    return files.read_csv_table(spark, path).select("media_id", *sinks.TRANSCRIPT)


@query(f"""WITH {GIVEN}, {CORR}, {FILLED} SELECT ft.media_id::VARCHAR AS media_id, ft.type, coalesce(ft.script_id::VARCHAR, '') AS script_start_id, coalesce(ft.script_id::VARCHAR, '') AS script_end_id, coalesce(s.speaker, '') AS script_speaker, coalesce(s.dialogue, '') AS script_dialogue,
coalesce(ft.stt_id::VARCHAR, '') AS stt_start_id, coalesce(ft.stt_id::VARCHAR, '') AS stt_end_id, coalesce(t.stt_speaker, '') AS stt_speaker, coalesce(t.text, '') AS stt_text, start_time, end_time, coalesce(ft.speaker, '') AS speaker, coalesce(subtitle_text, '') AS subtitle_text
FROM ft LEFT JOIN script s ON s.media_id = ft.media_id AND s.id = ft.script_id LEFT JOIN stt t ON t.media_id = ft.media_id AND t.id = ft.stt_id""")
def snk2_correspondence_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark)
    sinks.write_correspondence_csv(matching.correspondence(*_given(spark, sf)), path)
    return files.read_csv_table(spark, path).select("media_id", *matching.COLUMNS)


@query(f"WITH {EVT}, c AS (SELECT media_id, count(*) AS n FROM turns GROUP BY ALL) SELECT media_id, n FROM c UNION ALL SELECT media_id, n FROM c")
def snk7_append_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = scratch_folder(spark), src.turns(spark, sf).groupBy("media_id").agg(F.count("*").alias("n"))
    for run in ("first", "second", "second"):  # the last is a repeat, which adds nothing
        sinks.append_metrics(rows, path, run)
    return spark.read.parquet(path).select("media_id", "n")


def _paired(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every two conversations put together under the even number, so that odd recordings have no rows; and all recordings."""
    u, odd = src.utterances(spark, sf), F.col("media_id") % 2
    rows = u.withColumn("seq", F.col("seq") * 2 + odd).withColumn("media_id", F.col("media_id") - odd).withColumn("distance", F.lit(None).cast("double"))
    return rows, u.select("media_id").distinct()


PAIRED = f"""{UTT}, pu AS (SELECT media_id - media_id % 2 AS media_id, seq * 2 + media_id % 2 AS seq, speaker, text, start, "end" FROM utt), al AS (SELECT DISTINCT media_id FROM utt)"""


def _written(spark: SparkSession, documents: DataFrame, ending: str, **options) -> str:
    path = scratch_folder(spark)
    write_documents(documents, path, ending, **options)
    return path


@query(f"""WITH {PAIRED}, b AS (SELECT media_id, string_agg('"' || {even_sql('start')} || '","' || {even_sql('"end"')} || '","' || replace(speaker, '"', '""') || '","' || replace(text, '"', '""') || '",""' || chr(10), '' ORDER BY seq) AS body FROM pu GROUP BY media_id)
SELECT media_id::VARCHAR AS media_id, '"start","end","speaker","text","cosine_distance"' || chr(10) || coalesce(body, '') AS document FROM al LEFT JOIN b USING (media_id)""")
def snk1_transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    rows, recordings = _paired(spark, sf)
    path = scratch_folder(spark)
    sinks.write_transcript_csv(sinks.transcript_rows(rows), path, recordings)
    return files.whole_texts(spark, path).withColumnRenamed("text", "document")


@query(f"""WITH {PAIRED}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS n FROM pu WHERE trim(text) <> ''),
b AS (SELECT media_id, string_agg(n::VARCHAR || chr(10) || {even_sql('start')}[1:8] || ',' || {even_sql('start')}[10:12] || ' --> ' || {even_sql('"end"')}[1:8] || ',' || {even_sql('"end"')}[10:12] || chr(10) || '[' || speaker || '] ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10), chr(10) ORDER BY n) AS document FROM r GROUP BY media_id)
SELECT media_id::VARCHAR AS media_id, coalesce(document, '') AS document FROM al LEFT JOIN b USING (media_id)""")
def snk4_transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    rows, recordings = _paired(spark, sf)
    path = _written(spark, sinks.render_transcript_srt(sinks.transcript_rows(rows), recordings), "srt")
    return files.read_documents(spark, path, "srt")


@query(f"""WITH {PAIRED}, p AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq)::INTEGER AS index, lag(speaker) OVER (PARTITION BY media_id ORDER BY seq) AS prev, round(floor(start) + floor((start * 1000) % 1000) / 1000, 3) AS t FROM pu)
SELECT media_id::VARCHAR AS media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, index)::INTEGER AS entry_no, index, t AS start, CASE WHEN prev IS NOT DISTINCT FROM speaker THEN []::VARCHAR[] ELSE [speaker] END AS speakers, trim(replace(text, chr(10), ' ')) AS body FROM p""")
def snk3_src2_subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    rows, recordings = _paired(spark, sf)
    edited = rows.select("media_id", F.col("seq").alias("row_no"), tc.seconds_to_time_str(F.col("start")).alias("start_time"), tc.seconds_to_time_str(F.col("end")).alias("end_time"), "speaker", F.replace("text", F.lit("\n"), F.lit(" ")).alias("subtitle_text"))
    entries = files.read_subtitles(spark, _written(spark, sinks.render_subtitles(edited, recordings=recordings), "srt"))
    return entries.select("media_id", "entry_no", "index", F.round("start", 3).alias("start"), "speakers", "body")


@query(f"""WITH {UTT}, p AS (SELECT media_id, seq, {cut_sql('start')} AS start_tc, {cut_sql('"end"')} AS end_tc, ltrim(replace(text, chr(10), ' ')) AS text, speaker AS stt_speaker, {NORM.format('text')} AS norm FROM utt)
SELECT media_id::VARCHAR AS media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seq) - 1)::INTEGER AS id, start_tc, end_tc, rtrim(text) AS text, stt_speaker FROM p
WHERE end_tc > start_tc AND length(norm) >= 2 AND regexp_matches(norm, '[a-zA-Z0-9]') AND NOT (len(string_split(norm, ' ')) >= 2 AND len(list_distinct(string_split(norm, ' '))) = 1)""")
def src3_stt_files_in_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser subtitles written as files and read in splits far smaller than a file."""
    path = _written(spark, _srt_texts(spark, sf, ("[", "] ")).withColumnRenamed("text", "document"), "srt")
    return files.read_stt_srt(spark, path, split_bytes=512).select("media_id", "id", "start_tc", "end_tc", F.rtrim("text").alias("text"), "stt_speaker")


@query(f"""WITH {EVT}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY track_seq) - 1 AS line FROM turns)
SELECT media_id, line AS track_seq, 'V' || cluster_id AS cluster_id, round(start, 3) AS start, round("end", 3) AS "end" FROM n""")
def snk6_src6_rttm_files(spark: SparkSession, sf: str) -> DataFrame:
    t = src.turns(spark, sf)
    names = t.select("media_id", "cluster_id").distinct().withColumn("speaker", F.concat(F.lit("V"), "cluster_id"))
    silent = t.select(F.concat("media_id", F.lit(" silent")).alias("media_id"))
    path = _written(spark, sinks.render_rttm(t, names, t.select("media_id").unionByName(silent)), "rttm")
    back = files.read_rttm(spark, path)
    return back.select("media_id", F.col("track_seq").cast("long").alias("track_seq"), "cluster_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("SELECT page_id, NOT (l IN ('笑') OR contains(l, 'BGM') OR ends_with(l, '音')) AS speaks FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '笑' WHEN 1 THEN 'BGM ' || url WHEN 2 THEN url || '音' ELSE url END AS l FROM pages)")
def f4_speaker_labels(spark: SparkSession, sf: str) -> DataFrame:
    k, url = F.col("page_id") % 4, F.col("url")
    label = F.when(k == 0, "笑").when(k == 1, F.concat(F.lit("BGM "), url)).when(k == 2, F.concat(url, F.lit("音"))).otherwise(url)
    return src.table(spark, sf, "pages").select("page_id", tx.is_speaker_label(label).alias("speaks"))


@query("""SELECT doc_id % 20 AS media_id, count(*) AS shown FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
WHERE CASE n % 3 WHEN 0 THEN l WHEN 1 THEN ' ' ELSE '' END <> '' GROUP BY ALL""")
def f1_usable_rows(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("seq") % 3
    said = F.when(third == 0, F.col("text")).when(third == 1, " ").otherwise("")  # a field of white space is content
    l = src.lines(spark, sf).select((F.col("media_id") % 20).alias("media_id"), F.lit("0").alias("start_time"), F.lit("1").alias("end_time"), said.alias("subtitle_text"))
    return sinks.usable_subtitle_rows(l).groupBy("media_id").agg(F.count("*").alias("shown"))


#: The same queries under the names that they had while the first ones read a part of their tables.
for _name in ("f6_w3_hallucinations", "snk5_clip_srt", "f9_f10_shift_and_cut"):
    QUERIES[f"{_name}_whole"], ORACLES[f"{_name}_whole"] = QUERIES[_name], ORACLES[_name]
