"""Queries over timed words, frames and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import predicates, timing
from voxlake.functions.expr import words_of
from voxlake.functions.table_functions import register_sql
from voxlake.operators import blocks, captions, scoring, windows
from voxlake.operators import words as ops
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import range_blocks, whole_text
from voxlake.plans import sql
from voxlake.plans.registry import ORACLES, query
from voxlake.plans.relations import channel_pairs, frames, table, turns, words
from voxlake.session import materialize, scratch_path
from voxlake.sources.document_files import read_files, write_files

REC = ["recording_id"]
W = f"WITH RECURSIVE {sql.WORDS}"


def kept_words(spark, sf_dir) -> DataFrame:
    """Words for several passes: texts are split and numbered once."""
    return materialize(words(spark, sf_dir), "words")


def pieces(spark, sf_dir) -> DataFrame:
    """Words cut into pieces of three letters, one frame each, ten frames per word."""
    rows = words(spark, sf_dir)
    count = F.ceil(F.length("word") / 3).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr("word", i * 3 + 1, F.lit(3)))
    exploded = rows.select("recording_id", "word_idx", F.posexplode(cut).alias("p", "piece"))
    return exploded.select(
        "recording_id",
        (F.col("word_idx") * 64 + F.col("p")).alias("tok_idx"),
        F.when(F.col("p") == 0, F.concat(F.lit("▁"), F.col("piece"))).otherwise(F.col("piece")).alias("text"),
        (F.col("word_idx") * 10 + F.col("p")).alias("frame"),
        (F.length("piece") / 4.0).alias("confidence"),
    )


@query(
    "sg01_tokens_to_words",
    f"""{W} SELECT recording_id, word_idx + 1 AS word_ord, word, (word_idx * 10) * 4e-2 AS start,
  (word_idx * 10 + (length(word) + 2) // 3 - 1) * 4e-2 AS "end", round(length(word) / 4e0 / ((length(word) + 2) // 3), 6) AS confidence FROM words""",
)
def sg01(spark, sf_dir):
    out = ops.tokens_to_words(pieces(spark, sf_dir), REC)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "sg01_characters_to_words",
    f"""{W} SELECT recording_id, word_idx + 1 AS word_ord, word[4:] AS word, (word_idx * 10 + 1) * 4e-2 AS start,
  (word_idx * 10 + (length(word) + 2) // 3 - 1) * 4e-2 AS "end" FROM words WHERE length(word) > 3""",
)
def sg01_chars(spark, sf_dir):
    out = ops.tokens_to_words(pieces(spark, sf_dir), REC, separators_only=True)
    return out.select("recording_id", "word_ord", "word", "start", "end")


_BREAKS = f"""{sql.WORDS},
looked AS (SELECT *, lag("end") OVER w AS pe, lag(speaker) OVER w AS ps, lag(word) OVER w AS pw FROM words
  WINDOW w AS (PARTITION BY recording_id ORDER BY word_idx)),
flagged AS (SELECT *, (pw IS NULL OR start - pe > 9e-1 OR speaker <> ps OR regexp_matches(pw, '[.!?]$')) AS brk FROM looked)"""


@query(
    "sg02_natural_segments",
    f"""WITH RECURSIVE {_BREAKS},
walk AS (SELECT recording_id, word_idx, word_idx AS seg, start AS seg_start FROM flagged WHERE word_idx = 0
  UNION ALL SELECT f.recording_id, f.word_idx, CASE WHEN f.brk OR f."end" - w.seg_start > 30 THEN f.word_idx ELSE w.seg END,
  CASE WHEN f.brk OR f."end" - w.seg_start > 30 THEN f.start ELSE w.seg_start END
  FROM walk w JOIN flagged f ON f.recording_id = w.recording_id AND f.word_idx = w.word_idx + 1)
SELECT k.recording_id, k.seg AS segment_start, min(f.start) AS start, max(f."end") AS "end",
  string_agg(f.word, ' ' ORDER BY f.word_idx) AS text, count(*) AS n_words, min(f.speaker) AS speaker
FROM walk k JOIN flagged f ON f.recording_id = k.recording_id AND f.word_idx = k.word_idx GROUP BY 1, 2""",
)
def sg02(spark, sf_dir):
    return ops.natural_segments(kept_words(spark, sf_dir), REC).drop("avg_confidence")


_CUES = f"""{sql.WORDS},
sized AS (SELECT *, strlen(word) AS n, lag(speaker) OVER (PARTITION BY recording_id ORDER BY word_idx) AS ps FROM words),
walk AS (SELECT recording_id, word_idx, speaker, word_idx AS cue, 12 + n AS bytes, 1 AS k FROM sized WHERE word_idx = 0
  UNION ALL SELECT s.recording_id, s.word_idx, s.speaker,
    CASE WHEN s.speaker <> w.speaker OR w.bytes + 1 + s.n > 80 OR w.k + 1 > 14 THEN s.word_idx ELSE w.cue END,
    CASE WHEN s.speaker <> w.speaker OR w.bytes + 1 + s.n > 80 OR w.k + 1 > 14 THEN 12 + s.n ELSE w.bytes + 1 + s.n END,
    CASE WHEN s.speaker <> w.speaker OR w.bytes + 1 + s.n > 80 OR w.k + 1 > 14 THEN 1 ELSE w.k + 1 END
  FROM walk w JOIN sized s ON s.recording_id = w.recording_id AND s.word_idx = w.word_idx + 1),
cues AS (SELECT k.recording_id, k.cue AS cue_start, 1 AS cue_part, min(s.start) AS start, max(s."end") AS "end",
  '[SPEAKER_' || min(s.speaker) || '] ' || string_agg(s.word, ' ' ORDER BY s.word_idx) AS text, count(*) AS n_words,
  min(s.speaker) AS speaker FROM walk k JOIN sized s ON s.recording_id = k.recording_id AND s.word_idx = k.word_idx GROUP BY 1, 2
  UNION ALL SELECT recording_id, word_idx, 0, start, coalesce((SELECT "end" FROM words p WHERE p.recording_id = sized.recording_id
    AND p.word_idx = sized.word_idx - 1), "end"), '[SPEAKER_' || speaker || ']', 0, NULL
  FROM sized WHERE ps IS DISTINCT FROM speaker AND 12 + 1 + n > 80),
numbered AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY cue_start, cue_part) - 1 AS cue_idx FROM cues)"""


@query("sg03_caption_cues", f"WITH RECURSIVE {_CUES} SELECT * FROM cues")
def sg03(spark, sf_dir):
    return ops.caption_cues(kept_words(spark, sf_dir), REC)


def _from_sql(spark, sf_dir, rows: DataFrame, function: str, order: str) -> DataFrame:
    register_sql(spark)
    rows.createOrReplaceTempView("voxlake_rows")
    return spark.sql(f"SELECT * FROM {function}(TABLE(voxlake_rows) PARTITION BY recording_id ORDER BY ({order}), 'recording_id')")


@query("ud05_sql_words", ORACLES["sg01_tokens_to_words"])
def ud05_words(spark, sf_dir):
    out = _from_sql(spark, sf_dir, pieces(spark, sf_dir), "tokens_to_words", "tok_idx")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("ud05_sql_segments", ORACLES["sg02_natural_segments"])
def ud05_segments(spark, sf_dir):
    return _from_sql(spark, sf_dir, words(spark, sf_dir), "natural_segments", "word_idx").drop("avg_confidence")


@query("ud05_sql_cues", ORACLES["sg03_caption_cues"])
def ud05_cues(spark, sf_dir):
    return _from_sql(spark, sf_dir, words(spark, sf_dir), "caption_cues", "word_idx")


@query(
    "sg04_segment_speaker",
    f"""{W} SELECT recording_id, floor(start / 30)::BIGINT AS slot, CASE WHEN min(speaker) = max(speaker) THEN min(speaker) END AS speaker
FROM words GROUP BY 1, 2""",
)
def sg04(spark, sf_dir):
    rows = words(spark, sf_dir).withColumn("slot", F.floor(F.col("start") / 30))
    return rows.groupBy("recording_id", "slot").agg(ops.common_speaker().alias("speaker"))


@query(
    "sg05_render_srt",
    f"""WITH RECURSIVE {_CUES}
SELECT recording_id, cue_idx // 65536 AS part, string_agg(CASE WHEN cue_idx > 0 THEN chr(10) ELSE '' END || (cue_idx + 1) || chr(10) ||
  {sql.clock('start', ',')} || ' --> ' || {sql.clock('"end"', ',')} || chr(10) || text || chr(10), '' ORDER BY cue_idx) AS document
FROM numbered GROUP BY 1, 2""",
)
def sg05(spark, sf_dir):
    return captions.render_srt(ops.caption_cues(kept_words(spark, sf_dir), REC), REC)


@query(
    "sg05_render_vtt",
    f"""WITH RECURSIVE {_CUES}
SELECT recording_id, cue_idx // 65536 AS part, string_agg(CASE WHEN cue_idx = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END ||
  {sql.clock('start', '.')} || ' --> ' || {sql.clock('"end"', '.')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_idx) AS document
FROM numbered GROUP BY 1, 2""",
)
def sg05_vtt(spark, sf_dir):
    return captions.render_vtt(ops.caption_cues(kept_words(spark, sf_dir), REC), REC)


_HEAD = """'---' || chr(10) || 'duration: ' || regexp_replace((max("end"))::VARCHAR, '\\.0$', '') || chr(10) || 'language: ru' || chr(10)
  || 'speakers: ' || (max(speaker) + 1) || chr(10) || '---' || chr(10) || chr(10)"""


@query(
    "sg06_render_markdown",
    f"""{W}, t AS (SELECT recording_id, 0 AS section, {_HEAD} || '# Transcript' || chr(10) || chr(10) ||
  string_agg(word, ' ' ORDER BY word_idx) || chr(10) || chr(10) AS document FROM words GROUP BY 1
UNION ALL SELECT recording_id, 1, '# Word timings' || chr(10) || chr(10) || '| Word | Start | End | Confidence | Speaker |' || chr(10)
  || '|------|-------|-----|------------|---------|' || chr(10) || string_agg(printf('| %s | %.3fs | %.3fs | %.3f | SPEAKER_%d |',
  replace(word, '|', '\\|'), start, "end", confidence, speaker) || chr(10), '' ORDER BY word_idx) FROM words GROUP BY 1)
SELECT recording_id, section, 0 AS part, document FROM t""",
)
def sg06(spark, sf_dir):
    return captions.render_markdown(words(spark, sf_dir), REC, word_table=True)


@query(
    "sg06_markdown_segments",
    f"""WITH RECURSIVE {_CUES}, heads AS (SELECT recording_id, {_HEAD} AS h FROM words GROUP BY 1)
SELECT recording_id, cue_idx // 65536 AS part, string_agg(CASE WHEN cue_idx = 0 THEN h ELSE '' END || '### [' ||
  CASE WHEN round(start) >= 3600 THEN printf('%02d:', round(start)::BIGINT // 3600) ELSE '' END ||
  printf('%02d:%02d', round(start)::BIGINT // 60 % 60, round(start)::BIGINT % 60) || ']' || chr(10) || chr(10) || text || chr(10) || chr(10),
  '' ORDER BY cue_idx) AS document FROM numbered JOIN heads USING (recording_id) GROUP BY 1, 2""",
)
def sg06_segments(spark, sf_dir):
    rows = kept_words(spark, sf_dir)
    return captions.render_markdown_segments(rows, ops.caption_cues(rows, REC), REC)


_JSON = """'{"text":"' || string_agg(to_json(word)[2:-2], ' ' ORDER BY word_idx) || '","words":[' || string_agg('{"word":' || to_json(word) ||
  ',"start":' || start::VARCHAR || ',"end":' || ("end")::VARCHAR || '}', ',' ORDER BY word_idx) || '],"duration":' || max("end")::VARCHAR || '}'"""


@query(
    "sc13_document_files",
    f"""WITH RECURSIVE {_CUES}, made AS (
  SELECT recording_id, 'json' AS format, {_JSON} AS body FROM words GROUP BY 1
  UNION ALL SELECT recording_id, 'txt', string_agg(word, ' ' ORDER BY word_idx) FROM words GROUP BY 1
  UNION ALL SELECT recording_id, 'md', {_HEAD} || '# Transcript' || chr(10) || chr(10) || string_agg(word, ' ' ORDER BY word_idx) || chr(10) || chr(10)
    FROM words GROUP BY 1
  UNION ALL SELECT recording_id, 'srt', string_agg(CASE WHEN cue_idx > 0 THEN chr(10) ELSE '' END || (cue_idx + 1) || chr(10) ||
    {sql.clock('start', ',')} || ' --> ' || {sql.clock('"end"', ',')} || chr(10) || text || chr(10), '' ORDER BY cue_idx) FROM numbered GROUP BY 1
  UNION ALL SELECT recording_id, 'vtt', string_agg(CASE WHEN cue_idx = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END ||
    {sql.clock('start', '.')} || ' --> ' || {sql.clock('"end"', '.')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY cue_idx) FROM numbered GROUP BY 1)
SELECT recording_id || '.' || format AS name, strlen(body) AS n_bytes, md5(body) AS digest FROM made""",
)
def sc13_files(spark, sf_dir):
    """Every recording as a file in each output format, written and read back byte for byte."""
    rows = kept_words(spark, sf_dir)
    parts = captions.render_outputs(rows, ops.caption_cues(rows, REC), REC, ["json", "txt", "srt", "vtt", "md"])
    # Folders of so many recordings: no step lists all files.
    folder = F.floor(F.col("recording_id") / 64).cast("string")
    named = parts.withColumn("output", F.concat(folder, F.lit("/"), F.col("recording_id").cast("string"), F.lit("."), F.col("format")))
    path = scratch_path(spark, "outputs")
    write_files(named, path, ["section", "part"])
    back = read_files(spark, path)
    return back.select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.md5("content").alias("digest")
    )


@query(
    "tx22_clock_formats",
    f"""{W} SELECT recording_id, word_idx, {sql.clock('start', ',')} AS srt, {sql.clock('start', '.')} AS vtt,
  CASE WHEN round(start * 60) >= 3600 THEN printf('%02d:', round(start * 60)::BIGINT // 3600) ELSE '' END ||
  printf('%02d:%02d', round(start * 60)::BIGINT // 60 % 60, round(start * 60)::BIGINT % 60) AS hms FROM words""",
)
def tx22(spark, sf_dir):
    start = F.col("start")
    return words(spark, sf_dir).select(
        "recording_id",
        "word_idx",
        timing.format_srt_time(start).alias("srt"),
        timing.format_vtt_time(start).alias("vtt"),
        timing.format_hms(start * 60).alias("hms"),
    )


@query(
    "tx23_tx24_time_units",
    "SELECT l_orderkey, l_linenumber, (l_linenumber + l_suppkey) * 4e-2 AS seconds, (l_partkey * 16000) // 1000 AS samples FROM lineitem",
)
def tx23(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        timing.frame_to_seconds(F.col("l_linenumber"), F.col("l_suppkey")).alias("seconds"),
        timing.ms_to_samples_col(F.col("l_partkey")).alias("samples"),
    )


@query(
    "tx26_softmax_argmax",
    """WITH m AS (SELECT vec_id, embedding, list_max(embedding) AS mx FROM embeddings),
a AS (SELECT *, list_max(list_filter(range(len(embedding)), lambda i: embedding[i + 1] = mx)) AS best FROM m)
SELECT vec_id, best, round(1e0 / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE - mx::DOUBLE))), 6) AS confidence FROM a""",
)
def tx26(spark, sf_dir):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("s"), timing.argmax_last(scores).alias("best"))
    return rows.select(
        "vec_id", "best", F.round(timing.softmax_confidence(F.col("s"), F.col("best")), 6).alias("confidence")
    )


@query(
    "tk05_top_labels",
    """WITH r AS (SELECT vec_id, list_transform(range(len(embedding)), lambda i: {'p': -embedding[i + 1], 'i': i}) AS e FROM embeddings)
SELECT vec_id, array_to_string(list_transform(list_sort(e)[1:6], lambda x: x.i), ' ') AS top FROM r""",
)
def tk05(spark, sf_dir):
    top = timing.top_k(F.col("embedding"), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(top, " ").alias("top"))


@query(
    "tx27_result_json",
    f"""WITH RECURSIVE {_BREAKS}, m AS (SELECT recording_id, max("end") AS duration, count(*) AS n,
  string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY 1)
SELECT recording_id, duration, md5(text) AS digest, n AS n_words, n AS json_words, false AS has_confidence FROM m""",
)
def tx27(spark, sf_dir):
    rows = words(spark, sf_dir)
    text = whole_text(captions.render_txt(rows, REC), REC, "document")
    timed = F.array_sort(F.collect_list(F.struct("word_idx", "word", "start", "end")))
    listed = F.transform(timed, lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    facts = rows.groupBy("recording_id").agg(
        F.max("end").alias("duration_s"), F.count(F.lit(1)).alias("n_words"), listed.alias("words")
    )
    joined = safe_join(text, facts, REC)
    made = captions.result_json(F.col("document"), F.col("duration_s"), F.lit(None).cast("double"), F.col("words"))
    return joined.select("recording_id", "n_words", made.alias("j")).select(
        "recording_id",
        F.get_json_object("j", "$.duration").cast("double").alias("duration"),
        F.md5(F.get_json_object("j", "$.text")).alias("digest"),
        "n_words",
        F.json_array_length(F.get_json_object("j", "$.words")).cast("bigint").alias("json_words"),
        F.col("j").contains("confidence").alias("has_confidence"),
    )


@query(
    "tx27_verbose_segments",
    f"""WITH RECURSIVE {_BREAKS},
walk AS (SELECT recording_id, word_idx, word_idx AS seg, start AS seg_start FROM flagged WHERE word_idx = 0
  UNION ALL SELECT f.recording_id, f.word_idx, CASE WHEN f.brk OR f."end" - w.seg_start > 30 THEN f.word_idx ELSE w.seg END,
  CASE WHEN f.brk OR f."end" - w.seg_start > 30 THEN f.start ELSE w.seg_start END
  FROM walk w JOIN flagged f ON f.recording_id = w.recording_id AND f.word_idx = w.word_idx + 1),
segs AS (SELECT k.recording_id, k.seg, min(f.start) AS start, max(f."end") AS "end", string_agg(f.word, ' ' ORDER BY f.word_idx) AS text,
  avg(f.confidence) AS c FROM walk k JOIN flagged f ON f.recording_id = k.recording_id AND f.word_idx = k.word_idx GROUP BY 1, 2)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY seg) - 1 AS id, round(start * 100)::BIGINT AS seek, start, "end",
  ' ' || text AS text, round(greatest(least(c - 1, 0), -1), 6) AS avg_logprob FROM segs""",
)
def tx27_verbose(spark, sf_dir):
    out = captions.verbose_segments(ops.natural_segments(kept_words(spark, sf_dir), REC), REC)
    return out.withColumn("avg_logprob", F.round("avg_logprob", 6))


@query(
    "wn01_audio_windows",
    """WITH r AS (SELECT doc_id, n_chars * 1600 AS total FROM documents WHERE n_chars > 0),
k AS (SELECT *, CASE WHEN total <= 480000 THEN 0 ELSE (greatest(total - 384000, 0) + 352000 - 1) // 352000 END AS last FROM r),
e AS (SELECT *, unnest(range(0, last + 1)) AS chunk_id FROM k)
SELECT doc_id, total, chunk_id, chunk_id * 352000 AS start_sample,
  CASE WHEN total <= 480000 THEN total ELSE least(chunk_id * 352000 + 384000, total) END AS end_sample FROM e""",
)
def wn01(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1600).alias("total"))
    return windows.audio_windows(rows, "total")


_PLAN = f"""sizes AS (SELECT doc_id, len({sql.words('text')}) AS n_words FROM documents),
k AS (SELECT *, (greatest(n_words - 250, 0) + 209) // 210 AS last FROM sizes WHERE n_words > 0),
e AS (SELECT *, unnest(range(0, last + 1)) AS window_idx FROM k),
plan AS (SELECT doc_id, n_words, window_idx, window_idx * 210 AS start, least(window_idx * 210 + 250, n_words) AS "end",
  CASE WHEN window_idx = 0 THEN 0 ELSE window_idx * 210 + 20 END AS keep_start,
  CASE WHEN window_idx * 210 + 250 >= n_words THEN n_words ELSE window_idx * 210 + 230 END AS keep_end FROM e)"""


def _doc_sizes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))


@query("wn02_label_windows", f"WITH {_PLAN} SELECT * FROM plan")
def wn02(spark, sf_dir):
    return windows.label_windows(_doc_sizes(spark, sf_dir), "n_words")


@query(
    "wn03_splice_labels",
    f"""WITH {_PLAN}, l AS (SELECT doc_id, window_idx, start, keep_start, keep_end, unnest(range(0, "end" - start)) AS o FROM plan
  WHERE window_idx % 5 <> 3),
kept AS (SELECT doc_id, start + o AS word_idx, window_idx * 1000 + o AS label FROM l WHERE start + o >= keep_start AND start + o < keep_end),
w AS (SELECT doc_id, unnest(range(0, n_words)) AS word_idx FROM sizes)
SELECT w.doc_id, w.word_idx, k.label FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id AND k.word_idx = w.word_idx""",
)
def wn03(spark, sf_dir):
    plan = materialize(windows.label_windows(_doc_sizes(spark, sf_dir), "n_words"), "label-plan")
    offsets = F.sequence(F.lit(0).cast("bigint"), F.col("end") - F.col("start") - 1)
    # Every fifth window from the fourth on counts as failed.
    labels = plan.filter(F.col("window_idx") % 5 != 3).select(
        "doc_id", "window_idx", F.transform(offsets, lambda o: F.col("window_idx") * 1000 + o).alias("labels")
    )
    return windows.splice_labels(plan, labels, ["doc_id"])


@query(
    "wn04_seam_stitch",
    f"{W} SELECT recording_id, word_idx, word, start FROM words",
)
def wn04(spark, sf_dir):
    rows = words(spark, sf_dir)
    chunked = ops.overlapping_chunks(rows)
    last = rows.groupBy("recording_id").agg(F.floor(F.max("start") / 22.0).alias("_n"))
    chunks = last.select(
        "recording_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("chunk_id")
    ).withColumn("seam_s", ops.seam_seconds(F.col("chunk_id")))
    return ops.stitch_chunks(chunked, chunks, REC).select("recording_id", "word_idx", "word", "start")


def regions_sql(threshold: str, silence: int, speech: int, pad: int) -> str:
    return f"""{sql.FRAMES},
ends AS (SELECT recording_id, (max(frame_idx) + 1) * 512 AS total, max(frame_idx) AS last FROM frames GROUP BY 1),
loud AS (SELECT recording_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS g
  FROM frames WHERE prob >= {threshold}),
runs AS (SELECT recording_id, min(frame_idx) * 512 AS s, (max(frame_idx) + 1) * 512 AS e FROM loud GROUP BY recording_id, g),
m1 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY recording_id ORDER BY s) < {silence} THEN 0 ELSE 1 END AS b FROM runs),
m2 AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY s) AS g FROM m1),
m3 AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM m2 GROUP BY recording_id, g HAVING max(e) - min(s) >= {speech}),
p1 AS (SELECT m3.recording_id, greatest(s - {pad}, 0) AS s, least(e + {pad}, total) AS e FROM m3 JOIN ends USING (recording_id)),
p2 AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY recording_id ORDER BY s) THEN 0 ELSE 1 END AS b FROM p1),
p3 AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY s) AS g FROM p2),
regions AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY min(s)) - 1 AS region_idx, min(s) AS start,
  max(e) AS "end" FROM p3 GROUP BY recording_id, g)"""


VAD = {"threshold": 0.15, "min_silence_ms": 100, "min_speech_ms": 64, "pad_ms": 40}
VAD_SQL = ("15e-2", 1600, 1024, 640)


@query("wn05_speech_regions", f'WITH {regions_sql(*VAD_SQL)} SELECT * FROM regions')
def wn05(spark, sf_dir):
    return windows.speech_regions(frames(spark, sf_dir), REC, **VAD)


@query(
    "wn06_index_runs",
    """WITH g AS (SELECT lang AS source, doc_id AS idx, n_chars / 10e0 AS seconds,
  doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents)
SELECT source, min(idx) AS first_idx, max(idx) AS last_idx, round(sum(seconds), 3) AS seconds FROM g GROUP BY source, k HAVING sum(seconds) >= 60""",
)
def wn06(spark, sf_dir):
    name = F.concat(F.lit("/data/"), F.col("lang"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".wav"))
    files = table(spark, sf_dir, "documents").select(name.alias("filename"), (F.col("n_chars") / 10.0).alias("seconds"))
    return windows.index_runs(files, min_seconds=60.0).withColumn("seconds", F.round("seconds", 3))


@query(
    "wn07_prefix_closest",
    """WITH s AS (SELECT conv_id, turn, length(text) AS seconds, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
x AS (SELECT s.*, g.target FROM s, (VALUES (200e0), (1000e0), (2500e0)) g(target) WHERE t - seconds <= target),
b AS (SELECT conv_id, target, min({'gap': abs(t - target), 'n': n, 's': t}) AS m FROM x GROUP BY 1, 2)
SELECT conv_id, target, m.n AS segments, m.s AS seconds FROM b""",
)
def wn07(spark, sf_dir):
    segments = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("seconds"))
    return windows.prefix_closest(segments, ["conv_id"], [200, 1000, 2500], order="turn")


_QUIET = """q AS (SELECT recording_id, frame_idx, frame_idx - max(CASE WHEN {active} THEN frame_idx END)
  OVER (PARTITION BY recording_id ORDER BY frame_idx) AS quiet FROM {source})"""


@query(
    "wn08_silence_endpoints",
    f"WITH {sql.FRAMES}, {_QUIET.format(active='prob >= 15e-2', source='frames')} SELECT recording_id, frame_idx FROM q WHERE quiet = 4",
)
def wn08(spark, sf_dir):
    return windows.silence_endpoints(frames(spark, sf_dir), REC, threshold=0.15, min_silence_ms=100)


LABELS_SQL = f"{sql.FRAMES}, labelled AS (SELECT *, floor(prob * 8)::INT AS label FROM frames)"


def _labelled(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).withColumn("label", F.floor(F.col("prob") * 8).cast("int"))


@query(
    "wn09_blank_endpoints",
    f"WITH {LABELS_SQL}, {_QUIET.format(active='label <> 0', source='labelled')} SELECT recording_id, frame_idx FROM q WHERE quiet = 5",
)
def wn09(spark, sf_dir):
    return windows.blank_endpoints(_labelled(spark, sf_dir), REC, run=5)


@query(
    "wn10_collapse_labels",
    f"""WITH {LABELS_SQL}, c AS (SELECT *, lag(label) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS p FROM labelled)
SELECT recording_id, frame_idx, label FROM c WHERE label IS DISTINCT FROM p AND label <> 0""",
)
def wn10(spark, sf_dir):
    return windows.collapse_labels(_labelled(spark, sf_dir), REC).select("recording_id", "frame_idx", "label")


@query(
    "wn11_first_subtoken_labels",
    f"{W} SELECT recording_id, word_idx, CASE WHEN length(word) > 3 THEN length(word) % 7 ELSE 0 END AS label FROM words",
)
def wn11(spark, sf_dir):
    rows = words(spark, sf_dir).select("recording_id", "word_idx", "word")
    parts = rows.filter(F.length("word") > 3).select(
        "recording_id", "word_idx", F.length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("p")
    )
    subtokens = parts.select(
        "recording_id",
        "word_idx",
        (F.col("word_idx") * 1000 + F.col("p")).alias("position"),
        F.when(F.col("p") == 0, F.col("n") % 7).otherwise(9).alias("label"),
    )
    return windows.first_subtoken_labels(rows, subtokens, REC).select("recording_id", "word_idx", "label")


def _samples(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("sample_idx", "x"))
    return vectors.select("vec_id", "sample_idx", F.round(F.col("x").cast("double") * 32768).cast("bigint").alias("value"))


_SAMPLES = "samples AS (SELECT vec_id, unnest(range(len(embedding))) AS sample_idx, unnest(list_transform(embedding, lambda v: round(v::DOUBLE * 32768)::BIGINT)) AS value FROM embeddings)"


@query(
    "wn12_energy_onset",
    f"""WITH {_SAMPLES}, p AS (SELECT vec_id, max(abs(value)) AS peak FROM samples GROUP BY 1),
f AS (SELECT vec_id, sample_idx // 4 AS frame, sqrt(sum(value * value)::DOUBLE / count(*)) AS rms FROM samples GROUP BY 1, 2)
SELECT p.vec_id, min(CASE WHEN rms >= greatest(6000e0, peak * 2e-2) THEN frame END) * 4 / 16000e0 AS onset_s
FROM p JOIN f ON f.vec_id = p.vec_id GROUP BY 1""",
)
def wn12(spark, sf_dir):
    return windows.energy_onset(_samples(spark, sf_dir), ["vec_id"], frame=4, floor=6000.0)


@query(
    "wn13_boundary_levels",
    f"""WITH {_SAMPLES}, o AS (SELECT vec_id, sqrt(sum(value * value)::DOUBLE / count(*)) AS overall FROM samples GROUP BY 1),
n AS (SELECT vec_id, cut, sqrt(sum(value * value)::DOUBLE / count(*)) AS rms FROM samples, (VALUES (16), (32), (48)) c(cut)
  WHERE sample_idx >= cut - 5 AND sample_idx < cut + 5 GROUP BY 1, 2)
SELECT n.vec_id, cut, round(rms / overall, 9) AS level FROM n JOIN o ON o.vec_id = n.vec_id WHERE overall > 0""",
)
def wn13(spark, sf_dir):
    cuts = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(F.lit(16), F.lit(32), F.lit(48))).alias("cut"))
    out = windows.boundary_levels(_samples(spark, sf_dir), cuts, ["vec_id"], probe=5, bucket=16)
    return out.withColumn("level", F.round("level", 9))


@query(
    "wn14_latest_speaker",
    """SELECT event_id, last_value(CASE WHEN event_type IN ('click', 'view') THEN length(event_type) END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS live_speaker FROM events""",
)
def wn14(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.when(kind.isin("click", "view"), F.length(kind)).alias("speaker")
    )
    rows, block = range_blocks(rows, ["user_id"], ["ts", "event_id"])
    out = windows.latest_speaker(rows, ["user_id"], ["ts", "event_id"], block)
    return out.select("event_id", "live_speaker")


@query(
    "wn16_balanced_blocks",
    f"""WITH RECURSIVE segments AS (SELECT conv_id, turn, length(text) / 40e0 AS seconds FROM conversations),
{sql.balanced_blocks("segments", 25, 1, 60)}
SELECT conv_id, block_idx, first_segment, last_segment, round(seconds, 6) AS seconds FROM blocks""",
)
def wn16(spark, sf_dir):
    segments = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 40.0).alias("seconds"))
    out = blocks.balanced_blocks(segments, ["conv_id"], "turn", target=25.0, min_len=1.0, max_len=60.0)
    return out.withColumn("seconds", F.round("seconds", 6))


@query(
    "jn03_assign_speakers",
    f"""{W}, {sql.TURNS}, shifted AS (SELECT recording_id, turn_idx, start - 5e-1 AS s, "end" - 1e0 AS e, speaker AS sp FROM turns),
hits AS (SELECT w.recording_id, w.word_idx, min({{'t': turn_idx, 'sp': sp}}) AS h FROM words w JOIN shifted t ON t.recording_id = w.recording_id
  AND t.s <= (w.start + w."end") / 2 AND t.e >= (w.start + w."end") / 2 GROUP BY 1, 2)
SELECT w.recording_id, w.word_idx, h.h.sp AS speaker FROM words w LEFT JOIN hits h ON h.recording_id = w.recording_id AND h.word_idx = w.word_idx""",
)
def jn03(spark, sf_dir):
    # Turns are shifted and shortened so that some words match two turns and some none.
    shifted = turns(spark, sf_dir).withColumns({"start": F.col("start") - 0.5, "end": F.col("end") - 1.0})
    out = ops.assign_speakers(words(spark, sf_dir), shifted, REC)
    return out.select("recording_id", "word_idx", "speaker")


@query(
    "jn04_remap_compressed",
    f"""WITH {regions_sql(*VAD_SQL)}, laid AS (SELECT *, sum("end" - start) OVER (PARTITION BY recording_id ORDER BY region_idx)
  - ("end" - start) AS acc FROM regions),
pts AS (SELECT recording_id, frame_idx, frame_idx * 2e-2 AS t, frame_idx * 2e-2 * 16000 AS target FROM frames),
hit AS (SELECT p.recording_id, p.frame_idx, min({{'r': region_idx, 's': (start + (target - acc)) / 16000e0}}) AS h FROM pts p JOIN laid l
  ON l.recording_id = p.recording_id AND target <= acc + ("end" - start) GROUP BY 1, 2),
lastr AS (SELECT recording_id, max("end") / 16000e0 AS e FROM regions GROUP BY 1)
SELECT p.recording_id, p.frame_idx, round(coalesce(h.h.s, e, t), 6) AS original_s FROM pts p LEFT JOIN hit h
  ON h.recording_id = p.recording_id AND h.frame_idx = p.frame_idx LEFT JOIN lastr ON lastr.recording_id = p.recording_id""",
)
def jn04(spark, sf_dir):
    rows = frames(spark, sf_dir)
    points = rows.select("recording_id", "frame_idx", (F.col("frame_idx") * 0.02).alias("t"))
    out = ops.remap_compressed(points, windows.speech_regions(rows, REC, **VAD), REC, "t")
    return out.select("recording_id", "frame_idx", F.round("original_s", 6).alias("original_s"))


@query(
    "ag11_mean_confidence",
    f"""{W} SELECT recording_id, turn, round(sum(confidence * greatest("end" - start, 0)) / sum(greatest("end" - start, 0)), 6) AS confidence
FROM words GROUP BY 1, 2""",
)
def ag11(spark, sf_dir):
    out = ops.mean_confidence(words(spark, sf_dir), ["recording_id", "turn"])
    return out.withColumn("confidence", F.round("confidence", 6))


def _channels(spark, sf_dir) -> DataFrame:
    rows = words(spark, sf_dir)
    first = rows.filter("speaker = 0").drop("speaker")
    second = rows.filter("speaker <> 0").drop("speaker").withColumns({"start": F.col("start") - 3.0, "end": F.col("end") - 3.0})
    return ops.union_channels([first, second])


_CHANNELS = f"""{sql.WORDS},
ch AS (SELECT recording_id, word_idx, word, confidence, start, "end", 0 AS speaker FROM words WHERE speaker = 0
  UNION ALL SELECT recording_id, word_idx, word, confidence, start - 3e0, "end" - 3e0, 1 FROM words WHERE speaker <> 0)"""


@query("se02_union_channels", f"WITH {_CHANNELS} SELECT recording_id, speaker, count(*) AS n, min(start) AS first_start FROM ch GROUP BY 1, 2")
def se02(spark, sf_dir):
    rows = _channels(spark, sf_dir)
    return rows.groupBy("recording_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


@query(
    "ag12_merge_channels",
    f"""WITH {_CHANNELS} SELECT recording_id, 0 AS part, string_agg(word, ' ' ORDER BY start, speaker, word_idx) AS text, max("end") AS duration_s,
  count(*) AS n_words, round(sum(confidence * greatest("end" - start, 0)) / sum(greatest("end" - start, 0)), 6) AS confidence FROM ch GROUP BY 1""",
)
def ag12(spark, sf_dir):
    out = ops.merge_channels(_channels(spark, sf_dir), REC)
    return out.withColumn("confidence", F.round("confidence", 6))


_PAIRS = """pairs AS (SELECT l.vec_id // 2 AS recording_id, unnest(l.embedding)::DOUBLE AS a, unnest(r.embedding)::DOUBLE AS b
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0),
c AS (SELECT recording_id, round(coalesce(corr(a, b), 0e0), 9) AS correlation FROM pairs GROUP BY 1)"""


@query(
    "ag14_dual_mono",
    f"WITH {_PAIRS} SELECT recording_id, correlation, correlation > 98e-2 AS dual_mono FROM c",
)
def ag14(spark, sf_dir):
    return scoring.dual_mono(channel_pairs(spark, sf_dir), REC).withColumn("correlation", F.round("correlation", 9))


@query(
    "fl11_mono_fallback",
    f"""WITH {_PAIRS} SELECT recording_id, CASE recording_id % 4 WHEN 0 THEN 'no channels' WHEN 1 THEN 'mono audio' WHEN 3 THEN 'more than two channels'
  ELSE CASE WHEN correlation > 98e-2 THEN 'dual-mono audio' END END AS reason FROM c""",
)
def fl11(spark, sf_dir):
    rows = scoring.dual_mono(channel_pairs(spark, sf_dir), REC)
    reason = predicates.mono_fallback_reason(F.col("recording_id") % 4, F.col("correlation"))
    return rows.select("recording_id", reason.alias("reason"))


@query(
    "fl08_context_suppression",
    f"{W} SELECT recording_id, word_idx FROM words WHERE start >= turn * 3e0 + 15e-1",
)
def fl08(spark, sf_dir):
    rows = words(spark, sf_dir)
    return rows.filter(predicates.outside_context(F.col("start"), F.col("turn") * 3.0, 1.5)).select("recording_id", "word_idx")


@query(
    "fl07_oversize",
    "SELECT doc_id, n_chars / 100e0 > 30 AS oversize FROM documents",
)
def fl07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", predicates.is_oversize(F.col("n_chars") / 100.0).alias("oversize"))


@query(
    "tx20_ids_to_text",
    """WITH v AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: floor(x * 40)::INT + 20)) AS id, unnest(range(len(embedding))) AS p FROM embeddings)
SELECT vec_id, 0 AS part, trim(string_agg(CASE WHEN id = 20 THEN '' WHEN id % 3 = 0 THEN ' p' || id ELSE 'p' || id END, '' ORDER BY p)) AS text
FROM v WHERE id BETWEEN 0 AND 39 AND id NOT IN (20, 21) GROUP BY 1""",
)
def tx20(spark, sf_dir):
    # Whole numbers would make the product double, in which a value next to a boundary falls on the other side of it.
    forty = F.lit(40).cast("float")
    ids = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(F.transform("embedding", lambda x: F.floor(x * forty).cast("int") + 20)).alias("tok_idx", "token_id")
    )
    # The vocabulary: forty pieces, 20 blank, 21 unknown, every third one opening a word.
    number = F.col("id").cast("int")
    vocab = spark.range(40).select(
        number.alias("token_id"),
        F.when(number == 21, "<unk>")
        .when(number % 3 == 0, F.concat(F.lit("▁p"), number))
        .otherwise(F.concat(F.lit("p"), number))
        .alias("piece"),
    )
    return ops.ids_to_text(ids, vocab, ["vec_id"], blank_id=20)


