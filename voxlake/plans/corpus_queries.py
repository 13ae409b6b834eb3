"""Queries for corpus preparation, files, audio and model runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import numbers, predicates
from voxlake.operators import audio, corpus, vocab
from voxlake.operators.joins import lookup_join
from voxlake.plans import sql
from voxlake.plans.registry import query
from voxlake.plans.relations import table
from voxlake.session import scratch_path
from voxlake.sources import files, manifests, messages, sinks
from voxlake.sources.document_files import write_files
from voxlake.sources.message_log import read_message_log
from voxlake.sources.wav_headers import read_wav_headers

HEADER = {"dataset": "documents", "audio_root": "/audio/documents", "slice_seed": 42, "license": "CC0", "source": "driver"}


def _samples(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.concat(F.when(F.col("doc_id") % 7 == 0, "/abs/").otherwise(""), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".wav")).alias("filename"),
        F.when(F.col("n_chars") % 5 == 0, " \t ").otherwise(F.col("text")).alias("reference"),
        (F.col("n_chars") / 15.0).alias("duration"),
    )


_SAMPLES = """s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '/abs/' ELSE '/audio/documents/' END || source || '/' || doc_id || '.wav' AS filename,
  CASE WHEN n_chars % 5 = 0 THEN '' ELSE text END AS reference, n_chars / 15e0 AS duration, n_chars, source FROM documents)"""


@query(
    "sc01_sc12_manifest_round_trip",
    f"WITH {_SAMPLES} SELECT filename, md5(CASE WHEN n_chars % 5 = 0 THEN ' ' || chr(9) || ' ' ELSE reference END) AS digest, round(duration, 6) AS duration, 'documents' AS dataset FROM s",
)
def sc01(spark, sf_dir):
    path = scratch_path(spark, "manifests")
    manifests.write_manifest(_samples(spark, sf_dir), path, HEADER, order="doc_id", shard=500)
    back = manifests.read_manifest(spark, path)
    return back.select("filename", F.md5("reference").alias("digest"), F.round("duration", 6).alias("duration"), "dataset")


@query(
    "sc02_empty_references",
    f"WITH {_SAMPLES} SELECT source, count(*) AS samples, count_if(n_chars % 5 = 0) AS skipped_empty_refs FROM s GROUP BY 1",
)
def sc02(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumn("source", F.regexp_extract("filename", r"([^/]*)/[^/]*$", 1))
    _, counts = manifests.drop_empty_references(rows, ["source"])
    return counts


@query(
    "sc03_scan_corpora",
    """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 IN (0, 1) THEN 'ready' ELSE 'unreadable' END AS status,
  CASE doc_id % 5 WHEN 2 THEN 'manifest has no audio_root' WHEN 3 THEN 'manifest samples[] is empty' WHEN 4 THEN 'parse failed' END AS reason,
  CASE WHEN doc_id % 5 IN (0, 1) THEN 2 - doc_id % 5 END AS clips, CASE WHEN doc_id % 5 IN (0, 1) THEN 1 + doc_id % 5 END AS malformed FROM documents""",
)
def sc03(spark, sf_dir):
    kind = F.col("doc_id") % 5
    name = F.concat(F.lit('{"filename": "'), F.col("source"), F.lit('.wav"}'))
    entries = F.concat_ws(", ", name, F.when(kind == 0, name).otherwise('{"filename": ""}'), F.lit('{"reference": "x"}'))
    value = (
        F.when(kind <= 1, F.concat(F.lit('{"audio_root": "/a", "samples": ['), entries, F.lit("]}")))
        .when(kind == 2, '{"samples": [{"filename": "a.wav"}]}')
        .when(kind == 3, '{"audio_root": "/a", "samples": []}')
        .otherwise("{not json")
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), value.alias("value"))
    return manifests.scan_corpora(rows)


@query(
    "sc04_csv_manifest",
    """SELECT o_orderkey || '.wav' AS wav, o_orderpriority || ', "x"' AS txt, o_totalprice AS duration FROM orders WHERE o_orderstatus <> 'P'""",
)
def sc04(spark, sf_dir):
    line = F.concat(
        F.lit(" "), F.col("o_orderkey"), F.lit('.wav ,"'), F.col("o_orderpriority"), F.lit(', ""x""", '), F.col("o_totalprice").cast("string")
    )
    value = F.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit(",extra"))).otherwise(line)
    return manifests.parse_csv_manifest(table(spark, sf_dir, "orders").select(value.alias("value")))


@query(
    "sc05_jn01_transcript_join",
    """SELECT doc_id::VARCHAR AS utt_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest, '/audio/' || doc_id || '.flac' AS path
FROM documents JOIN labels USING (doc_id) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""",
)
def sc05(spark, sf_dir):
    body = F.regexp_replace("text", r"\s+", " ")
    lines = table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), body).alias("value"))
    audio_files = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("utt_id"), F.concat(F.lit("/audio/"), F.col("doc_id"), F.lit(".flac")).alias("path")
    )
    joined = manifests.join_references(manifests.parse_transcript_lines(lines), audio_files)
    return joined.select("utt_id", F.md5("reference").alias("digest"), "path")


@query(
    "sc05_transcript_layouts",
    """SELECT '/c/' || c_custkey || '.wav' AS audio, c_name || ' ' || c_mktsegment AS reference FROM customer WHERE c_custkey % 3 <> 0""",
)
def sc05_layouts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    text = F.concat_ws(" ", "c_name", "c_mktsegment")
    tsv = rows.select(
        F.lit("/c/list.tsv").alias("path"),
        F.col("c_custkey").alias("line_no"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("\t", F.concat("c_custkey", F.lit(".wav")), text))
        .otherwise(F.concat_ws("\t", text, F.concat("c_custkey", F.lit(".wav"))))
        .alias("value"),
    )
    txt = rows.select(F.concat(F.lit("/c/"), F.col("c_custkey"), F.lit(".txt")).alias("path"), F.lit(0).cast("bigint").alias("line_no"), F.lit("other").alias("value"))
    found = rows.filter(F.col("c_custkey") % 3 != 0).select(F.concat(F.lit("/c/"), F.col("c_custkey"), F.lit(".wav")).alias("path"))
    return manifests.find_transcripts(tsv.unionByName(txt), found)


def _clips(spark, sf_dir) -> DataFrame:
    """Vectors as WAV clips."""
    values = F.transform("embedding", lambda v: F.round(v.cast("double") * 32767).cast("bigint"))
    clips = table(spark, sf_dir, "embeddings").select("vec_id", "label", values.alias("values"))
    return clips.withColumn("content", files.wav_bytes(F.col("values"), 8000, 2))


@query(
    "sc06_sc09_wav_header",
    "SELECT vec_id AS id, label::VARCHAR AS reference, 8000 AS rate, 2 AS channels, len(embedding) // 2 AS frames, len(embedding) // 2 / 8000e0 AS seconds FROM embeddings",
)
def sc09(spark, sf_dir):
    shards = _clips(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"), F.struct(F.col("content").alias("bytes")).alias("audio")
    )
    path = scratch_path(spark, "speech")
    shards.write.parquet(path)
    header = manifests.read_speech_shards(spark, path).withColumn("h", files.wav_header(F.col("content")))
    return header.select("id", "reference", "h.rate", "h.channels", "h.frames", (F.col("h.frames") / F.col("h.rate")).alias("seconds"))


@query(
    "sc07_sc09_wav_files",
    """SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 8000 * (1 + vec_id % 3) END AS rate, CASE WHEN vec_id % 7 <> 0 THEN 1 + vec_id % 2 END AS channels,
  CASE WHEN vec_id % 7 <> 0 THEN vec_id * 11 // (2 * (1 + vec_id % 2)) END AS frames, 52 + vec_id % 9000 + vec_id % 2 + 2 * len(embedding) AS len FROM embeddings""",
)
def sc09_files(spark, sf_dir):
    """Files with a comment chunk of up to 9,000 bytes, some with the data before the format, some of another container."""
    number = files._little_endian
    vec, padded = F.col("vec_id"), F.col("vec_id") % 9000
    channels = 1 + vec % 2
    comment = F.concat(F.lit("4C495354"), number(padded, 4), F.repeat(F.lit("20"), (padded + vec % 2).cast("int")))
    form = F.concat(
        F.lit("666D7420"), number(F.lit(16), 4), number(F.lit(1), 2), number(channels, 2), number(8000 * (1 + vec % 3), 4),
        number(16000 * (1 + vec % 3) * channels, 4), number(2 * channels, 2), number(F.lit(16), 2),
    )
    samples = F.array_join(F.transform("embedding", lambda v: number(F.round(v * 32767).cast("bigint"), 2)), "")
    long = F.concat(F.lit("64617461"), number(vec * 11, 4), samples)  # says more than there is, as recorders that were cut off do
    magic = F.when(vec % 7 == 0, "4F676753").otherwise("52494646")
    first = vec % 5 == 0
    body = F.when(first, F.concat(form, comment, long)).otherwise(F.concat(comment, form, long))
    whole = F.concat(magic, F.lit("00000000"), F.lit("57415645"), body)
    clips = table(spark, sf_dir, "embeddings").select(F.concat(vec.cast("string"), F.lit(".wav")).alias("output"), F.unhex(whole).alias("document"))
    path = scratch_path(spark, "clips")
    write_files(clips, path, [])
    name = F.regexp_extract("path", r"([^/]*)\.wav$", 1).cast("bigint")
    return read_wav_headers(spark, path).select(name.alias("vec_id"), "rate", "channels", "frames", "len")


def _listing(spark, sf_dir) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, ["wav", "MP3", "txt", "Flac", "json", "webm"])), (F.col("doc_id") % 6).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("."), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("len"), F.lit(0).alias("mtime"))


_LISTING = "l AS (SELECT doc_id, '/in/' || lang || '/' || source || '.' || ['wav', 'MP3', 'txt', 'Flac', 'json', 'webm'][doc_id % 6 + 1] AS path FROM documents)"


@query("sc07_audio_files", f"WITH {_LISTING} SELECT doc_id, path FROM l WHERE doc_id % 6 NOT IN (2, 4) AND path NOT LIKE '/in/de/%'")
def sc07(spark, sf_dir):
    return files.audio_files(_listing(spark, sf_dir), exclude="/in/de").select("doc_id", "path")


@query(
    "sc14_duplicate_outputs",
    f"""WITH {_LISTING}, o AS (SELECT unnest([regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '.srt', regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '.txt']) AS output FROM l)
SELECT output, count(*) AS inputs FROM o GROUP BY 1 HAVING count(*) > 1""",
)
def sc14(spark, sf_dir):
    return sinks.duplicate_outputs(_listing(spark, sf_dir), ["srt", "txt"])


@query(
    "sc08_sniff_container",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp3' WHEN 2 THEN 'flac' WHEN 3 THEN 'ogg' ELSE 'wav' END AS container FROM documents",
)
def sc08(spark, sf_dir):
    kind = F.col("doc_id") % 5
    magic = F.when(kind == 0, "RIFF----WAVE").when(kind == 1, "ID3").when(kind == 2, "fLaC").when(kind == 3, "OggS").otherwise("")
    content = F.concat(magic, F.lit("\x00"), F.col("text")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", files.sniff_container(content).alias("container"))


@query(
    "sc10_pcm_frames",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents), e AS (SELECT *, unnest(range(0, (n + 3199) // 3200)) AS chunk_idx FROM d WHERE n > 0)
SELECT doc_id, chunk_idx, least(3200, n - chunk_idx * 3200) AS n_bytes, md5(substring(h, chunk_idx * 6400 + 1, 6400)) AS digest FROM e""",
)
def sc10(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    framed = files.pcm_frames(rows, "pcm")
    return framed.select(
        "doc_id", "chunk_idx", F.octet_length("frame").cast("bigint").alias("n_bytes"), F.md5(F.hex("frame")).alias("digest")
    )


@query(
    "sc11_seeded_slice",
    "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 150",
)
def sc11(spark, sf_dir):
    return manifests.seeded_slice(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", seed=42, n=150)


@query(
    "sc13_document_sink",
    "SELECT 'format=txt' AS format, role, count(*) AS documents, sum(length(replace(text, chr(10), ' ')))::BIGINT AS n_chars, min(md5(replace(text, chr(10), ' '))) AS first_digest, max(md5(replace(text, chr(10), ' '))) AS last_digest FROM conversations GROUP BY 2",
)
def sc13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.lit("txt").alias("format"), F.col("role").alias("output"), F.lit(0).alias("part"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("document")
    )
    path = scratch_path(spark, "documents")
    sinks.write_documents(rows, path)
    back = spark.read.text(path)
    return back.groupBy(F.concat(F.lit("format="), F.col("format")).alias("format"), F.col("output").alias("role")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("value")).alias("n_chars"),
        F.min(F.md5("value")).alias("first_digest"), F.max(F.md5("value")).alias("last_digest"),
    )


@query(
    "sc15_messages",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'partial' WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'error' END AS type, event_type || user_id AS text FROM events WHERE event_type IN ('view', 'purchase', 'error')",
)
def sc15(spark, sf_dir):
    kind = F.col("event_type")
    tagged = F.when(kind == "view", "partial").when(kind == "purchase", "final").when(kind == "error", "error").otherwise("other")
    line = F.to_json(F.struct(tagged.alias("type"), F.concat(kind, F.col("user_id")).alias("text"), F.lit(1).alias("extra")))
    value = F.when(kind == "signup", "{broken").otherwise(line)
    return messages.parse_messages(table(spark, sf_dir, "events").select("event_id", value.alias("value"))).select("event_id", "type", "text")


@query(
    "sc15_message_log",
    """SELECT CASE role WHEN 'user' THEN 'partial' WHEN 'assistant' THEN 'final' ELSE 'unknown' END AS kind, count(*) AS messages,
  count(DISTINCT conv_id) AS sessions, sum(length(text))::BIGINT AS n_chars, max(md5(text)) AS last_digest FROM conversations WHERE turn % 5 <> 4 GROUP BY 1
UNION ALL SELECT 'undecodable', count(*), 0, 0, NULL FROM conversations WHERE turn % 5 = 4 HAVING count(*) > 0""",
)
def sc15_log(spark, sf_dir):
    """Turns as event lines in log files, read as a stream; what is no message is counted, not lost."""
    kind = F.when(F.col("role") == "user", "partial").when(F.col("role") == "assistant", "final").otherwise("other")
    message = F.to_json(F.struct(kind.alias("type"), "text", F.col("conv_id").cast("string").alias("code")))
    line = F.when(F.col("turn") % 5 == 4, "data: {broken").when(F.col("turn") % 2 == 0, F.concat(F.lit("data: "), message)).otherwise(message)
    path = scratch_path(spark, "log")
    table(spark, sf_dir, "conversations").select(line.alias("value")).write.text(path)
    out = scratch_path(spark, "messages")
    writer = read_message_log(spark, path, range_bytes=1 << 22).writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("kind string, text string, code string").parquet(out)
    return back.groupBy("kind").agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("code").alias("sessions"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.max(F.md5("text")).alias("last_digest"),
    )


@query(
    "fl02_fl03_community_filter",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 10 END >= coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 8 END, 0)
  AND strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01'""",
)
def fl02(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")).alias("sentence"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 10).alias("up"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 8).alias("down"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
    )
    valid = rows.filter(predicates.is_community_valid(F.col("sentence"), F.col("up"), F.col("down")))
    return predicates.with_date_floor(valid, "1996-01-01").select("o_orderkey")


@query("fl04_prefer_split", "SELECT page_id FROM pages WHERE contains(url, '/de/')")
def fl04(spark, sf_dir):
    return predicates.prefer_split(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), "/de/").select("page_id")


@query("fl04_prefer_split_fallback", "SELECT page_id FROM pages")
def fl04_fallback(spark, sf_dir):
    return predicates.prefer_split(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), "/zz-none/").select("page_id")


_KEY = "sha256('engine|beam=1|' || sha256({t}))"


@query(
    "jn05_se03_cache",
    f"""WITH c AS (SELECT DISTINCT {_KEY.format(t='d.text')} AS k FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
SELECT doc_id, {_KEY.format(t='text')} AS cache_key, c.k IS NOT NULL AS cached FROM documents LEFT JOIN c ON c.k = {_KEY.format(t='text')}""",
)
def jn05(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("cache_key", corpus.cache_key("engine", "beam=1", F.col("text")))
    stored = docs.join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("cache_key").distinct()
    out = corpus.with_cache(docs.select("doc_id", "cache_key"), stored, lambda fresh: fresh)
    return out.select("doc_id", "cache_key", "cached")


@query(
    "jn07_snapshot_diff",
    """WITH b AS (SELECT doc_id, n_chars FROM documents WHERE source <> 'src1'),
a AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE lang <> 'de')
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'vanished' WHEN a.n_chars = b.n_chars THEN 'unchanged' ELSE 'changed' END AS state
FROM b FULL JOIN a ON a.doc_id = b.doc_id""",
)
def jn07(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("len"), F.lit(0).alias("mtime"), "source", "lang")
    after = docs.filter("lang <> 'de'").withColumn("len", F.when(F.col("len") % 3 == 0, F.col("len") + 1).otherwise(F.col("len")))
    return files.snapshot_diff(docs.filter("source <> 'src1'"), after)


@query(
    "jn08_dictionary_join",
    f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split({sql.spelled('o_orderkey')}, ' ')) AS w FROM orders) GROUP BY 1",
)
def jn08(spark, sf_dir):
    words = table(spark, sf_dir, "orders").select(F.explode(F.split(numbers.number_to_words(F.col("o_orderkey")), " ")).alias("word"))
    dictionary = spark.createDataFrame([(w, v) for w, (v, _) in numbers.number_words(True).items()], "word string, value bigint")
    feminine = spark.createDataFrame([("ноль", 0)], "word string, value bigint")
    known = dictionary.unionByName(feminine).dropDuplicates(["word"])
    return lookup_join(words, known, "word", "inner").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn11_duplicate_contents",
    """WITH g AS (SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT g.digest, d.doc_id AS path, g.copies, g.keeper FROM documents d JOIN g ON g.digest = sha256(d.text)""",
)
def jn11(spark, sf_dir):
    return corpus.duplicate_contents(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


_CLIPS = """c AS (SELECT lang, doc_id, n_chars / 15e0 AS seconds, CASE WHEN n_chars % 11 = 0 THEN 'malformed' WHEN n_chars % 7 = 0 THEN 'undecodable' WHEN n_chars % 3 = 0 THEN 'decoded' ELSE 'probed' END AS outcome FROM documents)"""


def _measured(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    outcome = F.when(n % 11 == 0, "malformed").when(n % 7 == 0, "undecodable").when(n % 3 == 0, "decoded").otherwise("probed")
    return table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("path"), (n / 15.0).alias("seconds"), outcome.alias("outcome"))


@query(
    "ag15_scan_rollup",
    f"""WITH {_CLIPS} SELECT lang, count(*) AS clips, count_if(outcome = 'probed') AS probed, count_if(outcome = 'decoded') AS decoded, count_if(outcome = 'undecodable') AS undecodable,
  count_if(outcome = 'malformed') AS malformed, max(CASE WHEN outcome IN ('probed', 'decoded') THEN seconds END) AS max_seconds,
  count_if(outcome IN ('probed', 'decoded') AND seconds > 30) AS over, true AS accounted FROM c GROUP BY 1""",
)
def ag15(spark, sf_dir):
    return corpus.scan_rollup(_measured(spark, sf_dir), ["lang"])


@query("tk03_nearest_threshold", f"WITH {_CLIPS} SELECT doc_id AS path, seconds FROM c ORDER BY abs(seconds - 30), doc_id LIMIT 24")
def tk03(spark, sf_dir):
    return corpus.nearest_threshold(_measured(spark, sf_dir)).select("path", "seconds")


class UpperCaseModel:
    """A stand-in engine: upper-cases the text, fails on texts of one language."""

    def __call__(self, text: str, lang: str) -> tuple[str, float]:
        if lang == "de":
            raise RuntimeError("worker panicked")
        return text.upper() if lang == "en" else text, len(text) / 64.0


@query(
    "ud01_st16_model_run",
    f"""WITH d AS (SELECT text, min(lang) AS lang FROM documents GROUP BY 1), u AS (SELECT {_KEY.format(t='text')} AS cache_key, text, lang FROM d)
SELECT cache_key, CASE WHEN lang = 'de' THEN 0e0 ELSE length(text) / 64e0 END AS proc_sec, CASE WHEN lang = 'de' THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN lang = 'de' THEN 'worker panicked' END AS error, CASE WHEN lang = 'de' THEN 3 ELSE 1 END AS attempts, false AS cached FROM u""",
)
def ud01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("lang").alias("lang"))
    out = corpus.transcribe_table(docs, UpperCaseModel, engine="engine", config="beam=1", content="text", columns=["text", "lang"], retries=2)
    return out.drop("text")


def _letters() -> dict[str, int]:
    pieces = ["[UNK]", *".,!?;:'\"()-"]
    latin = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    pieces += latin + [f"##{c}" for c in latin] + ["##tion", "the"]
    return {p: i for i, p in enumerate(pieces)}


_SPLIT = f"""(SELECT doc_id, unnest({sql.words("regexp_replace(regexp_replace(text, '[\\x{00AD}\\x{200B}-\\x{200F}\\x{FEFF}]', '', 'g'), '([\\p{P}$+<=>^`|~])', ' \\1 ', 'g')")}) AS w FROM documents)"""


@query(
    "tx21_subword_counts",
    f"""WITH t AS {_SPLIT},
s AS (SELECT doc_id, w, length(w) <= 100 AND regexp_full_match(w, '[A-Za-z]+') AS latin, length(w) = 1 AND contains('.,!?;:\'\'"()-', w) AS mark FROM t),
k AS (SELECT doc_id, CASE WHEN latin THEN length(w) - CASE WHEN starts_with(w, 'the') THEN 2 ELSE 0 END - 3 * len(regexp_extract_all(CASE WHEN starts_with(w, 'the')
  THEN w[4:] ELSE w[2:] END, 'tion')) ELSE 1 END AS n, NOT latin AND NOT mark AS unk FROM s)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens, count(n) AS n_words, coalesce(count_if(unk), 0) AS n_unknown FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""".replace(
        "\\'\\'", "''"
    ),
)
def tx21(spark, sf_dir):
    return vocab.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _letters())


@query("tx21_subword_tokens")
def tx21_tokens(spark, sf_dir):
    tokens = vocab.subword_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", _letters())
    return tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tx19_phrase_pieces",
    """WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '\\s', '', 'g') AS s FROM part)
SELECT p_partkey, len(s) AS n_pieces,
  array_to_string(list_transform(string_split(s, ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz0123456789#-_.,', c) - 1), ' ') AS pieces FROM p""",
)
def tx19(spark, sf_dir):
    known = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789#-_.,")}
    found = vocab.phrase_to_pieces(F.col("p_name"), known)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", found.alias("f"))
    return rows.select("p_partkey", F.size("f.pieces").cast("bigint").alias("n_pieces"), F.array_join("f.pieces", " ").alias("pieces"))


def _pcm(spark, sf_dir) -> DataFrame:
    """Document bytes as a PCM16 stream that arrives in frames of 777 bytes."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"))
    size = 777
    last = F.floor((F.octet_length("pcm") - 1) / size)
    cut = rows.filter(F.octet_length("pcm") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return cut.select("doc_id", "chunk_idx", F.substring(F.col("pcm"), (F.col("chunk_idx") * size + 1).cast("int"), F.lit(size)).alias("content"))


@query(
    "tx32_decode_pcm16",
    "SELECT doc_id, (strlen(text) // 2)::BIGINT AS n_samples FROM documents WHERE strlen(text) > 1",
)
def tx32(spark, sf_dir):
    decoded = audio.decode_pcm16(_pcm(spark, sf_dir), ["doc_id"])
    return decoded.groupBy("doc_id").agg(F.sum(F.size("samples")).alias("n_samples"))


@query(
    "tx31_mel_features",
    "SELECT doc_id, CASE WHEN strlen(text) // 2 < 320 THEN 1 ELSE (strlen(text) // 2 - 320) // 160 + 1 END AS n_frames, 64 AS width FROM documents WHERE strlen(text) > 1",
)
def tx31(spark, sf_dir):
    blocks = audio.sample_blocks(audio.decode_pcm16(_pcm(spark, sf_dir), ["doc_id"]), ["doc_id"])
    mel = audio.mel_features(blocks, ["doc_id"])
    return mel.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("mel")).alias("width"))


@query(
    "tx33_mix_resample",
    """WITH p AS (SELECT l.vec_id // 2 AS recording_id, list_transform(list_zip(l.embedding, r.embedding), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2) AS m
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0),
s AS (SELECT recording_id, list_transform(range(0, 2 * len(m)), lambda i: trunc(greatest(least(CASE WHEN i % 2 = 0 THEN m[i // 2 + 1] WHEN i = 2 * len(m) - 1 THEN m[-1]
  ELSE (m[i // 2 + 1] + m[i // 2 + 2]) / 2 END, 1), -1) * 32767)::INT) AS v FROM p)
SELECT recording_id, len(v) AS n_samples, list_max(v)::INT AS peak, list_min(v)::INT AS low FROM s""",
)
def tx33(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    left = vectors.filter("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("recording_id"), F.col("x").alias("l"))
    right = vectors.filter("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("recording_id"), F.col("x").alias("r"))
    mixed = left.join(right, "recording_id").select("recording_id", audio.mono_mix(F.col("l"), F.col("r")).alias("m"))
    pcm = mixed.select("recording_id", audio.resample_pcm16(F.col("m"), F.lit(8000)).alias("v"))
    return pcm.select(
        "recording_id",
        F.size("v").cast("bigint").alias("n_samples"),
        F.array_max("v").cast("int").alias("peak"),
        F.array_min("v").cast("int").alias("low"),
    )


