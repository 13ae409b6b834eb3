"""Queries that score transcripts: error rates, intervals, histograms, gates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import text, timing
from voxlake.functions.distance import word_edit_distance, word_overlap
from voxlake.functions.expr import words_of
from voxlake.operators import bootstrap, gates, quantiles, scoring
from voxlake.operators.joins import safe_join
from voxlake.plans import sql
from voxlake.plans.registry import query
from voxlake.plans.relations import table, utterances


def details(spark, sf_dir) -> DataFrame:
    """Score details of every utterance: normalized and verbatim errors, audio and processing seconds."""
    rows = utterances(spark, sf_dir)
    scored = scoring.score_pairs(
        rows.withColumns(
            {
                "naive_ref": text.normalize_verbatim(F.col("reference")),
                "naive_hyp": text.normalize_verbatim(F.col("hypothesis")),
            }
        )
    )
    scored = scoring.score_pairs(scored, "naive_ref", "naive_hyp", "naive_")
    return scored.select(
        F.concat(F.lit("turn"), F.col("turn")).alias("dataset"),
        F.when(F.size("ref") < F.size("hyp"), "long").otherwise("short").alias("engine"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_idx"),
        F.concat_ws("-", "conv_id", "turn").alias("file"),
        "conv_id",
        "turn",
        "errors",
        "ref_words",
        "wer",
        "naive_errors",
        "naive_ref_words",
        "naive_wer",
        F.size("hyp").cast("bigint").alias("hyp_words"),
        (F.size("ref") * 0.4).alias("audio_sec"),
        (F.length("hypothesis") * 0.01).alias("proc_sec"),
        (F.length("hypothesis") > 1200).alias("failed"),
        F.col("hypothesis").alias("text"),
    )


SCORED = f"""
{sql.utterances()},
naive AS (SELECT conv_id, turn, {sql.verbatim('reference')} AS nref, {sql.verbatim('hypothesis')} AS nhyp FROM utt),
scored AS (SELECT u.*, len(ref) AS ref_words, len(hyp) AS hyp_words, {sql.distance('ref', 'hyp')} AS errors,
  len(nref) AS naive_ref_words, {sql.distance('nref', 'nhyp')} AS naive_errors
  FROM utt u JOIN naive n ON n.conv_id = u.conv_id AND n.turn = u.turn),
details AS (SELECT 'turn' || turn AS dataset, CASE WHEN len(ref) < len(hyp) THEN 'long' ELSE 'short' END AS engine,
  conv_id * 1000 + turn AS sample_idx, conv_id || '-' || turn AS file, conv_id, turn, errors, ref_words,
  {sql.wer('errors', 'ref_words')} AS wer, naive_errors, naive_ref_words,
  {sql.wer('naive_errors', 'naive_ref_words')} AS naive_wer, hyp_words,
  len(ref) * 4e-1 AS audio_sec, length(hypothesis) * 1e-2 AS proc_sec, length(hypothesis) > 1200 AS failed,
  hypothesis AS text FROM scored)"""


@query(
    "tx09_word_errors",
    f"""WITH {sql.utterances()}, s AS (SELECT conv_id, turn, {sql.error_split('ref', 'hyp')} AS x FROM utt)
SELECT conv_id, turn, x.s AS sub, x.i AS ins, x.e AS del FROM s""",
)
def tx09(spark, sf_dir):
    return scoring.split_errors(utterances(spark, sf_dir)).select("conv_id", "turn", "sub", "ins", "del")


@query(
    "tx10_word_edit_distance",
    f"WITH {sql.utterances()} SELECT conv_id, turn, {sql.distance('ref', 'hyp')} AS errors FROM utt",
)
def tx10(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    return rows.select("conv_id", "turn", word_edit_distance(F.col("ref"), F.col("hyp")).cast("bigint").alias("errors"))


@query(
    "tx11_wer",
    f"WITH {SCORED} SELECT conv_id, turn, errors, ref_words, round(wer, 6) AS wer, round(naive_wer, 6) AS naive_wer FROM details",
)
def tx11(spark, sf_dir):
    return details(spark, sf_dir).select(
        "conv_id", "turn", "errors", "ref_words", F.round("wer", 6).alias("wer"), F.round("naive_wer", 6).alias("naive_wer")
    )


@query(
    "tx25_bucket_label",
    f"SELECT l_orderkey, l_linenumber, {sql.bucket('l_quantity', timing.DURATION_BUCKETS)} AS by_length, "
    f"{sql.bucket('l_quantity', timing.REF_WORD_BUCKETS)} AS by_words, "
    f"{sql.bucket('l_discount * 100', timing.WER_BUCKETS)} AS by_rate FROM lineitem",
)
def tx25(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        timing.bucket_label(F.col("l_quantity"), timing.DURATION_BUCKETS).alias("by_length"),
        timing.bucket_label(F.col("l_quantity"), timing.REF_WORD_BUCKETS).alias("by_words"),
        timing.bucket_label(F.col("l_discount") * 100, timing.WER_BUCKETS).alias("by_rate"),
    )


@query(
    "ag01_corpus_wer",
    f"""WITH {SCORED}, s AS (SELECT dataset, engine, count(*) AS samples, sum(errors)::BIGINT AS errors,
  sum(ref_words)::BIGINT AS ref_words, sum(naive_errors)::BIGINT AS naive_errors, sum(naive_ref_words)::BIGINT AS naive_ref_words
  FROM details GROUP BY 1, 2)
SELECT *, {sql.wer('errors', 'ref_words')} AS wer, {sql.wer('naive_errors', 'naive_ref_words')} AS naive_wer,
  {sql.wer('errors', 'ref_words')} - {sql.wer('naive_errors', 'naive_ref_words')} AS naive_delta FROM s""",
)
def ag01(spark, sf_dir):
    return scoring.corpus_wer(details(spark, sf_dir), ["dataset", "engine"])


@query(
    "ag01_corpus_wer_rollup",
    f"""WITH {SCORED}, s AS (SELECT dataset, engine, GROUPING(dataset, engine)::INT AS level, sum(errors)::BIGINT AS errors,
  sum(ref_words)::BIGINT AS ref_words FROM details GROUP BY ROLLUP (dataset, engine))
SELECT *, {sql.wer('errors', 'ref_words')} AS wer FROM s""",
)
def ag01_rollup(spark, sf_dir):
    return scoring.corpus_wer_rollup(details(spark, sf_dir), "dataset", "engine")


@query(
    "ag02_real_time_factor",
    f"""WITH {SCORED}, s AS (SELECT dataset, count(*) AS samples, count_if(failed) AS failed,
  sum(CASE WHEN failed THEN ref_words ELSE errors END)::BIGINT AS errors,
  coalesce(sum(CASE WHEN NOT failed THEN audio_sec END), 0e0) AS a, coalesce(sum(CASE WHEN NOT failed THEN proc_sec END), 0e0) AS p
  FROM details GROUP BY 1)
SELECT dataset, samples, failed, errors, round(a, 4) AS audio_sec, round(p, 4) AS proc_sec,
  round(CASE WHEN a > 0 THEN p / a ELSE 0e0 END, 6) AS rtf FROM s""",
)
def ag02(spark, sf_dir):
    out = scoring.real_time_factor(scoring.fail_as_errors(details(spark, sf_dir)), ["dataset"])
    return out.withColumns({"audio_sec": F.round("audio_sec", 4), "proc_sec": F.round("proc_sec", 4), "rtf": F.round("rtf", 6)})


def lcg_sql(source: str, order: str, measures: list[str], value: str, group: str = "1") -> str:
    """Intervals of groups of rows, with the generator run in unsigned 128-bit arithmetic."""
    sums = ", ".join(f"sum({m})::BIGINT AS {m}" for m in measures)
    return f"""rows0 AS (SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS idx FROM {source}),
size AS (SELECT g, count(*)::UHUGEINT AS n FROM rows0 GROUP BY 1),
modulus AS (SELECT 18446744073709551616::UHUGEINT AS m),
steps AS (WITH RECURSIVE t(k, a, c) AS (SELECT 1, 6364136223846793005::UHUGEINT, 1::UHUGEINT
  UNION ALL SELECT k + 1, (a * 6364136223846793005::UHUGEINT) % m, (c * 6364136223846793005::UHUGEINT + 1::UHUGEINT) % m
  FROM t, modulus WHERE k < (SELECT max(n) FROM size)) SELECT * FROM t),
hop AS (SELECT g, n, a, c FROM steps JOIN size ON k = n),
seeds AS (WITH RECURSIVE r(g, replicate, s) AS (SELECT g, 0, 123456789::UHUGEINT FROM size
  UNION ALL SELECT r.g, replicate + 1, (s * hop.a + hop.c) % m FROM r JOIN hop ON hop.g = r.g, modulus WHERE replicate < 999) SELECT * FROM r),
draws AS (SELECT seeds.g, replicate, (((s * a + c) % m) // 4294967296::UHUGEINT) % n AS idx FROM seeds JOIN size ON size.g = seeds.g
  JOIN steps ON k <= n, modulus),
replicates AS (SELECT draws.g, replicate, {sums} FROM draws JOIN rows0 ON rows0.g = draws.g AND rows0.idx = draws.idx::BIGINT GROUP BY 1, 2),
ranked AS (SELECT g, list_sort(list({value})) AS v FROM replicates GROUP BY 1)"""


@query(
    "ag03_bootstrap_ci",
    f"""WITH {SCORED}, {lcg_sql('details', 'sample_idx', ['ref_words', 'errors'], sql.wer('errors', 'ref_words'))}
SELECT v[26] AS ci_low, v[976] AS ci_high FROM ranked""",
)
def ag03(spark, sf_dir):
    rows = details(spark, sf_dir).select("sample_idx", "ref_words", "errors")
    return bootstrap.wer_interval(rows, [], ["sample_idx"], F.floor(F.col("sample_idx") / 1_000_000))


@query(
    "ag03_bootstrap_ci_by_dataset",
    f"""WITH {SCORED}, {lcg_sql('details', 'sample_idx', ['ref_words', 'errors'], sql.wer('errors', 'ref_words'), 'dataset')}
SELECT g AS dataset, v[26] AS ci_low, v[976] AS ci_high FROM ranked""",
)
def ag03_by_dataset(spark, sf_dir):
    rows = details(spark, sf_dir).select("dataset", "sample_idx", "ref_words", "errors")
    return bootstrap.wer_interval(rows, ["dataset"], ["sample_idx"], F.floor(F.col("sample_idx") / 1_000_000))


def _paired(spark, sf_dir) -> DataFrame:
    """Batch run: the reply scored; stream run: the reply of the utterance without its digits, scored verbatim."""
    rows = details(spark, sf_dir)
    batch = rows.select("file", "sample_idx", "errors", "ref_words")
    stream = rows.select("file", "sample_idx", F.col("naive_errors").alias("errors"), F.col("naive_ref_words").alias("ref_words"))
    return scoring.paired_delta(batch, stream, ["file"])


PAIRS = """pairs AS (SELECT file, sample_idx, CASE WHEN naive_ref_words <> 0 THEN naive_ref_words ELSE ref_words END AS ref_words,
  errors AS batch_errors, naive_errors AS stream_errors FROM details)"""


@query("jn02_batch_stream_pairs", f"WITH {SCORED}, {PAIRS} SELECT * FROM pairs")
def jn02(spark, sf_dir):
    return _paired(spark, sf_dir)


_DELTA = "CASE WHEN ref_words > 0 THEN (stream_errors::DOUBLE / ref_words - batch_errors::DOUBLE / ref_words) * 100e0 ELSE 0e0 END"


@query(
    "ag04_paired_bootstrap_ci",
    f"""WITH {SCORED}, {PAIRS}, {lcg_sql('pairs', 'sample_idx', ['ref_words', 'batch_errors', 'stream_errors'], _DELTA)}
SELECT v[26] AS ci_low, v[976] AS ci_high FROM ranked""",
)
def ag04(spark, sf_dir):
    pairs = _paired(spark, sf_dir)
    return bootstrap.delta_interval(pairs, [], ["sample_idx"], F.floor(F.col("sample_idx") / 1_000_000))


@query(
    "ag05_paired_delta",
    f"""WITH {SCORED}, {PAIRS}, s AS (SELECT count(*) AS paired, sum(ref_words)::BIGINT AS ref_words,
  sum(batch_errors)::BIGINT AS batch_errors, sum(stream_errors)::BIGINT AS stream_errors FROM pairs)
SELECT *, {sql.wer('batch_errors', 'ref_words')} AS wer_batch, {sql.wer('stream_errors', 'ref_words')} AS wer_stream,
  {sql.wer('stream_errors', 'ref_words')} - {sql.wer('batch_errors', 'ref_words')} AS delta_pp FROM s""",
)
def ag05(spark, sf_dir):
    return scoring.paired_summary(_paired(spark, sf_dir), [])


def _histogram_sql() -> str:
    axes = [
        ("audio_duration", "audio_sec", timing.DURATION_BUCKETS),
        ("ref_words", "ref_words", timing.REF_WORD_BUCKETS),
        ("wer", "wer", timing.WER_BUCKETS),
    ]
    number = lambda v: "NULL" if v is None else f"{v:e}"
    dims = ", ".join(
        f"('{axis}', {i}, '{label}', {number(low)}, {number(high)})"
        for axis, _, buckets in axes
        for i, (label, low, high) in enumerate(buckets)
    )
    hits = " UNION ALL ".join(
        f"SELECT engine, '{axis}' AS axis, {sql.bucket(col, buckets)} AS bucket, ref_words, errors FROM details"
        for axis, col, buckets in axes
    )
    return f"""dims(axis, bucket_idx, bucket, low_inclusive, high_exclusive) AS (VALUES {dims}),
hits AS ({hits}), engines AS (SELECT DISTINCT engine FROM details),
cells AS (SELECT e.engine, d.axis, d.bucket_idx, d.bucket, d.low_inclusive::DOUBLE AS low_inclusive,
  d.high_exclusive::DOUBLE AS high_exclusive, count(h.bucket) AS samples, coalesce(sum(h.ref_words), 0)::BIGINT AS bucket_ref_words,
  coalesce(sum(h.errors), 0)::BIGINT AS bucket_errors FROM engines e CROSS JOIN dims d
  LEFT JOIN hits h ON h.engine = e.engine AND h.axis = d.axis AND h.bucket = d.bucket GROUP BY ALL)"""


@query(
    "ag06_wer_histograms",
    f"WITH {SCORED}, {_histogram_sql()} SELECT *, {sql.wer('bucket_errors', 'bucket_ref_words')} AS bucket_wer FROM cells",
)
def ag06(spark, sf_dir):
    return scoring.histograms(details(spark, sf_dir), ["engine"])


@query(
    "ag07_latency_percentiles",
    f"""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, len(v) AS n, v[-1] AS max, {sql.quantile('v', 0.5)} AS p50, {sql.quantile('v', 0.95)} AS p95 FROM s""",
)
def ag07(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return quantiles.percentiles(events, ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95})


@query(
    "ag07_latency_rollup",
    f"""WITH v AS (SELECT 'first_partial' AS series, value - 20 AS v FROM events UNION ALL
  SELECT 'partial_lag', unnest([value, value * 2]) FROM events WHERE event_type = 'click' UNION ALL
  SELECT 'final_lag', value * 3 FROM events WHERE event_type = 'purchase'),
s AS (SELECT series, list_sort(list(v)) AS v FROM v WHERE v >= 0 GROUP BY 1)
SELECT n.series, coalesce(len(v), 0) AS n, v[-1] AS max, {sql.quantile('v', 0.5)} AS p50, {sql.quantile('v', 0.95)} AS p95
FROM (VALUES ('first_partial'), ('partial_lag'), ('final_lag'), ('never_seen')) n(series) LEFT JOIN s ON s.series = n.series""",
)
def ag07_rollup(spark, sf_dir):
    value, kind = F.col("value"), F.col("event_type")
    series = {
        "first_partial": value - 20,
        "partial_lag": F.when(kind == "click", F.array(value, value * 2)),
        "final_lag": F.when(kind == "purchase", value * 3),
        "never_seen": F.when(kind == "none", value),
    }
    return quantiles.latency_rollup(table(spark, sf_dir, "events"), series, {"p50": 0.5, "p95": 0.95})


@query(
    "ag08_outcome_counts",
    """SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count_if(event_type = 'error') AS n_timeout,
  count_if(event_type = 'view') AS n_no_partial, count_if(event_type = 'signup') AS n_error FROM events GROUP BY 1""",
)
def ag08(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("day"),
        (kind == "error").alias("timed_out"),
        (kind == "view").alias("no_partial"),
        (~kind.isin("error", "signup")).alias("ok"),
    )
    return scoring.outcome_counts(rows, ["day"])


@query(
    "ag09_hallucination_rate",
    f"""WITH c AS (SELECT l.toxic, len({sql.words('d.text')}) AS w, d.n_chars AS secs FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT toxic, count(*) AS clips, sum(w)::BIGINT AS words_inserted, sum(secs)::BIGINT AS secs FROM c GROUP BY 1)
SELECT toxic, clips, words_inserted, secs / 60e0 AS audio_minutes,
  CASE WHEN secs > 0 THEN words_inserted / (secs / 60e0) ELSE 0e0 END AS words_per_minute FROM s""",
)
def ag09(spark, sf_dir):
    clips = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return scoring.hallucination_rate(clips, ["toxic"], words_of(F.col("text")), F.col("n_chars"))


def _marks_sql(col: str, keep: str) -> str:
    chars = f"list_transform(range(1, length({col}) + 1), lambda i: (i - 1) || ':' || {col}[i])"
    return f"list_filter({chars}, lambda p: {keep})"


_MARK = f"list_contains({sql.MARKS}, substr(p, strpos(p, ':') + 1))"
_CAPITAL = "regexp_full_match(substr(p, strpos(p, ':') + 1), '\\p{Lu}')"
OVERLAP = f"""
{sql.utterances()},
marks AS (SELECT turn, 'punctuation' AS kind, {_marks_sql('reference', _MARK)} AS r, {_marks_sql('hypothesis', _MARK)} AS h FROM utt
  UNION ALL SELECT turn, 'capitals', {_marks_sql('reference', _CAPITAL)}, {_marks_sql('hypothesis', _CAPITAL)} FROM utt),
counts AS (SELECT turn, kind, len(list_intersect(r, h)) AS tp, len(h) - len(list_intersect(r, h)) AS fp,
  len(r) - len(list_intersect(r, h)) AS fn FROM marks)"""


def _mark_counts(spark, sf_dir) -> DataFrame:
    rows = utterances(spark, sf_dir).select("turn", "reference", "hypothesis")
    counted = [
        rows.select(
            "turn",
            F.lit(kind).alias("kind"),
            *[c.alias(n) for n, c in scoring.set_overlap(fn(F.col("reference")), fn(F.col("hypothesis"))).items()],
        )
        for kind, fn in (("punctuation", text.punctuation_positions), ("capitals", text.capital_positions))
    ]
    return counted[0].unionByName(counted[1])


@query(
    "se01_position_sets",
    f"WITH {OVERLAP} SELECT turn, kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY 1, 2",
)
def se01(spark, sf_dir):
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]
    return _mark_counts(spark, sf_dir).groupBy("turn", "kind").agg(*sums)


@query(
    "ag10_micro_f1",
    f"""WITH {OVERLAP}, s AS (SELECT kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts GROUP BY 1),
r AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS c FROM s)
SELECT kind, tp, fp, fn, round(p, 3) AS precision, round(c, 3) AS recall, CASE WHEN p + c > 0 THEN round(2 * p * c / (p + c), 3) ELSE 0e0 END AS f1 FROM r""",
)
def ag10(spark, sf_dir):
    return scoring.micro_f1(_mark_counts(spark, sf_dir), ["kind"])


ERROR_PAIRS = f"""
{sql.utterances()},
zipped AS (SELECT unnest(range(1, greatest(len(ref), len(hyp)) + 1)) AS i, ref, hyp FROM utt),
diffs AS (SELECT coalesce(ref[i], '(del)') AS ref_word, coalesce(hyp[i], '(ins)') AS hyp_word FROM zipped
  WHERE ref[i] IS DISTINCT FROM hyp[i]),
tally AS (SELECT ref_word, hyp_word, count(*) AS n FROM diffs GROUP BY 1, 2)"""


@query("ag13_error_pairs", f"WITH {ERROR_PAIRS} SELECT * FROM tally")
def ag13(spark, sf_dir):
    return scoring.error_pairs(utterances(spark, sf_dir), [])


@query("tk02_top_error_pairs", f"WITH {ERROR_PAIRS} SELECT * FROM tally ORDER BY n DESC, ref_word, hyp_word LIMIT 20")
def tk02(spark, sf_dir):
    return scoring.top_error_pairs(utterances(spark, sf_dir))


@query(
    "ag13_wer_distribution",
    f"""WITH {SCORED}, s AS (SELECT engine, list_sort(list(wer)) AS v, avg(wer) AS m FROM details GROUP BY 1)
SELECT engine, len(v) AS n, v[1] AS wer_min, v[-1] AS wer_max, round(m, 6) AS wer_mean, v[len(v) // 2 + 1] AS wer_median FROM s""",
)
def ag13_distribution(spark, sf_dir):
    rows = details(spark, sf_dir).select("engine", "wer")
    median = quantiles.order_statistic(rows, ["engine"], F.col("wer"), F.floor(F.col("n") / 2), "wer_median")
    spread = scoring.wer_distribution(rows, ["engine"]).withColumn("wer_mean", F.round("wer_mean", 6))
    return safe_join(spread, median, ["engine"])


@query(
    "ag18_repeat_stats",
    """SELECT l_partkey, count(*) AS runs, min(l_discount / l_quantity) AS rtf_best, round(avg(l_discount / l_quantity), 9) AS rtf_mean,
  max(l_discount / l_quantity) AS rtf_max, min(l_returnflag) = max(l_returnflag) AS text_stable FROM lineitem GROUP BY 1""",
)
def ag18(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_discount").alias("proc_sec"), F.col("l_quantity").alias("audio_sec"), F.col("l_returnflag").alias("text")
    )
    return scoring.repeat_stats(runs, ["l_partkey"]).withColumn("rtf_mean", F.round("rtf_mean", 9))


@query(
    "ag19_rtf_stats",
    """SELECT l_returnflag, l_linestatus, round(avg(l_discount / l_quantity), 9) AS rtf_mean, min(l_discount / l_quantity) AS rtf_min,
  max(l_discount / l_quantity) AS rtf_max FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
)
def ag19(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_discount").alias("proc_sec"), F.col("l_quantity").alias("audio_sec")
    )
    return scoring.rtf_stats(runs, ["l_returnflag", "l_linestatus"]).withColumn("rtf_mean", F.round("rtf_mean", 9))


@query(
    "ag22_batch_summary",
    """SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS processed, count_if(o_orderstatus = 'P') AS failed,
  count_if(o_orderstatus = 'O') AS skipped FROM orders GROUP BY 1""",
)
def ag22(spark, sf_dir):
    status = F.col("o_orderstatus")
    named = F.when(status == "F", "processed").when(status == "P", "failed").otherwise("skipped")
    return scoring.batch_summary(table(spark, sf_dir, "orders").withColumn("status", named), ["o_orderpriority"])


@query(
    "jn09_rescored_results",
    f"""WITH {SCORED}, n AS (SELECT dataset, engine, {sql.wer('sum(errors)', 'sum(ref_words)')} AS new_wer,
  {sql.wer('sum(naive_errors)', 'sum(naive_ref_words)')} AS old_wer FROM details GROUP BY 1, 2)
SELECT dataset, engine, old_wer, new_wer, new_wer - old_wer AS delta_pp FROM n""",
)
def jn09(spark, sf_dir):
    rows = details(spark, sf_dir)
    keys = ["dataset", "engine"]
    new = scoring.corpus_wer(rows, keys)
    old = new.select(*keys, F.col("naive_wer").alias("wer"))
    return scoring.rescore_report(old, new, keys)


@query(
    "jn10_word_overlap",
    f"""WITH {sql.utterances()} SELECT conv_id, turn, CASE WHEN len(ref) = 0 THEN 1e0
  ELSE len(list_intersect(list_distinct(ref), hyp))::DOUBLE / len(list_distinct(ref)) END AS overlap FROM utt""",
)
def jn10(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    return rows.select("conv_id", "turn", word_overlap(F.col("ref"), F.col("hyp")).alias("overlap"))


@query(
    "tk01_first_samples",
    "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 100",
)
def tk01(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("sample_idx", F.struct("conv_id", "turn"))
    return scoring.first_samples(rows, 100).select("conv_id", "turn", "role")


@query(
    "tk04_worst_errors",
    f"WITH {SCORED} SELECT file, errors, ref_words FROM details ORDER BY errors DESC, file LIMIT 10",
)
def tk04(spark, sf_dir):
    return scoring.worst_errors(details(spark, sf_dir)).select("file", "errors", "ref_words")


@query(
    "tk04_high_wer",
    f"WITH {SCORED} SELECT file, errors, ref_words FROM details WHERE wer >= 50 ORDER BY sample_idx LIMIT 20",
)
def tk04_high(spark, sf_dir):
    return scoring.high_wer(details(spark, sf_dir)).select("file", "errors", "ref_words")


@query(
    "tk07_ordered_report",
    f"""WITH {SCORED}, n AS (SELECT dataset, engine, sum(errors)::BIGINT AS errors FROM details GROUP BY 1, 2)
SELECT dataset, engine, errors, CASE WHEN engine = min(engine) OVER (PARTITION BY dataset) THEN dataset ELSE '' END AS shown FROM n""",
)
def tk07(spark, sf_dir):
    rows = details(spark, sf_dir).groupBy("dataset", "engine").agg(F.sum("errors").alias("errors"))
    return scoring.ordered_report(rows, "dataset", "engine")


METRICS_SQL = """m AS (SELECT l_returnflag AS run, l_linestatus AS variant, avg(l_extendedprice) AS rss, min(l_discount + 1e-2) AS best,
  avg(l_discount) AS mean, max(l_tax) AS cold, avg(l_tax) AS short FROM lineitem GROUP BY 1, 2)"""


def _run_metrics(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("variant")).agg(
        F.avg("l_extendedprice").alias("rss_mb_after_decode_pool1"),
        F.min(F.col("l_discount") + 0.01).alias("warm_rtf_long40_best"),
        F.avg("l_discount").alias("warm_rtf_long40_mean"),
        F.max("l_tax").alias("cold_start_sec_pool1"),
        F.avg("l_tax").alias("warm_rtf_short_fixtures_mean"),
    )


@query(
    "tx29_dual_gate",
    f"""WITH {METRICS_SQL}, p AS (SELECT f.run AS freeze_run, p.run AS post_run, p.variant, f.rss AS fr, p.rss AS pr, f.best AS fb,
  p.best AS pb, f.mean AS fm, p.mean AS pm, f.cold AS fc, p.cold AS pc, f.short AS fs, p.short AS ps
  FROM m f JOIN m p ON f.variant = p.variant AND f.run < p.run),
rules AS (SELECT freeze_run, post_run, variant, unnest([
  {{'rule': 'ram:rss_mb_after_decode_pool1', 'failed': pr > fr * 1.02e0 + 1e0}}, {{'rule': 'rtf:best_improved', 'failed': pb >= fb}},
  {{'rule': 'rtf:competitive_bar', 'failed': pb > 3e-2}}, {{'rule': 'rtf:mean', 'failed': pm > fm * 1.02e0 + 1e-3}},
  {{'rule': 'cold_start', 'failed': pc > fc * 1.15e0 + 25e-2}}, {{'rule': 'rtf:short_mean', 'failed': ps > fs * 1.10e0 + 2e-3}}]) AS r FROM p)
SELECT freeze_run, post_run, variant, r.rule AS rule FROM rules WHERE r.failed""",
)
def tx29(spark, sf_dir):
    runs = _run_metrics(spark, sf_dir)
    names = [c for c in runs.columns if c not in ("run", "variant")]
    pairs = gates.run_pairs(runs, ["variant"], "run", names)
    return gates.dual_gate(pairs, names).select("freeze_run", "post_run", "variant", "rule")


@query(
    "jn06_tx30_quality_gate",
    f"""WITH {SCORED}, c AS (SELECT dataset, {sql.wer('sum(errors)', 'sum(ref_words)')} AS wer,
  {sql.wer('sum(naive_errors)', 'sum(naive_ref_words)')} AS base, sum(proc_sec) / sum(audio_sec) AS rtf FROM details GROUP BY 1),
b AS (SELECT *, CASE WHEN dataset <> 'turn0' THEN base - 5e0 END AS b FROM c),
r AS (SELECT dataset, unnest([{{'rule': 'wer:ceiling', 'failed': wer >= 15e0}}, {{'rule': 'rtf:ceiling', 'failed': rtf > 5e-1}},
  {{'rule': 'wer:baseline', 'failed': b IS NOT NULL AND wer - b > 15e-1}}]) AS x FROM b)
SELECT dataset, x.rule AS rule FROM r WHERE x.failed""",
)
def tx30(spark, sf_dir):
    rows = details(spark, sf_dir)
    scored = scoring.corpus_wer(rows, ["dataset"])
    speed = rows.groupBy("dataset").agg((F.sum("proc_sec") / F.sum("audio_sec")).alias("rtf"))
    current = safe_join(scored, speed, ["dataset"]).select("dataset", "wer", "rtf")
    baseline = scored.select("dataset", F.when(F.col("dataset") != "turn0", F.col("naive_wer") - 5.0).alias("wer"))
    ceilings = {"wer": 15.0, "rtf": 0.5}
    return gates.quality_gate(current, baseline, ["dataset"], ceilings, {"wer": 1.5})
