"""Queries over whole pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.distance import wer_percent
from voxlake.functions.expr import words_of
from voxlake.functions.table_functions import register_sql
from voxlake.operators import blocks, scoring, windows
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import index_block, scan
from voxlake.plans import pipelines, sql
from voxlake.plans.registry import query
from voxlake.plans.relations import table, utterances
from voxlake.session import materialize


def capital_labeller():
    """A stand-in labeller: capitals for long words, a comma after words of seven letters; fails on ``stop`` windows."""

    def label(words: list[str]) -> list[str]:
        if any(w == "und" for w in words[:1]):
            raise RuntimeError("no labels")
        return ["UPPER_COMMA" if len(w) == 7 else "UPPER_O" if len(w) > 7 else "LOWER_O" for w in words]

    return label


@query(
    "sg07_restore_readable",
    f"""WITH w AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS i FROM (SELECT doc_id, {sql.words("replace(lower(regexp_replace(text, '[0-9]+', 'x', 'g')), 'ß', 'ss')")} AS t FROM documents)),
sizes AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
k AS (SELECT *, CASE WHEN n <= 250 THEN 0 ELSE (greatest(n - 250, 0) + 209) // 210 END AS last FROM sizes),
placed AS (SELECT w.*, CASE WHEN last = 0 OR i < 230 THEN 0 ELSE least((i - 20) // 210, last) END AS win FROM w JOIN k USING (doc_id)),
bad AS (SELECT p.doc_id, p.i // 210 AS win FROM w p JOIN k USING (doc_id) WHERE p.i % 210 = 0 AND p.word = 'und' AND p.i // 210 <= last),
r AS (SELECT p.doc_id, p.i, CASE WHEN b.win IS NOT NULL THEN word WHEN length(word) = 7 THEN upper(word[1]) || word[2:] || ',' WHEN length(word) > 7
  THEN upper(word[1]) || word[2:] ELSE word END AS s FROM placed p LEFT JOIN bad b ON b.doc_id = p.doc_id AND b.win = p.win)
SELECT doc_id, i // 65536 AS part, md5(CASE WHEN i // 65536 > 0 THEN ' ' ELSE '' END || string_agg(s, ' ' ORDER BY i)) AS digest FROM r GROUP BY 1, 2""",
)
def sg07(spark, sf_dir):
    plain = F.replace(F.lower(F.regexp_replace("text", "[0-9]+", "x")), F.lit("ß"), F.lit("ss"))
    docs = table(spark, sf_dir, "documents").select("doc_id", plain.alias("text"))
    out = pipelines.restore_readable(docs, ["doc_id"], capital_labeller)
    return out.select("doc_id", "part", F.md5("text").alias("digest"))


@query("sg09_rescore")
def sg09(spark, sf_dir):
    rows = utterances(spark, sf_dir).select(
        F.concat(F.lit("turn"), F.col("turn")).alias("dataset"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_idx"),
        "reference",
        "hypothesis",
    )
    return pipelines.rescore(rows, ["dataset"], "sample_idx", F.floor(F.col("sample_idx") / 1_000_000))


def _paths(spark, sf_dir) -> DataFrame:
    """Each utterance scored twice: the reply against its user turn, and the reply with the turn's own words ahead of it."""
    rows = utterances(spark, sf_dir)
    baseline = rows.select("turn", F.lit("baseline").alias("path"), "ref", "hyp")
    chunked = rows.select("turn", F.lit("chunked").alias("path"), "ref", F.concat("ref", "hyp").alias("hyp"))
    scored = scoring.split_errors(baseline.unionByName(chunked))
    return scored.withColumn("ref_words", F.size("ref").cast("bigint"))


@query(
    "ag23_stitch_cost",
    f"""WITH {sql.utterances()}, p AS (SELECT turn, 'baseline' AS path, ref, hyp FROM utt UNION ALL SELECT turn, 'chunked', ref, list_concat(ref, hyp) FROM utt),
s AS (SELECT turn, path, len(ref) AS n, {sql.error_split('ref', 'hyp')} AS x FROM p),
g AS (SELECT turn, path, sum(x.s)::BIGINT AS sub, sum(x.i)::BIGINT AS ins, sum(x.e)::BIGINT AS del, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2)
SELECT b.turn, b.sub AS baseline_sub, b.ins AS baseline_ins, b.del AS baseline_del, b.n AS baseline_ref_words, c.sub AS chunked_sub, c.ins AS chunked_ins,
  c.del AS chunked_del, c.n AS chunked_ref_words, {sql.wer('b.sub + b.ins + b.del', 'b.n')} AS baseline_wer, {sql.wer('c.sub + c.ins + c.del', 'c.n')} AS chunked_wer,
  {sql.wer('c.sub + c.ins + c.del', 'c.n')} - {sql.wer('b.sub + b.ins + b.del', 'b.n')} AS stitch_cost_pp
FROM g b JOIN g c ON c.turn = b.turn AND c.path = 'chunked' WHERE b.path = 'baseline'""",
)
def ag23(spark, sf_dir):
    return scoring.stitch_cost(_paths(spark, sf_dir), ["turn"])


@query(
    "ag20_retention_curve",
    f"""WITH {sql.utterances()}, s AS (SELECT conv_id, turn, len(ref) AS r, len(hyp) AS h, {sql.distance('ref', 'hyp')} AS e, len(ref)::BIGINT AS seconds FROM utt),
c AS (SELECT *, sum(seconds) OVER (PARTITION BY conv_id ORDER BY turn) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM s),
x AS (SELECT c.*, g.target FROM c, (VALUES (20e0), (60e0), (120e0)) g(target) WHERE t - seconds <= target),
b AS (SELECT conv_id, target, min({{'gap': abs(t - target), 'n': n}}) AS m FROM x GROUP BY 1, 2),
i AS (SELECT b.target, b.conv_id, sum(c.r)::BIGINT AS ref_words, sum(c.h)::BIGINT AS hyp_words, sum(c.e)::BIGINT AS errors FROM b JOIN c ON c.conv_id = b.conv_id AND c.n <= b.m.n GROUP BY 1, 2),
g AS (SELECT target, count(*) AS items, sum(ref_words)::BIGINT AS ref_words, sum(hyp_words)::BIGINT AS hyp_words, sum(errors)::BIGINT AS errors FROM i GROUP BY 1)
SELECT *, hyp_words / ref_words::DOUBLE * 100e0 AS retention, {sql.wer('errors', 'ref_words')} AS wer FROM g WHERE ref_words > 0""",
)
def ag20(spark, sf_dir):
    scored = scoring.score_pairs(utterances(spark, sf_dir)).select(
        "conv_id", "turn", "ref_words", F.size("hyp").cast("bigint").alias("hyp_words"), "errors", F.col("ref_words").alias("seconds")
    )
    return prefix_curve(scored, ["conv_id"], [20, 60, 120], order="turn")


def prefix_curve(segments: DataFrame, keys: list[str], targets: list[float], *, order: str) -> DataFrame:
    """Retention and pooled error rate over the prefixes closest to each length.

    A recording enters a length once, with its segments up to the chosen one, so sums are taken over segments
    joined to the (few) chosen prefixes.
    """
    counted = scan(segments, keys, [order], index_block(order), row_number="_n")
    rows = materialize(counted, "curve-segments")
    best = windows.prefix_closest(rows.select(*keys, order, "seconds"), keys, targets, order=order)
    inside = safe_join(rows.drop("seconds"), best.select(*keys, "target", "segments"), keys).filter(F.col("_n") <= F.col("segments"))
    items = inside.groupBy(*keys, "target").agg(*[F.sum(c).alias(c) for c in ("ref_words", "hyp_words", "errors")])
    return scoring.retention(items, ["target"])


@query(
    "sg08_block_scores",
    f"""WITH RECURSIVE {sql.utterances()}, segments AS (SELECT conv_id, turn, len(ref) * 4e-1 AS seconds FROM utt),
{sql.balanced_blocks("segments", 15, 0, 40)},
s AS (SELECT conv_id, turn, len(ref) AS n, {sql.error_split('ref', 'hyp')} AS x FROM utt),
g AS (SELECT conv_id, block_idx, sum(x.s)::BIGINT AS sub, sum(x.i)::BIGINT AS ins, sum(x.e)::BIGINT AS del, sum(n)::BIGINT AS ref_words
  FROM s JOIN blocks USING (conv_id) WHERE turn BETWEEN first_segment AND last_segment GROUP BY 1, 2)
SELECT *, {sql.wer('sub + ins + del', 'ref_words')} AS wer FROM g""",
)
def sg08(spark, sf_dir):
    """Continuous runs cut into balanced blocks, each block scored by the errors of its segments."""
    rows = utterances(spark, sf_dir).select(
        "conv_id", "turn", "ref", "hyp", (F.size("ref") * 0.4).alias("seconds")
    )
    placed = blocks.assign_blocks(rows, ["conv_id"], "turn", target=15.0, min_len=0.0, max_len=40.0)
    scored = scoring.split_errors(rows).withColumn("ref_words", F.size("ref").cast("bigint"))
    both = safe_join(scored.drop("seconds"), placed.select("conv_id", "turn", "first_position"), ["conv_id", "turn"])
    sums = both.groupBy("conv_id", "first_position").agg(
        *[F.sum(c).alias(c) for c in ("sub", "ins", "del", "ref_words")]
    )
    errors = F.col("sub") + F.col("ins") + F.col("del")
    numbered = blocks.number_blocks(sums, ["conv_id"])
    return numbered.select(
        "conv_id", "block_idx", "sub", "ins", "del", "ref_words", wer_percent(errors, F.col("ref_words")).alias("wer")
    )


@query(
    "ud05_sql_functions",
    f"""WITH s AS (SELECT doc_id, len({sql.words('text')}) AS n FROM documents), k AS (SELECT *, (greatest(n - 250, 0) + 209) // 210 AS last FROM s WHERE n > 0)
SELECT doc_id, last + 1 AS windows, n AS kept_words FROM k""",
)
def ud05(spark, sf_dir):
    register_sql(spark)
    table(spark, sf_dir, "documents").select("doc_id", F.size(words_of(F.col("text"))).alias("n")).createOrReplaceTempView("voxlake_sizes")
    return spark.sql(
        "SELECT doc_id, count(*) AS windows, sum(keep_end - keep_start) AS kept_words "
        "FROM voxlake_sizes, LATERAL label_windows(n) GROUP BY doc_id"
    )
