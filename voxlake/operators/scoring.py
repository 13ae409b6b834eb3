"""Corpus scores: error rates, real-time factors, histograms and reports.

Every score is a ratio of sums, so each group shuffles one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.distance import wer_percent, word_edit_distance, word_errors
from voxlake.functions.predicates import DUAL_MONO_CORRELATION
from voxlake.functions.timing import DURATION_BUCKETS, REF_WORD_BUCKETS, WER_BUCKETS, bucket_label
from voxlake.operators.joins import latest_per_key, safe_join


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def score_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp", prefix: str = "") -> DataFrame:
    """Add errors, reference word count and error rate for two word arrays."""
    scored = df.withColumns(
        {
            f"{prefix}errors": word_edit_distance(F.col(ref), F.col(hyp)).cast("bigint"),
            f"{prefix}ref_words": F.size(ref).cast("bigint"),
        }
    )
    return scored.withColumn(f"{prefix}wer", wer_percent(F.col(f"{prefix}errors"), F.col(f"{prefix}ref_words")))


def split_errors(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add substitutions, insertions and deletions."""
    split = df.withColumn("_split", word_errors(F.col(ref), F.col(hyp)))
    return split.select(*df.columns, "_split.sub", "_split.ins", "_split.del")


def corpus_wer(details: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged error rate, normalized and verbatim, and their difference."""
    sums = details.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        _total("errors").alias("errors"),
        _total("ref_words").alias("ref_words"),
        _total("naive_errors").alias("naive_errors"),
        _total("naive_ref_words").alias("naive_ref_words"),
    )
    scored = sums.withColumns(
        {
            "wer": wer_percent(F.col("errors"), F.col("ref_words")),
            "naive_wer": wer_percent(F.col("naive_errors"), F.col("naive_ref_words")),
        }
    )
    return scored.withColumn("naive_delta", F.col("wer") - F.col("naive_wer"))


def corpus_wer_rollup(details: DataFrame, dataset: str, engine: str) -> DataFrame:
    """The same error rate at every level: engine within dataset, dataset, all."""
    sums = details.rollup(dataset, engine).agg(
        F.grouping_id().cast("int").alias("level"),
        _total("errors").alias("errors"),
        _total("ref_words").alias("ref_words"),
    )
    return sums.withColumn("wer", wer_percent(F.col("errors"), F.col("ref_words")))


def real_time_factor(details: DataFrame, keys: list[str]) -> DataFrame:
    """Processing over audio seconds of the clips that succeeded; failed clips keep their errors only."""
    ok = ~F.col("failed")
    sums = details.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("failed")).alias("failed"),
        _total("errors").alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("audio_sec"))), F.lit(0.0)).alias("audio_sec"),
        F.coalesce(F.sum(F.when(ok, F.col("proc_sec"))), F.lit(0.0)).alias("proc_sec"),
    )
    ratio = F.when(F.col("audio_sec") > 0, F.col("proc_sec") / F.col("audio_sec")).otherwise(0.0)
    return sums.withColumn("rtf", ratio)


def fail_as_errors(details: DataFrame) -> DataFrame:
    """A failed clip counts every reference word as an error."""
    return details.withColumn("errors", F.when(F.col("failed"), F.col("ref_words")).otherwise(F.col("errors")))


def histograms(details: DataFrame, keys: list[str]) -> DataFrame:
    """Samples, words, errors and error rate by clip length, reference length and error rate.

    One aggregation with a conditional sum per bucket: empty buckets come out as zeros and no row is exploded
    before the shuffle.
    """
    axes = [
        ("audio_duration", "audio_sec", DURATION_BUCKETS),
        ("ref_words", "ref_words", REF_WORD_BUCKETS),
        ("wer", "wer", WER_BUCKETS),
    ]
    labelled = details.withColumns(
        {f"_b_{axis}": bucket_label(F.coalesce(F.col(col), F.lit(0)), buckets) for axis, col, buckets in axes}
    )
    sums, rows = [], []
    for axis, _, buckets in axes:
        for n, (label, low, high) in enumerate(buckets):
            inside = F.col(f"_b_{axis}") == label
            cell = f"_{axis}_{n}"
            sums.append(
                F.struct(
                    F.count_if(inside).alias("samples"),
                    F.coalesce(F.sum(F.when(inside, F.col("ref_words"))), F.lit(0)).cast("bigint").alias("ref_words"),
                    F.coalesce(F.sum(F.when(inside, F.col("errors"))), F.lit(0)).cast("bigint").alias("errors"),
                ).alias(cell)
            )
            rows.append(
                F.struct(
                    F.lit(axis).alias("axis"),
                    F.lit(n).alias("bucket_idx"),
                    F.lit(label).alias("bucket"),
                    F.lit(low).cast("double").alias("low_inclusive"),
                    F.lit(high).cast("double").alias("high_exclusive"),
                    F.col(f"{cell}.samples").alias("samples"),
                    F.col(f"{cell}.ref_words").alias("bucket_ref_words"),
                    F.col(f"{cell}.errors").alias("bucket_errors"),
                )
            )
    cells = labelled.groupBy(*keys).agg(*sums)
    exploded = cells.select(*keys, F.explode(F.array(*rows)).alias("_row")).select(*keys, "_row.*")
    return exploded.withColumn("bucket_wer", wer_percent(F.col("bucket_errors"), F.col("bucket_ref_words")))


def outcome_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions, timeouts, sessions without a partial, and errors that were not timeouts."""
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(timed_out).alias("n_timeout"),
        F.count_if(F.coalesce(F.col("no_partial"), F.lit(False))).alias("n_no_partial"),
        F.count_if((F.col("ok") == F.lit(False)) & ~timed_out).alias("n_error"),
    )


def hallucination_rate(clips: DataFrame, keys: list[str], words: Column, seconds: Column) -> DataFrame:
    """Words produced per audio minute; a failed clip is an empty text."""
    sums = clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clips"),
        F.coalesce(F.sum(F.coalesce(F.size(words), F.lit(0))), F.lit(0)).cast("bigint").alias("words_inserted"),
        F.sum(seconds).alias("_seconds"),
    )
    minutes = F.col("_seconds") / 60.0
    rate = F.when(minutes > 0, F.col("words_inserted") / minutes).otherwise(0.0)
    return sums.withColumns({"audio_minutes": minutes, "words_per_minute": rate}).drop("_seconds")


def set_overlap(ref_items: Column, hyp_items: Column) -> dict[str, Column]:
    """True positives, false positives and false negatives of two item arrays taken as sets."""
    ref, hyp = F.array_distinct(ref_items), F.array_distinct(hyp_items)
    shared = F.size(F.array_intersect(ref, hyp))
    return {"tp": shared, "fp": F.size(hyp) - shared, "fn": F.size(ref) - shared}


def micro_f1(items: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 from summed counts, to three digits."""
    sums = items.groupBy(*keys).agg(_total("tp").alias("tp"), _total("fp").alias("fp"), _total("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.withColumns(
        {"precision": F.bround(precision, 3), "recall": F.bround(recall, 3), "f1": F.bround(f1, 3)}
    )


def paired_delta(batch: DataFrame, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Stream runs next to batch runs of the same file; the last batch row of a file counts."""
    last = latest_per_key(batch.select(*keys, "sample_idx", "errors", "ref_words"), keys, F.col("sample_idx"))
    right = last.select(*keys, F.col("errors").alias("batch_errors"), F.col("ref_words").alias("_batch_ref"))
    pairs = safe_join(stream, right, keys)
    # A zero count falls back to the batch side, as a missing one does.
    ref = F.when(F.coalesce(F.col("ref_words"), F.lit(0)) != 0, F.col("ref_words")).otherwise(F.col("_batch_ref"))
    return pairs.select(
        *keys,
        "sample_idx",
        F.coalesce(ref, F.lit(0)).alias("ref_words"),
        F.coalesce("batch_errors", F.lit(0)).alias("batch_errors"),
        F.coalesce("errors", F.lit(0)).alias("stream_errors"),
    )


def paired_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Both error rates and their difference over paired files; zeros if there are none."""
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paired"),
        _total("ref_words").alias("ref_words"),
        _total("batch_errors").alias("batch_errors"),
        _total("stream_errors").alias("stream_errors"),
    )
    scored = sums.withColumns(
        {
            "wer_batch": wer_percent(F.col("batch_errors"), F.col("ref_words")),
            "wer_stream": wer_percent(F.col("stream_errors"), F.col("ref_words")),
        }
    )
    return scored.withColumn("delta_pp", F.col("wer_stream") - F.col("wer_batch"))


def error_pairs(details: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Word pairs that differ at the same position. Surplus words are labelled the way the report prints them."""
    zipped = details.select(*keys, F.explode(F.arrays_zip(F.col(ref).alias("r"), F.col(hyp).alias("h"))).alias("_p"))
    pairs = zipped.select(
        *keys,
        F.coalesce("_p.r", F.lit("(del)")).alias("ref_word"),
        F.coalesce("_p.h", F.lit("(ins)")).alias("hyp_word"),
        F.col("_p.r").eqNullSafe(F.col("_p.h")).alias("_same"),
    )
    return pairs.filter(~F.col("_same")).groupBy(*keys, "ref_word", "hyp_word").agg(F.count(F.lit(1)).alias("n"))


def top_error_pairs(details: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent differing pairs."""
    return error_pairs(details, []).orderBy(F.desc("n"), "ref_word", "hyp_word").limit(k)


def rtf_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, least and largest of the per-sample factors."""
    factor = F.col("proc_sec") / F.col("audio_sec")
    valid = samples.filter(F.col("audio_sec") > 0)
    return valid.groupBy(*keys).agg(
        F.avg(factor).alias("rtf_mean"), F.min(factor).alias("rtf_min"), F.max(factor).alias("rtf_max")
    )


def repeat_stats(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Best, mean and worst factor of repeated runs, and whether the text ever drifted."""
    factor = F.col("proc_sec") / F.col("audio_sec")
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min(factor).alias("rtf_best"),
        F.avg(factor).alias("rtf_mean"),
        F.max(factor).alias("rtf_max"),
        (F.min("text") == F.max("text")).alias("text_stable"),
    )


def retention(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hypothesis words over reference words, and the pooled error rate."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"),
        _total("ref_words").alias("ref_words"),
        _total("hyp_words").alias("hyp_words"),
        _total("errors").alias("errors"),
    )
    kept = sums.filter(F.col("ref_words") > 0)
    return kept.withColumns(
        {
            "retention": F.col("hyp_words") / F.col("ref_words") * 100.0,
            "wer": wer_percent(F.col("errors"), F.col("ref_words")),
        }
    )


def batch_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Files processed, failed and skipped."""
    status = F.col("status")
    return results.groupBy(*keys).agg(
        F.count_if(status == "processed").alias("processed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    )


def stitch_cost(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Error split of the chunked path against the baseline path over the same items."""
    sums = scored.groupBy(*keys).pivot("path", ["baseline", "chunked"]).agg(
        _total("sub").alias("sub"),
        _total("ins").alias("ins"),
        _total("del").alias("del"),
        _total("ref_words").alias("ref_words"),
    )
    rate = {
        p: wer_percent(F.col(f"{p}_sub") + F.col(f"{p}_ins") + F.col(f"{p}_del"), F.col(f"{p}_ref_words"))
        for p in ("baseline", "chunked")
    }
    rated = sums.withColumns({f"{p}_wer": c for p, c in rate.items()})
    return rated.withColumn("stitch_cost_pp", F.col("chunked_wer") - F.col("baseline_wer"))


def rescore_report(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored and recomputed error rates side by side."""
    right = new.select(*keys, F.col("wer").alias("new_wer"))
    joined = safe_join(old.select(*keys, F.col("wer").alias("old_wer")), right, keys)
    return joined.withColumn("delta_pp", F.col("new_wer") - F.col("old_wer"))


def ordered_report(rows: DataFrame, dataset: str, engine: str) -> DataFrame:
    """Report rows by dataset and engine, the dataset named on its first row only.

    The first engine of a dataset comes from a mergeable minimum, so no dataset is sorted in one task.
    """
    first = rows.groupBy(dataset).agg(F.min(engine).alias("_first"))
    shown = F.when(F.col(engine) == F.col("_first"), F.col(dataset)).otherwise("")
    return safe_join(rows, first, [dataset]).withColumn("shown", shown).drop("_first").orderBy(dataset, engine)


def worst_errors(details: DataFrame, k: int = 10) -> DataFrame:
    """The clips with the most errors."""
    return details.orderBy(F.desc("errors"), "file").limit(k)


def high_wer(details: DataFrame, floor: float = 50.0, k: int = 20) -> DataFrame:
    """The first clips, in sample order, at or above an error rate."""
    return details.filter(F.col("wer") >= floor).orderBy("sample_idx").limit(k)


def first_samples(samples: DataFrame, max_samples: int, order: str = "sample_idx") -> DataFrame:
    """The first samples in manifest order; zero keeps all."""
    return samples.orderBy(order).limit(max_samples) if max_samples > 0 else samples


def wer_distribution(details: DataFrame, keys: list[str]) -> DataFrame:
    """Least, largest and mean error rate per group (the upper median comes from ``quantiles.order_statistic``)."""
    return details.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("wer").alias("wer_min"), F.max("wer").alias("wer_max"), F.avg("wer").alias("wer_mean")
    )




def dual_mono(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the two channels ``left, right``; zero for silent ones. Above 0.98 they are one signal."""
    found = samples.groupBy(*keys).agg(F.coalesce(F.corr("left", "right"), F.lit(0.0)).alias("correlation"))
    return found.withColumn("dual_mono", F.col("correlation") > DUAL_MONO_CORRELATION)
