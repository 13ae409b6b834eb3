"""Time, score and bucket helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake.functions.expr import let

SAMPLE_RATE = 16_000
SECONDS_PER_FRAME = 0.04

# Histogram buckets (label, low inclusive, high exclusive); equal bounds match one value.
DURATION_BUCKETS = [("0-5s", 0.0, 5.0), ("5-15s", 5.0, 15.0), ("15-30s", 15.0, 30.0), ("30s+", 30.0, None)]
REF_WORD_BUCKETS = [
    ("1-5 words", 1.0, 6.0),
    ("6-15 words", 6.0, 16.0),
    ("16-30 words", 16.0, 31.0),
    ("30+ words", 31.0, None),
]
WER_BUCKETS = [
    ("0%", 0.0, 0.0),
    ("1-10%", 0.0, 10.0),
    ("10-20%", 10.0, 20.0),
    ("20-50%", 20.0, 50.0),
    ("50-100%", 50.0, 100.0),
    ("100%+", 100.0, None),
]


def _clock(seconds: Column, separator: str) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        F.floor(ms / 3_600_000),
        F.floor(ms / 60_000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def format_srt_time(seconds: Column) -> Column:
    """``hh:mm:ss,mmm``."""
    return _clock(seconds, ",")


def format_vtt_time(seconds: Column) -> Column:
    """``hh:mm:ss.mmm``."""
    return _clock(seconds, ".")


def format_hms(seconds: Column) -> Column:
    """``mm:ss``, from one hour on ``hh:mm:ss``."""
    total = F.round(F.greatest(seconds, F.lit(0.0))).cast("bigint")
    minutes, secs = F.floor(total / 60), total % 60
    return F.when(
        minutes >= 60, F.format_string("%02d:%02d:%02d", F.floor(minutes / 60), minutes % 60, secs)
    ).otherwise(F.format_string("%02d:%02d", minutes, secs))


def frame_to_seconds(frame: Column, offset: Column | int = 0) -> Column:
    """Seconds of an encoder frame."""
    return (frame + offset) * F.lit(SECONDS_PER_FRAME)


def ms_to_samples(ms: int) -> int:
    """Samples at 16 kHz, rounded down."""
    return SAMPLE_RATE * ms // 1000


def ms_to_samples_col(ms: Column) -> Column:
    """:func:`ms_to_samples` for a column."""
    return F.floor(ms * SAMPLE_RATE / 1000).cast("bigint")


def bucket_label(value: Column, buckets: list[tuple[str, float | None, float | None]]) -> Column:
    """Bucket of a value. Values below the first bound land in the first bucket that sees them."""
    out = F.when(F.lit(False), F.lit(""))
    for label, low, high in buckets:
        if low is not None and low == high:
            out = out.when(value == low, label)
        else:
            out = out.when(F.lit(True) if high is None else value < high, label)
    return out.otherwise(buckets[-1][0])


def softmax_confidence(scores: Column, index: Column) -> Column:
    """Softmax share of one score, shifted by the maximum; zero outside the array."""
    share = let(
        F.struct(scores.alias("s"), F.array_max(scores).alias("m")),
        lambda x: F.exp(F.get(x["s"], index) - x["m"])
        / F.aggregate(x["s"], F.lit(0.0), lambda acc, v: acc + F.exp(v - x["m"])),
    )
    return F.coalesce(share, F.lit(0.0))


def argmax_last(scores: Column) -> Column:
    """Index of the largest score; the last one on ties."""
    return F.array_max(F.transform(scores, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))["i"]


def top_k(scores: Column, k: int) -> Column:
    """Indices of the ``k`` largest scores, best first, lowest index first on ties."""
    ranked = F.array_sort(F.transform(scores, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def job_percent(processed: Column, total: Column) -> Column:
    """Whole percent done; zero if the total is unknown."""
    return F.when(total > 0, (processed / total * 100).cast("int")).otherwise(0)
