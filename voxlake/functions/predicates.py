"""Row predicates and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.expr import is_blank

DUAL_MONO_CORRELATION = 0.98
OVERSIZE_SECONDS = 30.0


def is_community_valid(sentence: Column, up_votes: Column, down_votes: Column) -> Column:
    """Non-empty sentence with at least as many up as down votes; a missing vote counts zero."""
    return ~is_blank(sentence) & (F.coalesce(up_votes, F.lit(0)) >= F.coalesce(down_votes, F.lit(0)))


def with_date_floor(df: DataFrame, floor: str, column: str = "timestamp") -> DataFrame:
    """Rows on or after ``floor``; without such a column every row stays."""
    if column not in df.columns:
        return df
    return df.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) >= floor)


def is_counted_partial(kind: Column, text: Column) -> Column:
    """A partial result with text starts the latency clock, an empty one does not."""
    return (kind == "partial") & ~is_blank(text)


def is_oversize(seconds: Column) -> Column:
    """Longer than one decode pass takes."""
    return seconds > OVERSIZE_SECONDS


def outside_context(start: Column, window_start: Column, context_s: Column | float) -> Column:
    """True for words that start at or after the retained left context."""
    return start + 2.220446049250313e-16 >= window_start + context_s


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUP = "[0-9A-Fa-f]{1,4}"
_IPV6_FULL = rf"^{_GROUP}(:{_GROUP}){{7}}$"
_IPV6_SHORT = rf"^({_GROUP}(:{_GROUP})*)?::({_GROUP}(:{_GROUP})*)?$"


def is_address(value: Column) -> Column:
    """IPv4 or IPv6 text."""
    # An IPv4 tail stands for two groups; a double colon for at least one.
    grouped = F.regexp_replace(value, rf":{_OCTET}(\.{_OCTET}){{3}}$", ":0:0")
    groups = F.size(F.filter(F.split(grouped, ":"), lambda g: g != ""))
    v6 = grouped.rlike(_IPV6_FULL) | (grouped.rlike(_IPV6_SHORT) & (groups <= 7))
    return F.coalesce(value.rlike(_IPV4) | v6, F.lit(False))


def is_trusted_peer(peer: Column) -> Column:
    """Loopback, private IPv4, unique-local or link-local IPv6."""
    v4 = peer.rlike(r"^(127|10)\.") | peer.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.") | peer.rlike(r"^192\.168\.")
    v6 = F.lower(peer).rlike(r"^(::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return v4 | v6


def client_identity(peer: Column, forwarded_for: Column, real_ip: Column) -> Column:
    """The address a request is charged to; proxy headers count only from a trusted peer."""
    first_hop = F.trim(F.get(F.split(forwarded_for, ","), 0))
    real = F.trim(real_ip)
    return (
        F.when(~is_trusted_peer(peer), peer)
        .when(is_address(first_hop), first_hop)
        .when(is_address(real), real)
        .otherwise(peer)
    )


def is_retryable(message: Column) -> Column:
    """Only a panic is worth another attempt."""
    return F.coalesce(message.contains("panicked"), F.lit(False))


def public_error(message: Column) -> Column:
    """The message shown to clients: length rejections pass, the rest is reduced to three texts."""
    lowered = F.lower(message)
    return (
        F.when(message.startswith("Audio too long"), message)
        .when(lowered.contains("inference_timeout"), "Inference timed out.")
        .when(lowered.contains("invalid audio"), "Failed to decode audio file. Check format.")
        .otherwise("Transcription failed.")
    )


def mono_fallback_reason(channels: Column, correlation: Column) -> Column:
    """Why a recording is not split by channel; null for genuine stereo."""
    return (
        F.when(channels == 0, "no channels")
        .when(channels == 1, "mono audio")
        .when(channels > 2, "more than two channels")
        .when(correlation > DUAL_MONO_CORRELATION, "dual-mono audio")
    )


def prefer_split(df: DataFrame, path: Column, split: str) -> DataFrame:
    """Rows of the named split if there are any, else all rows."""
    named = path.contains(split)
    any_named = df.agg(F.coalesce(F.max(named), F.lit(False))).scalar()
    return df.filter(~any_named | named)
