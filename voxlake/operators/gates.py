"""Regression gates: one row per failed rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.joins import safe_join

# Allowed growth of each metric over the frozen run, as factor and addend.
SLACK = {
    "rss_mb_after_decode_pool1": ("ram:rss_mb_after_decode_pool1", 1.02, 1.0),
    "rss_mb_after_ready_pool1": ("ram:rss_mb_after_ready_pool1", 1.02, 1.0),
    "resident_mb_pool1_footprint": ("ram:resident_mb_pool1_footprint", 1.02, 1.0),
    "warm_rtf_long40_mean": ("rtf:mean", 1.02, 0.001),
    "cold_start_sec_pool1": ("cold_start", 1.15, 0.25),
    "warm_rtf_short_fixtures_mean": ("rtf:short_mean", 1.10, 0.002),
}
# The primary metric, its absolute bar, and protocol fields that must agree.
BEST = "warm_rtf_long40_best"
COMPETITIVE_BAR = 0.030
PROTOCOL = ["batches", "rss_sample_point", "pool_size", "model_variant"]


def _failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("failed")) for n, c in rules.items()])
    rows = df.withColumn("_rule", F.explode(cells)).filter("_rule.failed")
    return rows.withColumn("rule", F.col("_rule.rule")).drop("_rule")


def run_pairs(runs: DataFrame, keys: list[str], run: str, metrics: list[str]) -> DataFrame:
    """Every run next to every later one of its keys: ``keys, freeze_run, post_run, freeze, post``."""
    named = runs.select(*keys, F.col(run).alias("post_run"), F.struct(*metrics).alias("post"))
    frozen = named.withColumnsRenamed({"post_run": "freeze_run", "post": "freeze"})
    return safe_join(named, frozen, keys).filter(F.col("freeze_run") < F.col("post_run"))


def dual_gate(pairs: DataFrame, metrics: list[str], *, protocol: list[str] | None = None, bar: Column | None = None) -> DataFrame:
    """Failed rules of each (freeze, post) pair; ``freeze`` and ``post`` are structs of the metrics.

    A metric missing on either side is skipped, except the primary one, whose absence is a failure. Structs
    with ``fixture_texts`` must agree text by text; ``protocol`` names fields that must be equal where both have them.
    """
    f, p = lambda m: F.col(f"freeze.{m}"), lambda m: F.col(f"post.{m}")
    rules = {name: p(m) > f(m) * k + a for m, (name, k, a) in SLACK.items() if m in metrics}
    if BEST in metrics:
        missing = f(BEST).isNull() | p(BEST).isNull()
        rules["rtf:best_missing"] = missing
        rules["rtf:best_improved"] = p(BEST) >= f(BEST)
        limit = F.lit(COMPETITIVE_BAR) if bar is None else F.coalesce(F.when(bar != 0, bar), F.lit(COMPETITIVE_BAR))
        rules["rtf:competitive_bar"] = ~missing & (p(BEST) > limit)
    if "fixture_texts" in metrics:
        has_f, has_p = F.size(f("fixture_texts")) > 0, F.size(p("fixture_texts")) > 0
        same_count = F.size(f("fixture_texts")) == F.size(p("fixture_texts"))
        rules["quality:fixture_count"] = has_f & has_p & ~same_count
        rules["quality:fixture_text"] = has_f & has_p & same_count & (f("fixture_texts") != p("fixture_texts"))
        rules["quality:fixture_missing"] = has_f & ~F.coalesce(has_p, F.lit(False))
    for field in protocol or []:
        rules[f"protocol:{field}"] = f(field) != p(field)
    return _failures(pairs, rules)


def quality_gate(
    current: DataFrame, baseline: DataFrame, keys: list[str], ceilings: dict[str, float], tolerances: dict[str, float]
) -> DataFrame:
    """Ceilings always apply (error rate from the ceiling on, the rest above it); a null baseline skips its rule."""
    base = baseline.select(*keys, *[F.col(m).alias(f"_base_{m}") for m in tolerances])
    joined = safe_join(current, base, keys, "left")
    rules = {f"{m}:ceiling": (F.col(m) >= c if m == "wer" else F.col(m) > c) for m, c in ceilings.items()}
    rules |= {f"{m}:baseline": F.col(m) - F.col(f"_base_{m}") > t for m, t in tolerances.items()}
    return _failures(joined, rules).select(*keys, "rule")
