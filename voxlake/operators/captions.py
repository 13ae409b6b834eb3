"""Caption and document rendering.

A rendered recording is a set of parts of bounded size that make up the document in order; see ``scans.gather_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.timing import format_hms, format_srt_time, format_vtt_time
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import BLOCK_ROWS, gather_text
from voxlake.operators.words import number_cues
from voxlake.session import materialize

# The headers of the formats.
VTT_HEADER = "WEBVTT\n\n"
TABLE_HEADER = "| Word | Start | End | Confidence | Speaker |\n|------|-------|-----|------------|---------|\n"


def _span(start: Column, end: Column, clock) -> Column:
    return F.concat(clock(start), F.lit(" --> "), clock(end), F.lit("\n"))


def render_srt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """SubRip text with cue numbers from one."""
    body = F.concat(
        F.when(F.col("cue_idx") > 0, "\n").otherwise(""),
        F.format_string("%d\n", F.col("cue_idx") + 1),
        _span(F.col("start"), F.col("end"), format_srt_time),
        F.col("text"),
        F.lit("\n"),
    )
    return gather_text(number_cues(cues, keys), keys, ["cue_idx"], body, "", index="cue_idx", out="document")


def render_vtt(cues: DataFrame, keys: list[str]) -> DataFrame:
    """WebVTT text."""
    body = F.concat(
        F.when(F.col("cue_idx") == 0, VTT_HEADER).otherwise(""),
        _span(F.col("start"), F.col("end"), format_vtt_time),
        F.col("text"),
        F.lit("\n\n"),
    )
    return gather_text(number_cues(cues, keys), keys, ["cue_idx"], body, "", index="cue_idx", out="document")


def render_txt(words: DataFrame, keys: list[str]) -> DataFrame:
    """Plain text."""
    return gather_text(words, keys, ["word_idx"], F.col("word"), " ", index="word_idx", out="document")


def plain_number(value: Column) -> Column:
    """A double the way it is written without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _front_matter(words: DataFrame, keys: list[str], language: str) -> DataFrame:
    facts = words.groupBy(*keys).agg(
        F.max("end").alias("_duration"), (F.coalesce(F.max("speaker"), F.lit(-1)) + 1).alias("_speakers")
    )
    head = F.concat(
        F.lit("---\nduration: "),
        plain_number(F.col("_duration")),
        F.lit(f"\nlanguage: {language}\nspeakers: "),
        F.col("_speakers").cast("string"),
        F.lit("\n---\n\n"),
    )
    return facts.select(*keys, head.alias("_head"))


def render_markdown(words: DataFrame, keys: list[str], *, language: str = "ru", word_table: bool = False) -> DataFrame:
    """Front matter, transcript and, on request, a table of word timings."""
    text = gather_text(words, keys, ["word_idx"], F.col("word"), " ", index="word_idx")
    last = text.groupBy(*keys).agg(F.max("part").alias("_last"))
    framed = safe_join(safe_join(text, last, keys), _front_matter(words, keys, language), keys)
    body = F.concat(
        F.when(F.col("part") == 0, F.concat(F.col("_head"), F.lit("# Transcript\n\n"))).otherwise(""),
        F.col("text"),
        F.when(F.col("part") == F.col("_last"), F.lit("\n\n")).otherwise(""),
    )
    out = framed.select(*keys, F.lit(0).alias("section"), "part", body.alias("document"))
    if not word_table:
        return out
    speaker = F.coalesce(F.concat(F.lit("SPEAKER_"), F.col("speaker")), F.lit("-"))
    row = F.concat(
        F.when(F.col("word_idx") == 0, F.lit("# Word timings\n\n" + TABLE_HEADER)).otherwise(""),
        F.format_string(
            "| %s | %.3fs | %.3fs | %.3f | %s |\n",
            F.replace("word", F.lit("|"), F.lit("\\|")),
            "start",
            "end",
            "confidence",
            speaker,
        ),
    )
    table = gather_text(words, keys, ["word_idx"], row, "", index="word_idx", out="document", part_rows=BLOCK_ROWS)
    return out.unionByName(table.select(*keys, F.lit(1).alias("section"), "part", "document"))


def render_markdown_segments(words: DataFrame, cues: DataFrame, keys: list[str], *, language: str = "ru") -> DataFrame:
    """Front matter and one headed paragraph per cue."""
    body = F.concat(F.lit("### ["), format_hms(F.col("start")), F.lit("]\n\n"), F.col("text"), F.lit("\n\n"))
    framed = safe_join(number_cues(cues, keys), _front_matter(words, keys, language), keys)
    headed = F.concat(F.when(F.col("cue_idx") == 0, F.col("_head")).otherwise(""), body)
    return gather_text(framed, keys, ["cue_idx"], headed, "", index="cue_idx", out="document")


def result_json(text: Column, duration: Column, confidence: Column, words: Column) -> Column:
    """A result as JSON: ``duration`` in seconds, absent fields left out."""
    return F.to_json(F.struct(text.alias("text"), words.alias("words"), duration.alias("duration"), confidence.alias("confidence")))


def _escaped(text: Column) -> Column:
    """Text as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(3), F.length(quoted) - 4)


def render_json(words: DataFrame, keys: list[str]) -> DataFrame:
    """The result of :func:`result_json` without a confidence, in parts: ``keys, section, part, document``.

    Text, words and duration are sections, so a recording of any length is written without being one value.
    """
    text = gather_text(words, keys, ["word_idx"], _escaped(F.col("word")), " ", index="word_idx", out="document")
    item = F.to_json(F.struct("word", "start", "end"))
    items = gather_text(words, keys, ["word_idx"], item, ",", index="word_idx", out="document")
    last = words.groupBy(*keys).agg(F.max("end").alias("duration"))
    number = F.regexp_extract(F.to_json(F.struct("duration")), r":(.*)\}$", 1)

    def opened(parts: DataFrame, section: int, head: str) -> DataFrame:
        body = F.concat(F.when(F.col("part") == 0, head).otherwise(""), F.col("document"))
        return parts.select(*keys, F.lit(section).alias("section"), "part", body.alias("document"))

    tail = last.select(
        *keys, F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("part"),
        F.concat(F.lit('],"duration":'), number, F.lit("}")).alias("document"),
    )
    return opened(text, 0, '{"text":"').unionByName(opened(items, 1, '","words":[')).unionByName(tail)


def render_outputs(words: DataFrame, cues: DataFrame, keys: list[str], formats: list[str]) -> DataFrame:
    """``keys, format, section, part, document`` in each of ``formats``: json, txt, srt, vtt, md."""
    if {"srt", "vtt"} <= set(formats):
        cues = materialize(number_cues(cues, keys), "numbered-cues")
    made = {
        "json": lambda: render_json(words, keys),
        "txt": lambda: render_txt(words, keys),
        "srt": lambda: render_srt(cues, keys),
        "vtt": lambda: render_vtt(cues, keys),
        "md": lambda: render_markdown(words, keys),
    }
    parts = []
    for name in formats:
        rows = made[name]()
        section = F.col("section") if "section" in rows.columns else F.lit(0)
        parts.append(rows.select(*keys, F.lit(name).alias("format"), section.alias("section"), "part", "document"))
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out


def verbose_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments in the verbose layout: seek in hundredths and a pseudo log-probability from the mean confidence."""
    numbered = number_cues(
        segments.withColumns({"cue_start": F.col("segment_start"), "cue_part": F.lit(0)}), keys
    )
    confidence = F.coalesce("avg_confidence", F.lit(0.0))
    return numbered.select(
        *keys,
        F.col("cue_idx").alias("id"),
        F.round(F.col("start") * 100).cast("bigint").alias("seek"),
        "start",
        "end",
        F.concat(F.lit(" "), F.trim("text")).alias("text"),
        F.greatest(F.least(confidence - 1.0, F.lit(0.0)), F.lit(-1.0)).alias("avg_logprob"),
    )
