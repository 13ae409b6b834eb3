"""Timed-word relations: tokens to words, stitching, speakers, segments and captions.

Words are rows ``recording_id, word_idx, word, start, end, confidence, speaker`` with a dense ``word_idx``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.timing import SAMPLE_RATE, frame_to_seconds
from voxlake.operators.joins import lookup_join, safe_join
from voxlake.operators.scans import gather_text, index_block, islands, scan
from voxlake.operators.spans import Limit, greedy_spans
from voxlake.session import materialize

WORD_BOUNDARY = "▁"
PAUSE_SECONDS = 0.9
MAX_SEGMENT_SECONDS = 30.0
CAPTION_BYTES = 80
CAPTION_WORDS = 14
TIME_BUCKET = 60.0


def tokens_to_words(
    tokens: DataFrame, keys: list[str], *, separators_only: bool = False, frame_offset: Column | int = 0
) -> DataFrame:
    """Words from decoded pieces ``tok_idx, text, frame, confidence``.

    A piece that begins with the boundary mark starts a word. With ``separators_only`` such a piece carries no
    text of its own (character vocabularies).
    """
    boundary = F.col("text").startswith(WORD_BOUNDARY)
    clean = F.when(boundary, F.lit("") if separators_only else F.substr("text", F.lit(2))).otherwise(F.col("text"))
    numbered = scan(
        tokens, keys, ["tok_idx"], index_block("tok_idx"), sums={"_word": boundary.cast("bigint")}
    ).withColumn("_clean", clean)
    pieces = numbered.filter(F.col("_clean") != "")
    grouped = pieces.groupBy(*keys, "_word").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "_clean"))), lambda p: p["_clean"]), ""
        ).alias("word"),
        F.min_by("frame", "tok_idx").alias("_first"),
        F.max_by("frame", "tok_idx").alias("_last"),
        F.avg("confidence").alias("confidence"),
    )
    return grouped.select(
        *keys,
        F.col("_word").alias("word_ord"),
        "word",
        frame_to_seconds(F.col("_first"), frame_offset).alias("start"),
        frame_to_seconds(F.col("_last"), frame_offset).alias("end"),
        "confidence",
    )


def ids_to_text(ids: DataFrame, vocab: DataFrame, keys: list[str], blank_id: int) -> DataFrame:
    """Text of piece ids ``tok_idx, token_id``: blanks, unknown pieces and ids outside the vocabulary vanish."""
    known = vocab.filter((F.col("piece") != "<unk>") & (F.col("token_id") != blank_id))
    named = lookup_join(ids, known, "token_id", "inner")
    joined = gather_text(named, keys, ["tok_idx"], F.col("piece"), "", block=index_block("tok_idx"))
    spaced = safe_join(joined, joined.groupBy(*keys).agg(F.max("part").alias("_last")), keys)
    text = F.replace("text", F.lit(WORD_BOUNDARY), F.lit(" "))
    text = F.when(F.col("part") == 0, F.ltrim(text)).otherwise(text)
    return spaced.withColumn("text", F.when(F.col("part") == F.col("_last"), F.rtrim(text)).otherwise(text)).drop("_last")


def overlapping_chunks(words: DataFrame, window_s: float = 24.0, stride_s: float = 22.0) -> DataFrame:
    """Words seen by each overlapping window, with the seam at the middle of the overlap before the window."""
    last = F.floor(F.col("start") / stride_s)
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start") - window_s) / stride_s) + 1)
    return words.withColumn("chunk_id", F.explode(F.sequence(first, last)))


def seam_seconds(chunk_id: Column, window_s: float = 24.0, stride_s: float = 22.0) -> Column:
    """Seam before a chunk: its start plus half the overlap."""
    return chunk_id * F.lit(stride_s) + (window_s - stride_s) / 2


def stitch_chunks(words: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Keep each word once: the earlier chunk up to the seam, the later chunk after it.

    ``chunks`` lists every chunk (``chunk_id, seam_s``), empty ones too: they trim as well. Words pass freely
    into a transcript that is still empty. Whether it is empty can only be open until a chunk has a word between
    its own and the next seam, so the fold below sees just the few chunks before that one.
    """
    seams = scan(chunks, keys, ["chunk_id"], index_block("chunk_id"), leads={"_next": F.col("seam_s")})
    placed = safe_join(words, seams.select(*keys, "chunk_id", "seam_s", "_next"), [*keys, "chunk_id"])
    ends_inside = F.col("_next").isNull() | (F.col("start") <= F.col("_next"))
    after_seam = F.col("start") > F.col("seam_s")
    flags = placed.groupBy(*keys, "chunk_id").agg(
        F.max(ends_inside & after_seam).alias("normal"),
        F.max(ends_inside).alias("free"),
        F.max(after_seam).alias("enters"),
    )
    settled = flags.filter("normal").groupBy(*keys).agg(F.min("chunk_id").alias("_settled"))
    opening = safe_join(flags, settled, keys, "left").filter(
        F.col("_settled").isNull() | (F.col("chunk_id") <= F.col("_settled"))
    )
    facts = F.array_sort(F.collect_list(F.struct("chunk_id", "normal", "free", "enters")))
    start = F.struct(
        F.array().cast("array<bigint>").alias("open"),
        F.lit(-2).cast("bigint").alias("last"),
        F.lit(True).alias("empty"),
        F.lit(False).alias("kept"),
    )

    def step(acc: Column, c: Column) -> Column:
        chunk = c["chunk_id"].cast("bigint")
        is_free = ~acc["kept"] & (acc["empty"] | (chunk > acc["last"] + 1))
        return F.struct(
            F.when(is_free, F.array_append(acc["open"], chunk)).otherwise(acc["open"]).alias("open"),
            chunk.alias("last"),
            (~is_free & ~c["enters"]).alias("empty"),
            (acc["kept"] | F.when(is_free, c["free"]).otherwise(c["normal"])).alias("kept"),
        )

    opened = opening.groupBy(*keys).agg(F.aggregate(facts, start, step, lambda a: a["open"]).alias("_open"))
    free = opened.select(*keys, F.explode("_open").alias("chunk_id")).withColumn("_free", F.lit(True))
    judged = safe_join(placed, free, [*keys, "chunk_id"], "left")
    return judged.filter(ends_inside & (after_seam | F.coalesce("_free", F.lit(False)))).drop("_next", "_free")


def assign_speakers(words: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Speaker of the first turn that holds a word's midpoint; other words keep null.

    Turns are spread over the time buckets they touch, so the join key is (recording, bucket) and a long
    recording is split like any other data.
    """
    bucket = lambda t: F.floor(t / TIME_BUCKET)
    spread = turns.select(
        *keys,
        "turn_idx",
        F.col("start").alias("_from"),
        F.col("end").alias("_to"),
        F.col("speaker").alias("_speaker"),
        F.explode(F.sequence(bucket(F.col("start")), bucket(F.greatest("start", "end")))).alias("_bucket"),
    )
    middle = (F.col("start") + F.col("end")) / 2
    probes = words.drop("speaker").withColumns({"_mid": middle, "_bucket": bucket(middle)})
    hits = safe_join(probes, spread, [*keys, "_bucket"]).filter(
        (F.col("_from") <= F.col("_mid")) & (F.col("_to") >= F.col("_mid"))
    )
    first = hits.groupBy(*keys, "word_idx").agg(
        F.min(F.struct("turn_idx", F.col("_speaker").alias("speaker"))).alias("_hit")
    )
    found = first.select(*keys, "word_idx", "_hit.speaker")
    return safe_join(words.drop("speaker"), found, [*keys, "word_idx"], "left")


def remap_compressed(points: DataFrame, regions: DataFrame, keys: list[str], seconds: str, block_s: int = 600) -> DataFrame:
    """Map times on the silence-removed timeline back through the kept regions ``region_idx, start, end``.

    Region starts and points are merged on the compressed timeline and every point takes the latest region
    before it, so nothing is joined by range. Past the last region the time clamps to its end; without regions
    it stays as it is.
    """
    length = (F.col("end") - F.col("start")).cast("double")
    regions = materialize(regions, "kept-regions")
    laid = scan(regions, keys, ["region_idx"], index_block("region_idx"), sums={"_through": length})
    anchors = laid.select(
        *keys,
        # The first region also takes everything at or before zero.
        F.when(F.col("_through") == length, F.lit(-1.0)).otherwise(F.col("_through") - length).alias("_pos"),
        F.lit(0).alias("_kind"),
        F.col("region_idx").cast("bigint").alias("_row"),
        F.struct(F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), (F.col("_through") - length).alias("a")).alias("_region"),
    )
    target = F.greatest(F.col(seconds) * SAMPLE_RATE, F.lit(0.0))
    probes = points.withColumns({"_pos": target, "_kind": F.lit(-1), "_row": F.lit(0).cast("bigint")})
    both = materialize(probes.unionByName(anchors, allowMissingColumns=True), "timeline")
    # A point on a region's start belongs to the region before it: points sort first.
    found = scan(
        both,
        keys,
        ["_pos", "_kind", "_row"],
        F.floor(F.col("_pos") / (block_s * SAMPLE_RATE)),
        lasts={"_hit": F.col("_region")},
    ).filter(F.col("_kind") == -1)
    mapped = F.least(F.col("_hit.s") + (F.col("_pos") - F.col("_hit.a")), F.col("_hit.e")) / SAMPLE_RATE
    return found.withColumn("original_s", F.coalesce(mapped, F.col(seconds))).select(*points.columns, "original_s")


def mean_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Duration-weighted mean confidence; the plain mean where no word has a duration."""
    weight = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    sums = words.groupBy(*keys).agg(
        F.sum(F.col("confidence") * weight).alias("_cw"), F.sum(weight).alias("_w"), F.avg("confidence").alias("_plain")
    )
    return sums.select(*keys, F.when(F.col("_w") > 0, F.col("_cw") / F.col("_w")).otherwise(F.col("_plain")).alias("confidence"))


def union_channels(channels: list[DataFrame]) -> DataFrame:
    """Word lists of separate channels as one relation; the channel number becomes the speaker."""
    out = channels[0].withColumn("speaker", F.lit(0))
    for n, channel in enumerate(channels[1:], start=1):
        out = out.unionByName(channel.withColumn("speaker", F.lit(n)))
    return out


def merge_channels(words: DataFrame, keys: list[str], block_s: int = 600) -> DataFrame:
    """One transcript per recording from the words of its channels, ordered by start and channel."""
    text = gather_text(
        words, keys, ["start", "speaker", "word_idx"], F.col("word"), " ", block=F.floor(F.col("start") / block_s)
    )
    totals = words.groupBy(*keys).agg(F.max("end").alias("duration_s"), F.count(F.lit(1)).alias("n_words"))
    return safe_join(safe_join(text, totals, keys), mean_confidence(words, keys), keys)


def common_speaker(speaker: str = "speaker") -> Column:
    """Aggregate: the speaker shared by all rows, else null."""
    same = (F.min(speaker) == F.max(speaker)) & (F.count(speaker) == F.count(F.lit(1)))
    return F.when(same, F.min(speaker))


def span_text(word: str = "word", order: str = "word_idx") -> Column:
    """Aggregate: the words of a bounded span in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda p: p[word]), " ")


def _gather_words(batch: pa.RecordBatch, offsets: np.ndarray) -> list[pa.Array]:
    """Start, end, text and number of words, and the speaker, of the runs of a batch; the words of a run share their speaker."""
    first, last = pa.array(offsets[:-1]), pa.array(offsets[1:] - 1)
    word, cuts = batch.column("word"), offsets
    if word.null_count:
        cuts = np.concatenate([[0], np.cumsum(word.is_valid().to_numpy(zero_copy_only=False))])[offsets]
        word = word.drop_null()
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), word), " ")
    return [
        batch.column("start").take(first),
        batch.column("end").take(last),
        pc.if_else(pa.array(np.diff(cuts) > 0), text, pa.scalar(None, text.type)),
        pa.array(np.diff(offsets)),
        batch.column("speaker").take(first),
    ]


def _word_fields(words: DataFrame) -> list[T.StructField]:
    kinds = words.schema
    return [kinds["start"], kinds["end"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), kinds["speaker"]]


def _put_together(pieces: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Spans from their pieces, of which nearly all have one."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"])
    return pieces.groupBy(*keys, "span_start").agg(
        F.min_by("start", "piece").alias("start"),
        F.max_by("end", "piece").alias("end"),
        F.array_join(texts, " ").alias("text"),
        F.sum("n_words").alias("n_words"),
        F.min_by("speaker", "piece").alias("speaker"),
        *[c.alias(n) for n, c in more.items()],
    )


def _gather_segment(batch: pa.RecordBatch, offsets: np.ndarray) -> list[pa.Array]:
    confidence, run = batch.column("confidence"), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    known = confidence.is_valid().to_numpy(zero_copy_only=False)
    # Added one after the other, as an average over rows does.
    total = np.bincount(run, weights=confidence.fill_null(0.0).to_numpy(), minlength=len(offsets) - 1)
    return [*_gather_words(batch, offsets), pa.array(total), pa.array(np.bincount(run[known], minlength=len(offsets) - 1))]


def natural_segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that break on a pause, a speaker change, a sentence end, or after thirty seconds."""
    words = words.select(*keys, "word_idx", "word", "start", "end", "speaker", F.col("confidence").cast("double").alias("confidence"))
    looked = scan(
        words,
        keys,
        ["word_idx"],
        index_block("word_idx"),
        lags={"_end": F.col("end"), "_speaker": F.col("speaker"), "_word": F.col("word"), "_seen": F.lit(True)},
    )
    breaks = (
        F.col("_seen").isNull()
        | (F.col("start") - F.col("_end") > PAUSE_SECONDS)
        | ~F.col("speaker").eqNullSafe(F.col("_speaker"))
        | F.rtrim("_word").rlike("[.!?]$")
    )
    pieces = greedy_spans(
        looked.withColumn("_break", breaks).drop("_end", "_speaker", "_word", "_seen"),
        keys,
        "word_idx",
        index_block("word_idx"),
        [Limit("end", "start", MAX_SEGMENT_SECONDS)],
        forced=F.col("_break"),
        gather=_gather_segment,
        fields=[*_word_fields(words), T.StructField("total", T.DoubleType()), T.StructField("known", T.LongType())],
    )
    mean = F.when(F.sum("known") > 0, F.sum("total") / F.sum("known"))
    return _put_together(pieces, keys, avg_confidence=mean).withColumnRenamed("span_start", "segment_start")


def _gather_cue(batch: pa.RecordBatch, offsets: np.ndarray) -> list[pa.Array]:
    first = pa.array(offsets[:-1])
    return [*_gather_words(batch, offsets), batch.column("_alone").take(first), batch.column("_alone_end").take(first)]


def caption_cues(
    words: DataFrame, keys: list[str], *, max_bytes: int = CAPTION_BYTES, max_words: int = CAPTION_WORDS
) -> DataFrame:
    """Caption cues packed by UTF-8 bytes and words, relabelled at every speaker change; zero lifts a limit.

    A first word that does not fit behind its speaker label leaves a cue with the label alone, which ends where
    the word before it ended.
    """
    words = words.select(*keys, "word_idx", "word", "start", "end", "speaker")
    size = F.octet_length("word").cast("bigint")
    label = F.when(F.col("speaker").isNotNull(), F.concat(F.lit("[SPEAKER_"), F.col("speaker"), F.lit("] ")))
    looked = scan(
        words,
        keys,
        ["word_idx"],
        index_block("word_idx"),
        sums={"_bytes": size + 1},
        lags={"_prev_end": F.col("end"), "_speaker": F.col("speaker"), "_seen": F.lit(True)},
    )
    label_size = F.coalesce(F.octet_length(label), F.lit(0))
    changed = F.col("_seen").isNull() | ~F.col("speaker").eqNullSafe(F.col("_speaker"))
    alone = changed & label.isNotNull() & (label_size + 1 + size > max_bytes) & F.lit(max_bytes > 0)
    prepared = looked.withColumns(
        {
            "_changed": changed,
            "_byte_anchor": F.col("_bytes") - size - 1 - label_size,
            "_count": F.col("word_idx") + 1,
            "_alone": F.coalesce(alone, F.lit(False)),
            "_alone_end": F.when(alone, F.coalesce("_prev_end", "end")),
        }
    ).drop("_prev_end", "_speaker", "_seen")
    limits = []
    if max_bytes > 0:
        limits.append(Limit("_bytes", "_byte_anchor", max_bytes + 1))
    if max_words > 0:
        limits.append(Limit("_count", "word_idx", max_words))
    if limits:
        fields = [*_word_fields(words), T.StructField("_alone", T.BooleanType()), T.StructField("_alone_end", words.schema["end"].dataType)]
        pieces = greedy_spans(
            prepared, keys, "word_idx", index_block("word_idx"), limits, forced=F.col("_changed"), gather=_gather_cue, fields=fields
        )
        first = {n: F.min_by(n, "piece") for n in ("_alone", "_alone_end")}
        cues = _put_together(pieces, keys, **first)
    else:
        spans = islands(
            prepared, keys, ["word_idx"], index_block("word_idx"), look_back={}, starts=F.col("_changed"), island="span_start"
        )
        cues = spans.groupBy(*keys, "span_start").agg(
            F.min_by("start", "word_idx").alias("start"),
            F.max_by("end", "word_idx").alias("end"),
            span_text().alias("text"),
            F.count(F.lit(1)).alias("n_words"),
            common_speaker().alias("speaker"),
            F.min_by("_alone", "word_idx").alias("_alone"),
            F.min_by("_alone_end", "word_idx").alias("_alone_end"),
        )
    # The words of a cue share their speaker.
    cue = F.struct(
        F.lit(1).alias("cue_part"),
        "start",
        "end",
        F.rtrim(F.concat(F.coalesce(label, F.lit("")), F.col("text"))).alias("text"),
        "n_words",
        "speaker",
    )
    label_only = F.struct(
        F.lit(0).alias("cue_part"),
        "start",
        F.col("_alone_end").alias("end"),
        F.rtrim(label).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast(words.schema["speaker"].dataType).alias("speaker"),
    )
    made = F.when(F.col("_alone"), F.array(label_only, cue)).otherwise(F.array(cue))
    return cues.select(*keys, F.col("span_start").alias("cue_start"), F.inline(made))


def number_cues(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues with a dense zero-based ``cue_idx``; cues that have it stay as they are."""
    if "cue_idx" in cues.columns:
        return cues
    numbered = scan(materialize(cues, "cues"), keys, ["cue_start", "cue_part"], index_block("cue_start"), row_number="_rn")
    return numbered.withColumn("cue_idx", F.col("_rn") - 1).drop("_rn")
