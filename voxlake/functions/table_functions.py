"""Functions for SQL users: scalar functions on Arrow batches and table functions for the window plans.

The window functions are SQL themselves, so the optimizer sees through them. DataFrame code uses ``operators.windows``.

Words, segments and cues are polymorphic functions of a table whose rows come by partition and in order::

    SELECT * FROM natural_segments(TABLE(words) PARTITION BY recording_id ORDER BY (word_idx), 'recording_id')

They stream over the rows of a partition and hold one open word, segment or cue. A recording is one partition there; the
DataFrame operators of ``operators.words`` spread a long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from voxlake.functions.distance import distance_udf, split_udf
from voxlake.functions.timing import SECONDS_PER_FRAME
from voxlake.operators.words import CAPTION_BYTES, CAPTION_WORDS, MAX_SEGMENT_SECONDS, PAUSE_SECONDS, WORD_BOUNDARY
from voxlake.operators.windows import (
    LABEL_OVERLAP_WORDS,
    LABEL_WINDOW_WORDS,
    SINGLE_PASS_SAMPLES,
    WINDOW_SAMPLES,
    stride_samples,
)

LABEL_STRIDE, LABEL_HALF = LABEL_WINDOW_WORDS - LABEL_OVERLAP_WORDS, LABEL_OVERLAP_WORDS // 2

AUDIO_WINDOWS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION audio_windows(total BIGINT)
RETURNS TABLE (chunk_id BIGINT, start_sample BIGINT, end_sample BIGINT)
RETURN SELECT k, k * {stride_samples()},
  CASE WHEN total <= {SINGLE_PASS_SAMPLES} THEN total ELSE least(k * {stride_samples()} + {WINDOW_SAMPLES}, total) END
FROM (SELECT explode(sequence(0L, CASE WHEN total <= {SINGLE_PASS_SAMPLES} THEN 0L
  ELSE (greatest(total - {WINDOW_SAMPLES}, 0L) + {stride_samples() - 1}) DIV {stride_samples()} END)) AS k)
WHERE total > 0
"""

LABEL_WINDOWS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION label_windows(n_words BIGINT)
RETURNS TABLE (window_idx BIGINT, start BIGINT, end BIGINT, keep_start BIGINT, keep_end BIGINT)
RETURN SELECT k, k * {LABEL_STRIDE}, least(k * {LABEL_STRIDE} + {LABEL_WINDOW_WORDS}, n_words),
  CASE WHEN k = 0 THEN 0L ELSE k * {LABEL_STRIDE} + {LABEL_HALF} END,
  CASE WHEN k = last THEN n_words ELSE k * {LABEL_STRIDE} + {LABEL_WINDOW_WORDS - LABEL_HALF} END
FROM (SELECT explode(sequence(0L, last)) AS k, last FROM
  (SELECT (greatest(n_words - {LABEL_WINDOW_WORDS}, 0L) + {LABEL_STRIDE - 1}) DIV {LABEL_STRIDE} AS last))
WHERE n_words > 0
"""


class _Spans:
    """Rows of one partition in order, put together span by span. A subclass says which columns it needs, when a row begins a
    new span and what a span gives. Rows are plain tuples of the columns in ``needs``: a lookup by name costs more than the rest."""

    needs: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.span: list[tuple] = []
        self.before: tuple | None = None
        self.key: tuple | None = None
        self.pick: itemgetter | None = None

    @classmethod
    def fields(cls, table: T.StructType) -> list[T.StructField]:
        raise NotImplementedError

    @classmethod
    def described(cls, table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not isinstance(keys.value, str):
            raise ValueError("call it with TABLE(...) PARTITION BY ... ORDER BY ... and the names of the keys")
        named = [k.strip() for k in keys.value.split(",") if k.strip()]
        absent = [c for c in (*named, *cls.needs) if c not in table.dataType.names]
        if absent:
            raise ValueError(f"the table has no column {', '.join(absent)}")
        return AnalyzeResult(T.StructType([table.dataType[k] for k in named] + cls.fields(table.dataType)))

    def eval(self, row: Row, keys: str) -> Iterator[tuple]:
        values = tuple(row)
        if self.pick is None:
            names = row.__fields__
            self.pick = itemgetter(*[names.index(c) for c in self.needs])
            # The rows of a partition share their keys.
            self.key = tuple(values[names.index(k.strip())] for k in keys.split(",") if k.strip())
        made = self.step(self.pick(values))
        if made:
            yield from made

    def step(self, row: tuple) -> list[tuple]:
        """Take a row; what it ends and what belongs to no span."""
        out = self.aside(row)
        if self.span and self.breaks(row):
            out = out + self.close()
        self.span.append(row)
        self.before = row
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.span:
            yield from self.close()

    def close(self) -> list[tuple]:
        rows, self.span = self.span, []
        made = self.made(rows)
        return [] if made is None else [(*self.key, *made)]

    def aside(self, row: tuple) -> list[tuple]:
        """Output before a row that belongs to no span."""
        return []

    def breaks(self, row: tuple) -> bool:
        raise NotImplementedError

    def made(self, rows: list[tuple]) -> tuple | None:
        raise NotImplementedError


def _shared(speakers: set) -> Any:
    return speakers.pop() if len(speakers) == 1 else None


def _mean(values: list) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


class SqlWords(_Spans):
    """Words of pieces ``tok_idx, text, frame, confidence``; see :func:`voxlake.operators.words.tokens_to_words`."""

    needs = ("tok_idx", "text", "frame", "confidence")

    def __init__(self) -> None:
        super().__init__()
        self.ordinal = 0

    @classmethod
    def fields(cls, table: T.StructType) -> list[T.StructField]:
        kinds = {"word_ord": T.LongType(), "word": T.StringType(), "start": T.DoubleType(), "end": T.DoubleType(), "confidence": T.DoubleType()}
        return [T.StructField(n, t) for n, t in kinds.items()]

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        return SqlWords.described(table, keys)

    def breaks(self, row: tuple) -> bool:
        return row[1].startswith(WORD_BOUNDARY)

    def made(self, rows: list[tuple]) -> tuple | None:
        if rows[0][1].startswith(WORD_BOUNDARY):
            self.ordinal += 1
        said = [(text.removeprefix(WORD_BOUNDARY), frame) for _, text, frame, _ in rows]
        said = [x for x in said if x[0]]
        if not said:
            return None
        first, last = (float(said[i][1]) * SECONDS_PER_FRAME for i in (0, -1))
        known = [r[3] for r in rows if r[1].removeprefix(WORD_BOUNDARY)]
        return self.ordinal, "".join(t for t, _ in said), first, last, _mean(known)


class SqlSegments(_Spans):
    """Segments of words; see :func:`voxlake.operators.words.natural_segments`."""

    needs = ("word_idx", "word", "start", "end", "speaker", "confidence")

    @classmethod
    def fields(cls, table: T.StructType) -> list[T.StructField]:
        kinds = {
            "segment_start": table["word_idx"].dataType, "start": T.DoubleType(), "end": T.DoubleType(), "text": T.StringType(),
            "n_words": T.LongType(), "speaker": table["speaker"].dataType, "avg_confidence": T.DoubleType(),
        }
        return [T.StructField(n, t) for n, t in kinds.items()]

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        return SqlSegments.described(table, keys)

    def breaks(self, row: tuple) -> bool:
        _, word, _, end, speaker, _ = self.before
        return (
            row[2] - end > PAUSE_SECONDS
            or row[4] != speaker
            or word.rstrip(" ")[-1:] in (".", "!", "?")
            or row[3] - self.span[0][2] > MAX_SEGMENT_SECONDS
        )

    def made(self, rows: list[tuple]) -> tuple | None:
        text = " ".join([r[1] for r in rows])
        speaker = _shared({r[4] for r in rows})
        return rows[0][0], float(rows[0][2]), float(rows[-1][3]), text, len(rows), speaker, _mean([r[5] for r in rows])


class SqlCues(_Spans):
    """Caption cues of words; see :func:`voxlake.operators.words.caption_cues`."""

    needs = ("word_idx", "word", "start", "end", "speaker")

    def __init__(self) -> None:
        super().__init__()
        # Bytes of the open cue with its label and a space after each word.
        self.bytes = 0

    @classmethod
    def fields(cls, table: T.StructType) -> list[T.StructField]:
        kinds = {
            "cue_start": table["word_idx"].dataType, "cue_part": T.IntegerType(), "start": T.DoubleType(), "end": T.DoubleType(),
            "text": T.StringType(), "n_words": T.LongType(), "speaker": table["speaker"].dataType,
        }
        return [T.StructField(n, t) for n, t in kinds.items()]

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        return SqlCues.described(table, keys)

    @staticmethod
    def label(row: tuple) -> str:
        return "" if row[4] is None else f"[SPEAKER_{row[4]}] "

    def step(self, row: tuple) -> list[tuple]:
        out = super().step(row)
        if len(self.span) == 1:
            self.bytes = len(self.label(row))
        self.bytes += len(row[1].encode()) + 1
        return out

    def aside(self, row: tuple) -> list[tuple]:
        changed = self.before is None or row[4] != self.before[4]
        if not changed or not self.label(row) or len(self.label(row)) + len(row[1].encode()) + 1 <= CAPTION_BYTES:
            return []
        # What was open ends before the label.
        out = self.close() if self.span else []
        end = row[3] if self.before is None else self.before[3]
        return [*out, (*self.key, row[0], 0, float(row[2]), float(end), self.label(row).rstrip(" "), 0, None)]

    def breaks(self, row: tuple) -> bool:
        return row[4] != self.before[4] or len(self.span) >= CAPTION_WORDS or self.bytes + len(row[1].encode()) + 1 > CAPTION_BYTES + 1

    def made(self, rows: list[tuple]) -> tuple | None:
        text = (self.label(rows[0]) + " ".join([r[1] for r in rows])).rstrip(" ")
        return rows[0][0], 1, float(rows[0][2]), float(rows[-1][3]), text, len(rows), _shared({r[4] for r in rows})


def register_sql(spark: SparkSession) -> None:
    """Make the functions available to SQL."""
    spark.udf.register("word_edit_distance", distance_udf)
    spark.udf.register("word_errors", split_udf)
    for name, function in (("tokens_to_words", SqlWords), ("natural_segments", SqlSegments), ("caption_cues", SqlCues)):
        spark.udtf.register(name, udtf(function))
    spark.sql(AUDIO_WINDOWS)
    spark.sql(LABEL_WINDOWS)
