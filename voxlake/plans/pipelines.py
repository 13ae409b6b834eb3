"""End-to-end pipelines built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.expr import let, words_of
from voxlake.functions.numbers import apply_itn
from voxlake.functions.text import apply_label, normalize_for_wer, normalize_verbatim
from voxlake.operators import bootstrap, scoring
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import BLOCK_ROWS, gather_text
from voxlake.operators.windows import label_windows
from voxlake.session import materialize

#: Windows that go through a labeller at a time.
LABEL_ROWS = 256


def label_words(windows: DataFrame, keys: list[str], make_labeller: Callable[[], Callable]) -> DataFrame:
    """``windows`` with ``labels``, one for each of a window's ``words``; null for a window whose labelling fails.

    The labeller takes a list of words and returns one label per word.
    """
    schema = T.StructType([*windows.schema.fields, T.StructField("labels", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = make_labeller()
        for batch in batches:
            for at in range(0, batch.num_rows, LABEL_ROWS):
                some, made = batch.slice(at, LABEL_ROWS), []
                for words in some.column("words").to_pylist():
                    try:
                        made.append(list(labeller(words)))
                    except Exception:  # noqa: BLE001
                        made.append(None)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.list_(pa.string()))], names=schema.names)

    return windows.mapInArrow(run, schema)


def restore_readable(
    transcripts: DataFrame, keys: list[str], make_labeller: Callable[[], Callable], *, text: str = "text", itn: bool = True
) -> DataFrame:
    """Numbers to digits, then casing and punctuation from window labels: ``keys, part, text``.

    Words of failed windows come back bare; an empty text stays empty. A window shows the words it keeps by itself, so
    stretches of text are shuffled, not words.
    """
    body = apply_itn(F.col(text)) if itn else F.col(text)
    worded = materialize(transcripts.select(*keys, words_of(body).alias("_words")), "readable-words")
    sizes = worded.select(*keys, F.size("_words").cast("bigint").alias("n_words"), "_words")
    plan = label_windows(sizes, "n_words")
    cut = F.slice("_words", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    cut_plan = plan.select(*keys, "start", "keep_start", "keep_end", cut.alias("words"))
    labelled = label_words(cut_plan, keys, make_labeller)
    # What a window keeps may go over the edge of a part.
    part = F.explode(F.sequence(F.floor(F.col("keep_start") / BLOCK_ROWS), F.floor((F.col("keep_end") - 1) / BLOCK_ROWS)))
    placed = labelled.withColumn("_part", part).withColumn("_at", F.greatest("keep_start", F.col("_part") * BLOCK_ROWS))
    offset = (F.col("_at") - F.col("start")).cast("int")
    n = (F.least("keep_end", (F.col("_part") + 1) * BLOCK_ROWS) - F.col("_at")).cast("int")

    def shown(word: Column, label: Column) -> Column:
        # Most words stay as they are.
        return F.when(F.coalesce(label, F.lit("LOWER_O")) == "LOWER_O", word).otherwise(let(label, lambda x: apply_label(word, x)))

    stretches = placed.select(
        *keys, "_at", F.slice("words", offset + 1, n).alias("_said"), F.slice("labels", offset + 1, n).alias("_labels")
    )
    # A labeller may give too few labels; a failed window has none.
    stretch = F.array_join(F.coalesce(F.zip_with("_said", "_labels", shown), F.col("_said")), " ")
    return gather_text(stretches.select(*keys, "_at", stretch.alias("_text")), keys, ["_at"], F.col("_text"), " ", index="_at")


def rescore(results: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """Stored ``reference, hypothesis`` pairs under the current normalizers, with intervals for both rates."""
    normalized = {
        "ref": normalize_for_wer(F.col("reference")),
        "hyp": normalize_for_wer(F.col("hypothesis")),
        "naive_ref": normalize_verbatim(F.col("reference")),
        "naive_hyp": normalize_verbatim(F.col("hypothesis")),
    }
    scored = scoring.score_pairs(results.withColumns(normalized))
    scored = scoring.score_pairs(scored, "naive_ref", "naive_hyp", "naive_")
    slim = scored.select(*keys, order, "errors", "ref_words", "naive_errors", "naive_ref_words")
    details = materialize(slim, "rescored")
    ci = bootstrap.wer_interval(details, keys, [order], block)
    naive = details.select(*keys, order, F.col("naive_errors").alias("errors"), F.col("naive_ref_words").alias("ref_words"))
    naive_ci = bootstrap.wer_interval(naive, keys, [order], block).withColumnsRenamed(
        {"ci_low": "naive_ci_low", "ci_high": "naive_ci_high"}
    )
    return safe_join(safe_join(scoring.corpus_wer(details, keys), ci, keys), naive_ci, keys)
