"""Transcript sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """File name without folder and last extension; ``transcript`` if that leaves nothing."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(stem == "", "transcript").otherwise(stem)


def output_name(path: Column, extension: Column | str) -> Column:
    """``<stem>.<ext>``."""
    return F.concat(file_stem(path), F.lit("."), F.lit(extension) if isinstance(extension, str) else extension)


def duplicate_outputs(inputs: DataFrame, formats: list[str]) -> DataFrame:
    """Output names that more than one input would write, with their number of inputs."""
    named = inputs.select(
        F.explode(F.array(*[output_name(F.col("path"), f) for f in formats])).alias("output")
    )
    return named.groupBy("output").agg(F.count(F.lit(1)).alias("inputs")).filter("inputs > 1")


def write_documents(documents: DataFrame, path: str) -> None:
    """Write ``output, format, part, document`` rows below ``path/format=…/output=…``.

    Each output has its own folder with its parts in order; parts are bounded, so a very long recording is
    several rows of the same folder.
    """
    ordered = documents.repartition("format", "output").sortWithinPartitions("format", "output", "part")
    ordered.select("format", "output", F.col("document").alias("value")).write.partitionBy("format", "output").option(
        "lineSep", "\n"
    ).text(path)
