"""Manifests and transcript files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.expr import SPACES, is_blank, trimmed
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import number_rows

AUDIO_SUFFIXES = ["wav", "flac", "mp3", "opus"]
SHARD_SAMPLES = 50_000

_SAMPLE = [
    T.StructField("filename", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("duration", T.DoubleType()),
]
# An object manifest is one row with its samples; a bare list is one row per sample. Both fit this schema.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("audio_root", T.StringType()),
        T.StructField("samples", T.ArrayType(T.StructType(_SAMPLE))),
        *_SAMPLE,
        T.StructField("_corrupt", T.StringType()),
    ]
)


def resolve(base: Column, filename: Column, home: str = "~") -> Column:
    """``filename`` below ``base`` unless it is absolute, with ``~`` expanded."""
    joined = F.when(filename.startswith("/") | filename.startswith("~"), filename).otherwise(
        F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.regexp_replace(filename, r"^(\./)+", ""))
    )
    return F.regexp_replace(joined, "^~(?=/|$)", home)


def read_manifest(spark: SparkSession, paths: str | list[str], *, home: str = "~") -> DataFrame:
    """Samples ``manifest, sample_idx, filename, reference, duration`` of object and list manifests.

    Relative names resolve against ``audio_root`` or, for a bare list, the manifest's own folder. Anything that
    is neither layout raises.
    """
    raw = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(paths)
        .withColumn("manifest", F.col("_metadata.file_path"))
    )
    broken = F.raise_error(F.concat(F.lit("manifest is neither an object nor a list: "), F.col("manifest"))).cast("string")
    checked = raw.withColumn("dataset", F.when(F.col("_corrupt").isNotNull(), broken).otherwise(F.col("dataset")))
    base = F.coalesce("audio_root", F.lit("~"))
    objects = checked.filter("samples IS NOT NULL").select(
        "manifest", "dataset", base.alias("_base"), F.posexplode("samples").alias("sample_idx", "_s")
    )
    folder = F.regexp_replace("manifest", "^file:(//)?|/[^/]*$", "")
    lists = checked.filter("samples IS NULL AND (filename IS NOT NULL OR _corrupt IS NOT NULL)").select(
        "manifest",
        "dataset",
        folder.alias("_base"),
        # The id only has to follow the order inside one file.
        F.monotonically_increasing_id().alias("sample_idx"),
        F.struct("filename", "reference", "duration").alias("_s"),
    )
    both = objects.withColumn("sample_idx", F.col("sample_idx").cast("bigint")).unionByName(lists)
    return both.select(
        "manifest",
        "dataset",
        "sample_idx",
        resolve(F.col("_base"), F.col("_s.filename"), home).alias("filename"),
        F.coalesce("_s.reference", F.lit("")).alias("reference"),
        F.col("_s.duration").alias("duration"),
    )


def drop_empty_references(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Samples with a reference, and how many of each group had none."""
    blank = is_blank(F.col("reference"))
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if(blank).alias("skipped_empty_refs"))
    return samples.filter(~blank), counts


_SCAN_SCHEMA = T.StructType(
    [
        T.StructField("audio_root", T.StringType()),
        T.StructField("samples", T.ArrayType(T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def scan_corpora(manifests: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per manifest ``path, value``: ready with its entries and malformed entries, or unreadable and why.

    ``roots`` lists the audio roots that exist, where that is known.
    """
    parsed = manifests.withColumn(
        "_m", F.from_json("value", _SCAN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ).select("path", "value", "_m.*")
    if roots is not None:
        known = roots.select("audio_root", F.lit(True).alias("_exists"))
        parsed = safe_join(parsed, known, ["audio_root"], "left")
    absent = F.coalesce(~F.coalesce("_exists", F.lit(False)), F.lit(False)) if roots is not None else F.lit(False)
    is_object = F.substring(F.ltrim("value"), 1, 1) == "{"
    names = F.transform("samples", lambda s: F.get_json_object(s, "$.filename"))
    good = F.size(F.filter(names, lambda n: n.isNotNull() & (n != "")))
    why = (
        F.when(F.col("_corrupt").isNotNull() & (F.col("samples").isNull() | F.col("audio_root").isNull()), "parse failed")
        .when(~is_object | F.col("audio_root").isNull(), "manifest has no audio_root")
        .when(absent, F.concat(F.lit("audio_root absent: "), F.col("audio_root")))
        .when(F.col("samples").isNull(), "manifest has no samples[] array")
        .when(F.size("samples") == 0, "manifest samples[] is empty")
    )
    return parsed.select(
        "path",
        F.when(why.isNull(), "ready").otherwise("unreadable").alias("status"),
        why.alias("reason"),
        F.when(why.isNull(), good).alias("clips"),
        F.when(why.isNull(), F.size("samples") - good).alias("malformed"),
    )


def parse_csv_manifest(lines: DataFrame) -> DataFrame:
    """``wav, txt, duration`` lines; rows of another width are dropped and fields trimmed."""
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = F.transform(
        F.split("value", outside_quotes), lambda f: F.trim(F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"')))
    )
    split = lines.withColumn("_f", fields).filter(F.size("_f") == 3)
    return split.select(
        *[c for c in lines.columns if c != "value"],
        F.get("_f", F.lit(0)).alias("wav"),
        F.get("_f", F.lit(1)).alias("txt"),
        F.get("_f", F.lit(2)).cast("double").alias("duration"),
    )


def parse_transcript_lines(lines: DataFrame) -> DataFrame:
    """``id text`` lines, text in lower case; lines without both parts are dropped."""
    split = lines.withColumn("_p", F.split("value", " ", 2))
    text = F.lower(F.regexp_replace(F.get("_p", F.lit(1)), f"^{SPACES}|{SPACES}$", ""))
    named = split.select(*[c for c in lines.columns if c != "value"], F.get("_p", F.lit(0)).alias("utt_id"), text.alias("reference"))
    return named.filter((F.col("utt_id") != "") & (F.col("reference") != ""))


def join_references(references: DataFrame, audio: DataFrame) -> DataFrame:
    """References next to their audio files, by utterance id."""
    return references.join(audio, "utt_id", "inner")


def find_transcripts(lines: DataFrame, audio: DataFrame) -> DataFrame:
    """Pairs ``audio, reference`` under the first transcript layout that yields any.

    ``lines`` has ``path, line_no, value``; ``audio`` has ``path``. Layouts: ``*.trans.txt`` next to the audio,
    two-column ``*.tsv`` in either order, a ``.txt`` with the audio's stem.
    """
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    body = F.trim("value")
    files = audio.select(F.col("path").alias("audio"))

    trans = lines.filter(F.col("path").endswith(".trans.txt")).withColumn("_p", F.split(body, SPACES, 2))
    trans = trans.filter(F.size("_p") == 2).select(
        F.concat(folder, F.get("_p", F.lit(0))).alias("_stem"), F.get("_p", F.lit(1)).alias("reference")
    )
    suffix = F.lower(F.regexp_extract("audio", r"\.([^./]*)$", 1))
    ranked = files.withColumns(
        {"_stem": F.regexp_replace("audio", r"\.[^./]*$", ""), "_rank": F.array_position(F.array(*map(F.lit, AUDIO_SUFFIXES)), suffix)}
    ).filter("_rank > 0")
    best = ranked.groupBy("_stem").agg(F.min_by("audio", "_rank").alias("audio"))
    first = trans.join(best, "_stem").select(F.lit(1).alias("_layout"), "audio", "reference")

    header = (F.col("line_no") == 0) & F.lower("value").rlike("path|file")
    tsv = lines.filter(F.col("path").endswith(".tsv") & ~header).withColumn("_c", F.split("value", "\t")).filter(F.size("_c") >= 2)
    either = tsv.select(
        "path",
        "line_no",
        folder.alias("_folder"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("o"), F.get("_c", F.lit(0)).alias("a"), F.get("_c", F.lit(1)).alias("t")),
                F.struct(F.lit(1).alias("o"), F.get("_c", F.lit(1)).alias("a"), F.get("_c", F.lit(0)).alias("t")),
            )
        ).alias("_e"),
    )
    target = F.when(F.col("_e.a").startswith("/"), F.col("_e.a")).otherwise(F.concat("_folder", "_e.a"))
    matched = either.withColumn("audio", target).join(ranked.select("audio"), "audio")
    second = matched.groupBy("path", "line_no").agg(
        F.min_by(F.struct("audio", F.trim("_e.t").alias("reference")), "_e.o").alias("_b")
    )
    second = second.select(F.lit(2).alias("_layout"), "_b.audio", "_b.reference")

    texts = lines.filter(F.col("path").endswith(".txt") & ~F.col("path").endswith(".trans.txt"))
    # A reference is one value, so a file's lines are put together here.
    body_lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"])
    whole = texts.groupBy("path").agg(trimmed(F.array_join(body_lines, "\n")).alias("reference"))
    third = whole.withColumn("_stem", F.regexp_replace("path", r"\.txt$", "")).join(ranked.select("_stem", "audio"), "_stem")
    third = third.filter("reference <> ''").select(F.lit(3).alias("_layout"), "audio", "reference")

    pairs = first.unionByName(second).unionByName(third)
    # One row: the layout that wins.
    winner = pairs.agg(F.min("_layout").alias("_layout"))
    return pairs.join(F.broadcast(winner), "_layout").drop("_layout")


def seeded_slice(rows: DataFrame, key: str, *, seed: int, n: int) -> DataFrame:
    """A slice of ``n`` rows that depends on the seed and the keys only, not on the layout of the data."""
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(ticket, key).limit(n)


def write_manifest(samples: DataFrame, path: str, header: dict[str, str | int], *, order: str, shard: int = SHARD_SAMPLES) -> None:
    """Write samples as object manifests under ``path``, each with the provenance header.

    A manifest holds at most ``shard`` samples; a larger set becomes several manifests that read back as one.
    """
    numbered = number_rows(samples, [order], "_rn").withColumn("_shard", F.floor((F.col("_rn") - 1) / shard))
    fields = [c for c in ("filename", "reference", "duration") if c in samples.columns]
    packed = numbered.groupBy("_shard").agg(F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("_s"))
    listed = F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("samples")
    rows = packed.select(F.col("_shard").alias("shard"), *[F.lit(v).alias(k) for k, v in header.items()], listed)
    # One manifest per file: a multi-line reader takes one document from each.
    rows.repartition("shard").write.partitionBy("shard").json(path)


def read_speech_shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parquet speech shards ``id, text, audio.bytes`` as ``id, reference, content``; only those columns are read."""
    return speech_samples(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)))


def speech_samples(shards: DataFrame) -> DataFrame:
    """``id, reference, content`` of a shard relation."""
    return shards.select("id", F.col("text").alias("reference"), F.col("audio.bytes").alias("content"))
