"""File discovery, container headers and audio framing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.sources.wav_headers import header_of

# Audio extensions accepted by batch runs.
EXTENSIONS = ["wav", "mp3", "m4a", "ogg", "flac", "webm"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: ``path, len, mtime``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("len"), F.col("modificationTime").alias("mtime"))


def audio_files(listing: DataFrame, *, exclude: str | None = None) -> DataFrame:
    """Listed files with an audio extension, in path order, without those below ``exclude``."""
    kept = listing.filter(F.lower("path").rlike(rf"[^/]\.({'|'.join(EXTENSIONS)})$"))
    if exclude:
        below = F.col("path").startswith(exclude.rstrip("/") + "/")
        kept = kept.filter(~below)
    return kept.orderBy("path")


def sniff_container(content: Column) -> Column:
    """Extension from the first bytes of a file; ``wav`` if nothing else fits."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when((head(1, 4) == "52494646") & (head(9, 4) == "57415645"), "wav")
        .when((head(1, 3) == "494433") | (head(1, 2) == "FFFB"), "mp3")
        .when(head(1, 4) == "664C6143", "flac")
        .when(head(1, 4) == "4F676753", "ogg")
        .otherwise("wav")
    )


#: Chunks that are looked at in the JVM; a content whose format and data come later is walked by a Python function.
WALKED_CHUNKS = 32


_HEADER = T.StructType([T.StructField("rate", T.LongType()), T.StructField("channels", T.IntegerType()), T.StructField("frames", T.LongType())])
_walked = F.udf(lambda content: header_of(content) if content is not None else None, _HEADER, useArrow=True)


def _unsigned(content: Column, at: Column, size: int) -> Column:
    """Little-endian number of ``size`` bytes that begins at byte ``at`` (from zero); null beyond the end."""
    raw = F.substring(content, at.cast("int") + 1, F.lit(size))
    bytes_ = F.split(F.regexp_replace(F.hex(raw), "(..)(?=.)", "$1,"), ",")
    return F.when(F.octet_length(raw) == size, F.conv(F.array_join(F.reverse(bytes_), ""), 16, 10).cast("bigint"))


def wav_header(content: Column) -> Column:
    """Struct of rate, channels and frames, null where the bytes are no WAV file with sample data.

    A RIFF file is a list of chunks: a name of four bytes, a size, and the content padded to an even size. The walk keeps
    the place of the next chunk, until it has met the format and the data. For files in a folder see ``wav_headers``.
    """
    riff = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645")
    none = F.lit(None).cast("bigint")
    names = ("rate", "channels", "bits", "size")
    start = F.struct(F.lit(12).cast("bigint").alias("at"), *[none.alias(n) for n in names])

    def walk(state: Column, _: Column) -> Column:
        at = state["at"]
        name = F.hex(F.substring(content, at.cast("int") + 1, F.lit(4)))
        size = _unsigned(content, at + 4, 4)
        is_format = (name == "666D7420") & state["rate"].isNull()
        is_data = (name == "64617461") & state["size"].isNull()
        done = (state["size"].isNotNull() & state["rate"].isNotNull()) | at.isNull()
        moved = F.struct(
            (at + 8 + size + size % 2).alias("at"),  # null at the end
            F.when(is_format, _unsigned(content, at + 12, 4)).otherwise(state["rate"]).alias("rate"),
            F.when(is_format, _unsigned(content, at + 10, 2)).otherwise(state["channels"]).alias("channels"),
            F.when(is_format, _unsigned(content, at + 22, 2)).otherwise(state["bits"]).alias("bits"),
            F.when(is_data, size).otherwise(state["size"]).alias("size"),
        )
        return F.when(done, state).otherwise(moved)

    def finish(state: Column) -> Column:
        width = F.floor(state["bits"] / 8) * F.greatest(state["channels"], F.lit(1))
        whole = riff & (width > 0) & (state["rate"] > 0) & state["size"].isNotNull()
        found = F.struct(
            F.when(whole, state["rate"]).alias("rate"),
            F.when(whole, state["channels"].cast("int")).alias("channels"),
            F.when(whole, F.floor(state["size"] / width)).alias("frames"),
        )
        open_ = riff & state["at"].isNotNull() & (state["size"].isNull() | state["rate"].isNull())
        return F.struct(found.alias("found"), F.coalesce(open_, F.lit(False)).alias("open"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKED_CHUNKS)), start, walk, finish)
    rest = _walked(F.when(end["open"], content))
    return F.when(end["open"], F.coalesce(rest, F.struct(none.alias("rate"), none.cast("int").alias("channels"), none.alias("frames")))).otherwise(end["found"])


def pcm_frames(recordings: DataFrame, content: str, *, chunk_ms: int = 100, rate: int = 16_000) -> DataFrame:
    """Consecutive frames ``chunk_idx, frame`` of PCM16 bytes; the last may be short, empty input has none."""
    size = max(1, rate * chunk_ms // 1000 * 2)
    last = F.floor((F.octet_length(content) - 1) / size)
    cut = recordings.filter(F.octet_length(content) > 0).withColumn(
        "chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    piece = F.substring(F.col(content), (F.col("chunk_idx") * size + 1).cast("int"), F.lit(size))
    return cut.withColumn("frame", piece).drop(content)


def _little_endian(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit((1 << 8 * size) - 1))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def wav_bytes(samples: Column, rate: int = 16_000, channels: int = 1) -> Column:
    """A PCM16 WAV file from an array of sample values."""
    size = F.size(samples) * 2
    head = [
        F.lit("52494646"),
        _little_endian(size + 36, 4),
        F.lit("57415645666D7420"),
        _little_endian(F.lit(16), 4),
        _little_endian(F.lit(1), 2),
        _little_endian(F.lit(channels), 2),
        _little_endian(F.lit(rate), 4),
        _little_endian(F.lit(rate * channels * 2), 4),
        _little_endian(F.lit(channels * 2), 2),
        _little_endian(F.lit(16), 2),
        F.lit("64617461"),
        _little_endian(size, 4),
    ]
    return F.unhex(F.concat(*head, F.array_join(F.transform(samples, lambda v: _little_endian(v, 2)), "")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """State of each path between two listings: new, changed, unchanged or vanished."""
    b = before.select("path", F.struct("len", "mtime").alias("_before"))
    a = after.select("path", F.struct("len", "mtime").alias("_after"))
    state = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_after").isNull(), "vanished")
        .when(F.col("_before") == F.col("_after"), "unchanged")
        .otherwise("changed")
    )
    return b.join(a, "path", "full_outer").select("path", state.alias("state"))
