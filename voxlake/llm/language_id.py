"""Language identification by compression.

Each language has a zstandard dictionary of raw content: snippets of its training texts. A text is compressed with every
dictionary, and the one that makes it smallest names the language. Where the best two are close the answer is marked as
rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import small_batches

#: The sample behind a dictionary: at most so many snippets a language, of so many characters each.
SNIPPETS, SNIPPET_CHARS = 800, 160
LEVEL = 6
#: Long texts are compressed in blocks, so that each block leans on the dictionary and not on the text before it.
BLOCK = 4096
#: Least gap between the best two sizes, as a share of the best.
MARGIN = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def fit_dictionaries(labelled: DataFrame, snippets: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> dict[str, bytes]:
    """A dictionary for each language of ``lang, text``, from the distinct snippets that come first by a hash of their text.

    The sample is bounded by ``snippets * chars`` characters a language and is all that comes to the driver. Rows without a
    language or without a letter are left out.
    """
    rows = labelled.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    parts = rows.select("lang", F.substring(F.col("text"), start, F.lit(chars)).alias("part"))
    ranked = parts.select("lang", "part", F.xxhash64("part").alias("h"))
    # Low hashes first. About twice the snippets pass the sieve, so that ranking stays small however many rows there are.
    # Copies of a snippet are one: they are combined before the shuffle and count once.
    ranked = ranked.distinct()
    sieve = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    slots = 1 << 30
    few = ranked.join(sieve, "lang").filter(F.pmod("h", F.lit(slots)) * F.col("n") <= F.lit(2.0 * snippets * slots) + 100.0 * slots)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(slots)), "part"))
    first = few.withColumn("r", place).filter(F.col("r") <= snippets)
    by_lang: dict[str, list] = {}
    for row in first.select("lang", "r", "part").collect():
        by_lang.setdefault(row.lang, []).append((row.r, row.part))
    return {lang: "\n".join(p for _, p in sorted(found)).encode() for lang, found in sorted(by_lang.items())}


class Classifier:
    """Compressors by language. The first of equal sizes wins, in the order of the names."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the share of the best under 2 ** -bytes), and whether the margin is too narrow."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(sizes)
        rest = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        score = 1.0 / sum(2.0 ** max(-1000, best - s) for s in sizes)
        return self.langs[sizes.index(best)], score, rest - best < MARGIN * best


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every whole text; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0. Rows are judged one by one, repeated rows alike. Without
    any dictionary every text is ``und``.
    """
    small_batches(docs.sparkSession)
    models: list[Classifier] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not models:
            models.append(Classifier(dictionaries))
        for pdf in batches:
            found = [models[0].predict(t) for t in pdf["text"]]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": list(lang), "score": list(score), "rejected": list(rejected)})

    schema = "doc_id string, lang_pred string, score double, rejected boolean"
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


