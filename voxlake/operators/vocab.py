"""Subword jobs over a vocabulary that is shipped with the task.

A vocabulary is a dictionary of at most ``MAX_PIECES`` entries, checked before it is shipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.expr import words_of

WORD_BOUNDARY = "▁"
SPECIAL = ("<blk>", "<unk>", "")
MAX_PIECES = 1_000_000
MAX_WORD_CHARS = 100
UNKNOWN = "[UNK]"

PIECES_TYPE = T.StructType(
    [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("spelling", T.StringType())]
)


def _checked(vocab: dict[str, int]) -> dict[str, int]:
    if len(vocab) > MAX_PIECES:
        raise ValueError(f"vocabulary of {len(vocab)} entries exceeds {MAX_PIECES}")
    return dict(vocab)


def _longest(text: str, at: int, vocab: dict[str, int], longest: int, prefix: str = "") -> int:
    """Length of the longest entry that matches at a position; zero if none does."""
    for size in range(min(longest, len(text) - at), 0, -1):
        if prefix + text[at : at + size] in vocab:
            return size
    return 0


def encode_phrase(phrase: str, vocab: dict[str, int], longest: int) -> list[int] | None:
    """Piece ids of a phrase, greedy and longest first; None if a character has no piece."""
    phrase = phrase.strip()
    marked = WORD_BOUNDARY + "".join(WORD_BOUNDARY if c.isspace() else c for c in phrase) if phrase else ""
    ids, at = [], 0
    while at < len(marked):
        size = _longest(marked, at, vocab, longest)
        if size:
            ids.append(vocab[marked[at : at + size]])
        elif marked[at] != WORD_BOUNDARY:
            return None
        at += max(size, 1)
    return ids or None


def phrase_to_pieces(phrase: Column, vocab: dict[str, int]) -> Column:
    """Struct of piece ids and the spelling that worked: as written, lower case, then with yo folded."""
    known = {p: i for p, i in _checked(vocab).items() if p not in SPECIAL}
    longest = max(map(len, known), default=0)

    @F.pandas_udf(PIECES_TYPE)
    def encode(phrases: pd.Series) -> pd.DataFrame:
        rows = []
        for text in phrases:
            found = (None, None)
            for spelling in dict.fromkeys([text, text.lower(), text.lower().replace("ё", "е")]) if text is not None else ():
                ids = encode_phrase(spelling, known, longest)
                if ids is not None:
                    found = (ids, spelling)
                    break
            rows.append(found)
        return pd.DataFrame(rows, columns=PIECES_TYPE.names)

    return encode(phrase)


# Characters set apart as words of their own (punctuation of any script, the ASCII symbols, and the
# ideograph ranges), and characters dropped (controls other than tab and line ends, format, private use, U+FFFD).
APART = (
    r"[\p{P}$+<=>^`|~\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
)
DROPPED = r"[[\p{Cc}\p{Cf}\p{Co}\x{FFFD}]&&[^\t\n\r]]"


def split_words(text: Column) -> Column:
    """Words of cleaned text, with every punctuation mark and ideograph on its own."""
    return words_of(F.regexp_replace(F.regexp_replace(text, DROPPED, ""), f"({APART})", " $1 "))


def word_pieces(word: str, vocab: dict[str, int], longest: int, unknown: int) -> list[int]:
    """Greedy longest-match pieces; a word that cannot be covered is one unknown piece."""
    ids, at = [], 0
    while at < len(word) <= MAX_WORD_CHARS:
        prefix = "##" if at else ""
        size = _longest(word, at, vocab, longest, prefix)
        if not size:
            return [unknown]
        ids.append(vocab[prefix + word[at : at + size]])
        at += size
    return ids or [unknown]


def subword_ids(text: Column, vocab: dict[str, int]) -> Column:
    """Piece ids of every word: one array per word. Repeated words are looked up once per batch, and a batch stays in Arrow's
    form: Python sees its different words only."""
    known = _checked(vocab)
    longest, unknown = max(map(len, known), default=0), known[UNKNOWN]

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def encode(batch: pa.Array) -> pa.Array:
        words = batch.flatten().dictionary_encode()
        pieces = [word_pieces(w, known, longest, unknown) for w in words.dictionary.to_pylist()]
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(pieces, pa.list_(pa.int32())).take(words.indices), mask=batch.is_null())

    return encode(split_words(text))


def subword_tokens(documents: DataFrame, key: str, text: str, vocab: dict[str, int]) -> DataFrame:
    """Tokens ``position, word_idx, token_id`` of whole documents."""
    words = documents.select(key, subword_ids(F.col(text), vocab).alias("_w"))
    flat = F.flatten(F.transform("_w", lambda ids, w: F.transform(ids, lambda i: F.struct(w.alias("w"), i.alias("i")))))
    return words.select(key, F.posexplode(flat).alias("position", "_t")).select(
        key, "position", F.col("_t.w").alias("word_idx"), F.col("_t.i").alias("token_id")
    )


def token_counts(documents: DataFrame, key: str, text: str, vocab: dict[str, int]) -> DataFrame:
    """Tokens, words and unknown pieces per document, without a shuffle."""
    words = documents.select(key, subword_ids(F.col(text), vocab).alias("_w"))
    total = lambda f: F.aggregate("_w", F.lit(0).cast("bigint"), lambda acc, ids: acc + f(ids))
    return words.select(
        key,
        total(F.size).alias("n_tokens"),
        F.size("_w").cast("bigint").alias("n_words"),
        total(lambda ids: F.size(F.filter(ids, lambda i: i == vocab[UNKNOWN]))).alias("n_unknown"),
    )
