"""Toxicity with noisy-channel deobfuscation.

Writers hide words by look-alike characters, by spaces or dots between letters, and by repeating letters. A hidden word
spells a lattice: every observed character is a choice of letters, a run of one letter may stand for one or two, separators
between letters stand for nothing or end a word. The Viterbi path through the lattice under a character trigram model is the restored word or words. The restored
text is scored by words that mark toxic texts.

The character model counts every text of the corpus. The word weights are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import MEMO, MEMO_BYTES, small_batches, text_chunks
from voxlake.session import materialize

#: Labelled rows the word weights are fitted on, in expectation.
SAMPLE_ROWS = 20_000
#: Words and prefixes the model keeps at most, the ones with most support.
MODEL_FEATURES = 20_000
#: Documents a feature must be in, and the least share of toxic ones among them.
SUPPORT, SHARE, STEM_SHARE = 8, 0.8, 0.93
#: What makes a feature strong: its share of toxic documents, and the part of all toxic documents it is in.
STRONG_SHARE, STRONG_PART = 0.95, 0.015
#: Features a task adds up before it sends them, and words whose features it remembers.
HELD_FEATURES, HELD_WORDS = 1 << 16, 1 << 15
#: Score of a text without any marked word.
BASE = 0.02

# Look-alikes of letters.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "¢": "c", "§": "s", "µ": "u",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzßäöüéèêëçñáíóúàâîïôûùœæãõåø"
CLASSES, OTHER, TABLE_SIZE = 64, 63, 0x250
#: What stands for a letter when letters are spaced out (signs that may be punctuation not at the ends), and what spaces.
SIGN, EDGE, SPACE = r"(?:[^\W_]|[@$€£¢§!|+¡*])", r"(?:[^\W_]|[@$€£¢§])", r"[ .\-_*·/|,~]{1,2}"
SPACED = re.compile(rf"(?<!\w){EDGE}(?:{SPACE}{SIGN})+{SPACE}{EDGE}(?!\w)")
SPACED_SIGN = re.compile(rf"({SIGN})({SPACE}(?={SIGN})|\Z)")
#: Log weight of a space inside a word that is wider than others between its letters.
WIDE = -3.0
REPEATED = re.compile(r"([^\W\d_])\1\1")
INNER = re.compile(r"[^\W\d_]")
#: ASCII punctuation that ends a word; look-alikes and word characters stay.
BREAKS = bytes(32 if chr(i) in ".,;:?\"'()[]{}<>/\\~`^&%#=-_" else i for i in range(256))


def class_table() -> np.ndarray:
    """Class of each low code point: 0 outside words, a letter of LETTERS, or another letter."""
    out = np.zeros(TABLE_SIZE + 1, np.uint8)
    for i in range(TABLE_SIZE):
        c = chr(i).lower()
        out[i] = 1 + LETTERS.index(c) if c in LETTERS else (OTHER if c.isalpha() else 0)
    out[TABLE_SIZE] = OTHER
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter-class trigrams over all texts. Tasks add up their own; CLASSES ** 3 numbers come back."""
    small_batches(docs.sparkSession)
    size, pieces = CLASSES**3, 16
    step = size // pieces

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = class_table(), np.zeros(size, np.int64)
        for pdf in batches:
            for texts in text_chunks(pdf["text"].tolist()):
                text = " " + " ".join(texts) + " "
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                c = table[np.minimum(codes, TABLE_SIZE)].astype(np.int32)
                total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=size)
        yield pd.DataFrame({"k": range(pieces), "counts": [zlib.compress(total[i * step : (i + 1) * step].tobytes(), 1) for i in range(pieces)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"]), np.zeros(step, np.int64))
        return pd.DataFrame({"k": pdf["k"][:1], "counts": [total.tobytes()]})

    parts = docs.filter("text is not null").select("text").mapInPandas(count, "k int, counts binary")
    out = np.zeros(size, np.int64)
    for row in parts.groupBy("k").applyInPandas(add, "k int, counts binary").collect():
        out[row.k * step : (row.k + 1) * step] = np.frombuffer(row.counts, np.int64)
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a class after two others, trigrams mixed with bigrams and a flat floor."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    bi = tri.sum(0)
    p2 = (bi + 0.1) / (bi.sum(1, keepdims=True) + 0.1 * CLASSES)
    p3 = tri / np.maximum(tri.sum(2, keepdims=True), 1)
    return np.log(0.85 * p3 + 0.15 * p2[None])


class Restorer:
    """Restores hidden words under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.code = {c: 1 + i for i, c in enumerate(LETTERS)} | {" ": 0}

    def decode(self, shown: str) -> str:
        """The best path through the lattice of ``shown`` (lower case)."""
        runs, i = [], 0
        while i < len(shown):
            j = i
            while j < len(shown) and shown[j] == shown[i]:
                j += 1
            runs.append((shown[i], j - i))
            i = j
        # A separator stands for nothing.
        return self.best([self.options(c, n) for c, n in runs if c.isalpha() or c in LOOK_ALIKES])

    def spaced(self, shown: str) -> list[str]:
        """The words on the best path of spaced-out letters: each space is inside a word or ends one."""
        parts = SPACED_SIGN.findall(shown.lower())
        narrow = min(len(space) for _, space in parts[:-1])
        steps = []
        for c, space in parts:
            if c.isalpha() or c in LOOK_ALIKES:
                steps.append(self.options(c, 1))
            if space:
                steps.append([("", WIDE if len(space) > narrow else 0.0), (" ", 0.0)])
        return self.best(steps).split()

    @staticmethod
    def options(c: str, n: int) -> list[tuple[str, float]]:
        """What a run of ``n`` equal characters may stand for, with log weights."""
        if c.isalpha():
            return [(c * k, p) for k, p in {1: -0.3, 2: -1.0, n: -2.0 if n > 2 else -0.1}.items() if k <= n]
        alike = LOOK_ALIKES[c]
        return [(a * k, -math.log(len(alike)) - (0.3 if k == 1 else 1.0)) for a in alike for k in range(1, min(n, 2) + 1)]

    def best(self, steps: list[list[tuple[str, float]]]) -> str:
        """The best choice of letters, one option a step."""
        code, model = self.code, self.model
        # (class before last, last class) -> (log probability, path); a path is a linked list of letters.
        beam = {(0, 0): (0.0, None)}
        for options in steps:
            found: dict = {}
            for (a, b), (score, path) in beam.items():
                for letters, p in options:
                    x, y, s, way = a, b, score + p, path
                    for letter in letters:
                        z = code.get(letter, OTHER)
                        s += model[x][y][z]
                        x, y, way = y, z, (way, letter)
                    if (x, y) not in found or s > found[x, y][0]:
                        found[x, y] = (s, way)
            beam = found
        _, path = max(((s + model[a][b][0], way) for (a, b), (s, way) in beam.items()), key=lambda t: t[0])
        out = []
        while path is not None:
            path, letter = path
            out.append(letter)
        return "".join(reversed(out))

    @staticmethod
    def core(word: str) -> str:
        """A word in lower case without what stands around it."""
        return word.lower().strip("*|+·—–…«»“”’‘¡,.;:?()[]\"'").rstrip("!")

    @staticmethod
    def hidden(core: str) -> bool:
        return bool(INNER.search(core)) and (any(c in LOOK_ALIKES for c in core) or bool(REPEATED.search(core)))

    def word(self, word: str) -> str:
        """A word as it was meant, in lower case; plain words stay."""
        core = self.core(word)
        return self.decode(core) if self.hidden(core) else core

    def text(self, text: str) -> str:
        """The whole text with hidden words restored; all else stays as it is."""

        def restored(m: re.Match) -> str:
            core = self.core(m[0])
            if not self.hidden(core):
                return m[0]
            before, _, after = m[0].lower().partition(core)
            return before + self.decode(core) + after

        def joined(m: re.Match) -> str:
            words = self.spaced(m[0]) if INNER.search(m[0]) else []
            return " ".join(words) if any(len(w) > 1 for w in words) else m[0]

        return re.sub(r"\S+", restored, SPACED.sub(joined, text))

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text, and those its spaced-out letters spell."""
        raw = text.encode("utf-8", "replace").translate(BREAKS).lower().split()
        found = set(raw)
        for m in SPACED.finditer(text):
            if INNER.search(m[0]):
                words = self.spaced(m[0])
                found.update(w.encode() for w in (*words, "".join(words)))
        return found


def features(word: str) -> list[str]:
    """A word and its first letters, which a stem shares with its forms."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def fit_words(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weight -log(1 - p) of each feature that marks toxic texts.

    ``labels``: ``doc_id, toxic``. About ``sample_rows`` labelled rows are used, chosen by a hash of the id; copies
    count once. The fit has two rounds: strong features first, then what the toxic texts without a strong one have in
    common. Whatever else a text with a strong feature says needs no blame.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample is bounded, and several passes read it.
    rows = materialize(docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")
    # Copies, also edited ones, mostly share the sentence with the least hash. One of them is enough, or its rare words
    # would look like marks of toxic texts. Edited copies may differ in that sentence, so three hashes are tried.
    sentences = F.filter(F.split("text", r"[.\n]"), lambda s: F.length(s) > 20)
    marks = {f"mark{i}": F.coalesce(F.array_min(F.transform(sentences, lambda s, i=i: F.xxhash64(F.lit(i), s))), F.xxhash64("text")) for i in range(3)}
    single = rows.select("doc_id", *(c.alias(k) for k, c in marks.items()))
    for k in marks:
        single = single.dropDuplicates([k])
    rows = rows.join(F.broadcast(single.select("doc_id").distinct()), "doc_id")

    def counts(strong: frozenset) -> DataFrame:
        tallied = rows.mapInPandas(lambda batches: tally(batches, strong), "feature string, pos long, neg long")
        total = tallied.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        return total.withColumn("p", F.col("pos") / (F.col("pos") + F.col("neg") + 1.0))

    def tally(batches: Iterator[pd.DataFrame], strong: frozenset) -> Iterator[pd.DataFrame]:
        restorer, memo, seen = Restorer(model), {}, {}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                found = set()
                for w in restorer.words(text):
                    said = memo.get(w)
                    if said is None:
                        said = features(restorer.word(w.decode("utf-8", "replace")))
                        if len(w) <= MEMO_BYTES:
                            if len(memo) >= HELD_WORDS:
                                memo.clear()
                            memo[w] = said
                    found.update(said)
                if toxic > 0 and not strong.isdisjoint(found):
                    continue
                for f in found:
                    seen.setdefault(f, [0, 0])[0 if toxic > 0 else 1] += 1
                if len(seen) > HELD_FEATURES:
                    yield pd.DataFrame([(f, p, n) for f, (p, n) in seen.items()], columns=["feature", "pos", "neg"])
                    seen = {}
        yield pd.DataFrame([(f, p, n) for f, (p, n) in seen.items()], columns=["feature", "pos", "neg"])

    def top(found: DataFrame) -> dict[str, float]:
        kept = found.orderBy(F.desc("pos"), "feature").limit(MODEL_FEATURES).collect()
        return {r.feature: -math.log(1 - r.p) for r in kept}

    least_pos = max(SUPPORT, STRONG_PART * sample.filter("toxic > 0").count())
    strong = top(counts(frozenset()).filter((F.col("pos") >= least_pos) & (F.col("p") >= STRONG_SHARE)))
    # First letters say little about any one of their words, so they have to be surer.
    least = F.when(F.col("feature").endswith("*"), STEM_SHARE).otherwise(SHARE)
    weak = top(counts(frozenset(strong)).filter((F.col("pos") >= SUPPORT) & (F.col("p") >= least)))
    return weak | strong


def score_documents(docs: DataFrame, model: np.ndarray, weights: dict[str, float]) -> DataFrame:
    """``doc_id, score`` for every whole text, from the text alone.

    A null or empty text, and one without any marked word, scores BASE. Rows are scored one by one, repeated rows alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, marks = shared.value
        restorer, memo = Restorer(lm), {}

        def weight(word: bytes) -> float:
            return max(marks.get(f, 0.0) for f in features(restorer.word(word.decode("utf-8", "replace"))))

        for pdf in batches:
            scores = []
            for text in pdf["text"]:
                total = 0.0
                for w in restorer.words(text) if text else ():
                    x = memo.get(w)
                    if x is None:
                        x = weight(w)
                        if len(w) <= MEMO_BYTES:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[w] = x
                    total += x
                scores.append(1 - (1 - BASE) * math.exp(-total))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def restore_documents(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, restored``: every whole text with hidden words restored; a null text stays null."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "restored": [None if t is None else restorer.text(t) for t in pdf["text"]]})

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, restored string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
