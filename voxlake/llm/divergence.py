"""Source divergence audit: how the vocabularies of a language's sources differ, by single-pass in-memory indexing.

1. Each task reads its documents once and adds to block postings in memory: per language and term the number of documents,
   per source the number of occurrences. When the memory set for it is full, the block is spilled as a run: terms in order,
   cut by the hash of the term into shards, packed in chunks.
2. The runs of a shard meet in one task, at most FAN_IN at a time, and a heap merges them term by term. With more runs the
   merge takes several passes, so a term that every run has never meets all its postings at once. The last pass keeps the
   terms that enough documents have.
3. A group's share of a term is a smoothed integer. Two sources differ by the sum over all kept terms. For terms that neither
   has, that is one product of the vocabulary's size; the terms that one of them has are streamed as corrections to it.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.llm.common import batch_rows, text_chunks
from voxlake.session import materialize

#: Documents a kept term is in, ranks of the term report, smoothing of a count, units of a share.
LEAST_DOCS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: A byte of UTF-8 as part of a term, A-Z lower-cased: letters and all beyond ASCII stay, others are blanks between terms.
TERM_BYTES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower()
#: Memory of a block, in postings and in bytes of its terms; terms of a chunk; runs that are merged at a time.
BLOCK_POSTINGS, BLOCK_BYTES, CHUNK_TERMS, FAN_IN = 1 << 20, 1 << 25, 4096, 64
#: Counters of a shard's documents by hash of the term.
HASHED = 1 << 20
#: Characters of input a shard is to hold on average, and the most shards that a run is cut into.
SHARD_CHARS, MOST_SHARDS = 1 << 23, 1 << 16
#: Sources of a block of the pair table, and postings of one task of it.
PAIR_SOURCES, PAIR_POSTINGS = 512, 1 << 17

RUN_SCHEMA = "lang string, shard int, run long, seq int, sources array<string>, body binary"


def pack(terms: list[bytes], *numbers: np.ndarray) -> bytes:
    """Terms and lists of numbers as one compressed body."""
    parts = [b" ".join(terms), *(n.astype("<i8").tobytes() for n in numbers)]
    return zstandard.compress(np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts), 1)


def unpack(body: bytes) -> tuple:
    """Terms, documents, numbers of postings, places of their sources, and their counts."""
    raw = zstandard.decompress(body)
    cuts = 40 + np.cumsum([0, *np.frombuffer(raw, "<i8", 5).tolist()])
    terms, *numbers = (raw[a:b] for a, b in zip(cuts, cuts[1:]))
    return terms.split(b" "), *(np.frombuffer(n, "<i8") for n in numbers)


class Terms(dict):
    """Numbers of terms, given out as they are met, and the bytes they take."""

    bytes = 0

    def __missing__(self, term: bytes) -> int:
        self.bytes += len(term) + 64
        self[term] = n = len(self)
        return n


class Block:
    """Postings in memory: for terms of each language the documents and the occurrences by source."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.terms = Terms()
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # (group, term) keys and counts
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []  # (language, term) keys and documents
        self.size = 0

    def add(self, texts: list[bytes], langs: list[str], sources: list[str]) -> None:
        """One batch: the words of each document counted, its terms as numbers, added up by (group, term) and by (language, term)."""
        ids, keys, counts = [], [], []
        for text, lang, source in zip(texts, langs, sources):
            words = Counter(text.translate(TERM_BYTES).split())
            own = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
            group = self.groups.setdefault((lang, source), len(self.groups))
            keys.append(own + (group << 32))
            counts.append(np.fromiter(words.values(), np.int64, len(words)))
            ids.append(own + (self.langs.setdefault(lang, len(self.langs)) << 32))
        self.held.append(_added(list(zip(keys, counts))))
        self.docs.append(np.unique(np.concatenate(ids), return_counts=True))
        self.size += len(self.held[-1][0]) + len(self.docs[-1][0])
        if self.size > BLOCK_POSTINGS:  # what batches have in common is added up before the block counts as full
            self.held, self.docs = [_added(self.held)], [_added(self.docs)]
            self.size = len(self.held[0][0]) + len(self.docs[0][0])

    def full(self) -> bool:
        return 2 * self.size > BLOCK_POSTINGS or self.terms.bytes > BLOCK_BYTES

    def spill(self, run: int, shards: int) -> Iterator[dict]:
        """The chunks of a run, by language, shard and term, and the block is empty again."""
        names, groups, langs = list(self.terms), list(self.groups), {i: x for x, i in self.langs.items()}
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))  # of a term among all, in order
        shard = np.fromiter((zlib.crc32(names[i]) % shards for i in order), np.int64, len(names))
        lang_of = np.array([self.langs[lang] for lang, _ in groups], np.int64)

        def parts(held):
            keys, counts = _added(held)
            return keys >> 32, place[keys & 0xFFFFFFFF], counts

        lang, term, docs = parts(self.docs)
        group, term_of, count = parts(self.held)
        entry = np.lexsort((term, shard[term], lang))
        lang, term, docs = lang[entry], term[entry], docs[entry]
        posting = np.lexsort((group, term_of, shard[term_of], lang_of[group]))
        group, term_of, count = group[posting], term_of[posting], count[posting]
        first = np.flatnonzero(np.r_[True, (term_of[1:] != term_of[:-1]) | (lang_of[group][1:] != lang_of[group][:-1])])
        ends = np.r_[first[1:], len(group)]  # both lists have the same (language, term) pairs in the same order
        cuts = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (shard[term][1:] != shard[term][:-1])])
        for a, b in zip(cuts, np.r_[cuts[1:], len(lang)]):
            for seq, i in enumerate(range(a, b, CHUNK_TERMS)):
                j = min(i + CHUNK_TERMS, b)
                p = slice(first[i], ends[j - 1])
                used, at = np.unique(group[p], return_inverse=True)
                yield {
                    "lang": langs[int(lang[i])],
                    "shard": int(shard[term[i]]),
                    "run": run,
                    "seq": seq,
                    "sources": [groups[g][1] for g in used],
                    "body": pack([names[order[t]] for t in term[i:j]], docs[i:j], ends[i:j] - first[i:j], at, count[p]),
                }
        self.clear()


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def entries(chunks: list[dict], run: int, enough: np.ndarray | None = None) -> Iterator[tuple]:
    """Term, run, documents, and where its postings are, one by one in the order of terms; one chunk is unpacked at a time.
    With ``enough``, terms whose hash has no mark there are left out."""
    for c in sorted(chunks, key=itemgetter("seq")):
        terms, docs, sizes, places, counts = unpack(c["body"])
        ends = np.cumsum(sizes).tolist()
        kept = zip(terms, docs.tolist(), [0, *ends], ends)
        if enough is not None:
            kept = compress(kept, enough[hashes(terms) & (len(enough) - 1)].tolist())
        for term, n, start, end in kept:
            yield term, run, n, start, end, c["sources"], places, counts


def hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))


def possible(runs: list[list[dict]], least_docs: int) -> np.ndarray:
    """Marks by hash: those under which the runs have ``least_docs`` documents. No term of another hash can have as many."""
    total = np.zeros(HASHED, np.int64)
    for c in (c for chunks in runs for c in chunks):
        terms, docs, *_ = unpack(c["body"])
        np.add.at(total, hashes(terms) & (HASHED - 1), docs)
    return total >= least_docs


def merged(runs: list[list[dict]], least_docs: int = 0) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """Heap-merge runs: each term once, its documents and its occurrences by source; terms of too few documents are left out."""
    enough = possible(runs, least_docs) if least_docs else None
    heap = heapq.merge(*(entries(chunks, i, enough) for i, chunks in enumerate(runs)))  # by term, then by run: no two are equal
    for term, same in groupby(heap, key=itemgetter(0)):
        same = list(same)
        docs = sum(e[2] for e in same)
        if docs < least_docs:
            continue
        by: dict[str, int] = {}
        for _, _, _, start, end, sources, places, counts in same:
            for s, n in zip(places[start:end].tolist(), counts[start:end].tolist()):
                by[sources[s]] = by.get(sources[s], 0) + n
        yield term, docs, by


def packed(lang: str, shard: int, run: int, terms: Iterator[tuple[bytes, int, dict[str, int]]]) -> Iterator[dict]:
    """Merged terms as the chunks of a run."""
    seq, held = 0, []

    def chunk() -> dict:
        names = sorted({s for _, _, by in held for s in by})
        at = {s: i for i, s in enumerate(names)}
        return {
            "lang": lang,
            "shard": shard,
            "run": run,
            "seq": seq,
            "sources": names,
            "body": pack(
                [t for t, _, _ in held],
                np.array([n for _, n, _ in held], np.int64),
                np.array([len(by) for _, _, by in held], np.int64),
                np.array([at[s] for _, _, by in held for s in by], np.int64),
                np.array([n for _, _, by in held for n in by.values()], np.int64),
            ),
        }

    for term in terms:
        held.append(term)
        if len(held) == CHUNK_TERMS:
            yield chunk()
            seq, held = seq + 1, []
    if held:
        yield chunk()


def index_runs(docs: DataFrame, shards: int) -> DataFrame:
    """The chunks of the runs that all tasks spill. ``docs``: ``text`` (binary), ``lang``, ``source``, no nulls."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, run = Block(), TaskContext.get().partitionId() << 32
        for pdf in batches:
            texts, langs, sources, at = pdf["text"].tolist(), pdf["lang"].tolist(), pdf["source"].tolist(), 0
            for chunk in text_chunks(texts):
                block.add(chunk, langs[at : at + len(chunk)], sources[at : at + len(chunk)])
                at += len(chunk)
                if block.full():
                    yield pd.DataFrame(list(block.spill(run, shards)))
                    run += 1
        if block.size:
            yield pd.DataFrame(list(block.spill(run, shards)))

    return docs.mapInPandas(build, RUN_SCHEMA)


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, term, sources, counts`` of the terms that at least ``least_docs`` documents of the language have."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / SHARD_CHARS)))
    with batch_rows(spark):
        runs = materialize(index_runs(docs, shards), "runs")
    columns = runs.columns

    def grouped(pdf: pd.DataFrame) -> list[list[dict]]:
        return [g.to_dict("records") for _, g in pdf.groupby("run", sort=False)]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(packed(key[0], key[1], key[2], merged(grouped(pdf)))), columns=columns)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], t.decode("utf-8", "replace"), list(by), list(by.values())) for t, _, by in merged(grouped(pdf), least_docs)]
        return pd.DataFrame(out, columns=["lang", "term", "sources", "counts"])

    while True:
        many = runs.select("run").distinct().count()
        if many <= FAN_IN:
            break
        # Any split of the runs into groups will do: a hash deals them out, FAN_IN / 2 to a group on average.
        groups = math.ceil(2 * many / FAN_IN)
        to = F.pmod(F.xxhash64("run"), F.lit(groups))
        runs = materialize(runs.groupBy("lang", "shard", to.alias("to")).applyInPandas(merge, RUN_SCHEMA), "runs")
    return runs.groupBy("lang", "shard").applyInPandas(finish, "lang string, term string, sources array<string>, counts array<long>")


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * vocabulary)), exactly."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + SMOOTH * vocabulary).cast("decimal(20,0)")) + 1


def shares(counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """The same for an array of counts; whole numbers of any size."""
    below = total + SMOOTH * vocabulary
    if below < (1 << 62) // UNIT:  # no count is larger, so nothing overflows
        return 1 + UNIT * (counts + SMOOTH) // below
    return np.array([1 + UNIT * (int(c) + SMOOTH) // below for c in counts], np.int64)


def pair_corrections(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, more``: over the terms that source a or b has, what their shares differ beyond the difference of their
    base shares, summed. Pairs with a < b in the order of ``place``, pairs without a correction are left out.

    ``groups``: ``lang, source, place, total, vocabulary, base``. A task sees the postings of a part of the terms and two
    blocks of sources, and holds a table of these sources only.
    """
    block = F.floor(F.col("place") / PAIR_SOURCES).cast("int")
    blocks = groups.groupBy("lang").agg((F.max(block) + 1).alias("blocks"))
    sizes = kept.groupBy("lang").agg(F.ceil(F.sum(F.size("sources")) / PAIR_POSTINGS).cast("int").alias("parts"))
    low = blocks.join(sizes, "lang").selectExpr("*", "explode(sequence(0, blocks - 1)) AS low")
    pairs = materialize(low.selectExpr("*", "explode(sequence(low, blocks - 1)) AS high"), "pair-blocks")
    terms = kept.join(pairs, "lang").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    tables = groups.withColumn("block", block).join(pairs, "lang").filter("block = low or block = high")
    tables = tables.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    key = ["lang", "low", "high", "part"]
    step = 1024

    def correct(key_: tuple, rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("place")
        at = {s: i for i, s in enumerate(sources["source"])}
        base, totals, vocabulary = sources["base"].to_numpy(np.int64), sources["total"].tolist(), sources["vocabulary"].tolist()
        more = np.zeros((len(at), len(at)), np.int64)
        apart = np.abs(base[:, None] - base[None, :])
        for i in range(0, len(rows), step):
            part = rows.iloc[i : i + step]
            n = [len(x) for x in part["sources"]]
            line = np.repeat(np.arange(len(part)), n)
            place = np.array([at.get(s, -1) for x in part["sources"] for s in x], np.int64)
            counts = np.concatenate(part["counts"].tolist()).astype(np.int64) if len(part) else np.empty(0, np.int64)
            line, counts, place = line[place >= 0], counts[place >= 0], place[place >= 0]
            table = np.repeat(base[None, :], len(part), 0)
            order = np.argsort(place, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(own):
                    g = place[own[0]]
                    table[line[own], g] = shares(counts[own], totals[g], vocabulary[g])
            for g in range(len(at)):
                more[g] += np.abs(table - table[:, g : g + 1]).sum(0) - len(part) * apart[g]
        a, b = np.nonzero(np.triu(more, 1) if key_[1] == key_[2] else more)
        places, names = sources["place"].to_numpy(), sources["source"].to_numpy()
        in_low = places // PAIR_SOURCES == key_[1]
        fits = in_low[a] & (places[b] // PAIR_SOURCES == key_[2]) & (places[a] < places[b])
        a, b = a[fits], b[fits]
        return pd.DataFrame({"lang": key_[0], "a": names[a], "b": names[b], "more": more[a, b]})

    fields = [*key, "source", "place", "total", "vocabulary", "base"]
    tables = tables.select(fields).toDF(*fields)  # columns of their own, as both sides have the keys of ``pairs``
    sent = terms.select(*key, "sources", "counts").groupBy(*key).cogroup(tables.groupBy(*key))
    return sent.applyInPandas(correct, "lang string, a string, b string, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from each other one (part ``pair``, all
    of them) and the terms it has more of than the language (part ``term``, the first ``top``).

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms of at least
    ``least_docs`` of its documents. Null text, language and source are the empty text; such a language or source is one like
    any other. A group whose texts are empty or keep no term takes part in the pairs. Rows are documents, also those that
    repeat an id. Columns other than text, lang and source are ignored; an empty table gives no rows, a language of one
    source no pairs.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = materialize(kept_terms(rows.withColumn("text", F.col("text").cast("binary")), least_docs), "terms")
    long = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    long = long.select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    totals = long.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("all"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary")).join(whole, "lang", "left")
    every = rows.select("lang", "source").distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["total", "vocabulary", "all"])
    base = F.when(F.col("vocabulary") > 0, share(F.lit(0), F.col("total"), F.col("vocabulary"))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(groups.withColumns({"base": base, "place": place}), "groups")

    of_lang = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("lang_n"))
    known = long.join(of_lang, ["lang", "term"]).join(groups.drop("place", "base"), ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    q = share(F.col("lang_n"), F.col("all"), F.col("vocabulary"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    more = pair_corrections(kept, groups)
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.place") < F.col("b.place")))
    apart = F.col("a.vocabulary") * F.abs(F.col("a.base") - F.col("b.base"))
    pairs = met.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b"), apart.alias("apart"))
    pairs = pairs.join(more, ["lang", "a", "b"], "left").withColumn("value", F.col("apart") + F.coalesce("more", F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("i")), F.struct(F.col("b").alias("s"), F.col("a").alias("i"))))
    pairs = pairs.select("lang", both.alias("x"), "value")
    pairs = pairs.select("lang", F.col("x.s").alias("source"), F.lit("pair").alias("part"), F.col("x.i").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
z AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM v GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * z.v) AS p,
         1 + 1000000000 * (v.n::HUGEINT + 5) // (z.n + 5 * z.v) AS q
  FROM g JOIN z ON z.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  WHERE a.lang NOT IN (SELECT lang FROM z)
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f
) WHERE part = 'pair' OR rank <= 50
"""
