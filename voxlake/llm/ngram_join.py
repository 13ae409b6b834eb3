"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct word n-grams, as 64-bit hashes. Two documents link when their sets have a Jaccard
similarity of at least ``num / den``; the result says which documents hang together, not every pair.

1. Documents with the same set are one class; its smallest id stands for it.
2. A global order of n-grams: rare ones first, by a counter table of fixed size that all documents add to, then by hash.
   Any order gives right results; this one keeps frequent n-grams out of the way.
3. Two linked sets share an n-gram among the first ``n - ceil(n * num / den) + 1`` of each. Only those prefixes are
   shuffled, and those of n-grams that no other class has are dropped.
4. Each class is checked against the one leader that most of its prefix shares. That links large groups of near copies
   without listing their pairs.
5. All pairs that still lie in different groups and whose shared prefix leaves the threshold within reach are checked too.
   Nothing is capped, so every link between two groups is found.
6. A check puts the sets of a block of candidates into a trie, frequent n-grams first, so that near copies share paths. The
   other set walks the trie: the overlap so far is shared by all sets below a node, and a subtree is left as soon as the
   remaining lengths cannot lift the overlap to the threshold.
7. Links are merged into components.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import Words, gram_hashes, members, small_batches
from voxlake.llm.ngram_lm import pack, unpack
from voxlake.session import materialize

#: Counters of the table behind the global order, in chunks that are added up apart. 4 MB, whatever the input is.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Bits of the table of repeated prefix n-grams (at most 262144 rows), and n-grams a task holds before it sends them.
TOKEN_BITS, HELD_TOKENS = 1 << 24, 1 << 19
#: Candidates of one trie.
TRIE_SETS = 128


def shingles(words: Words, text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of the whole sequence where it is shorter."""
    w = words.of(text)
    return np.unique(gram_hashes(w, min(n, len(w)))) if len(w) else np.empty(0, np.uint64)


def ordered(hashes: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """In the global order: rare first, then by hash."""
    return hashes[np.lexsort((hashes, counters[hashes & np.uint64(COUNTERS - 1)]))]


def need(n, m, num: int, den: int):
    """Least overlap of linked sets of sizes n and m: den * i >= num * (n + m - i)."""
    return -(-num * (n + m) // (num + den))


class Node:
    """A path-compressed trie node: the n-grams of its edge, children by their first n-gram, sets that end here."""

    __slots__ = ("edge", "children", "ends", "least", "most")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends, self.least, self.most = edge, {}, [], 1 << 62, 0


def insert(root: Node, items: np.ndarray, name) -> None:
    node, at, size = root, 0, len(items)
    node.least, node.most = min(node.least, size), max(node.most, size)
    while at < size:
        child = node.children.get(int(items[at]))
        if child is None:
            child = Node(items[at:])
            node.children[int(items[at])] = child
            at = size
        else:
            span = min(len(child.edge), size - at)
            differ = np.flatnonzero(child.edge[:span] != items[at : at + span])
            same = int(differ[0]) if len(differ) else span
            if same < len(child.edge):
                low = child
                child = Node(low.edge[:same])
                child.least, child.most = low.least, low.most
                low.edge = low.edge[same:]
                child.children[int(low.edge[0])] = low
                node.children[int(child.edge[0])] = child
            at += same
        child.least, child.most = min(child.least, size), max(child.most, size)
        node = child
    node.ends.append(name)


def search(root: Node, probe: np.ndarray, keys: list, key_of, num: int, den: int) -> list:
    """Names of the sets in the trie that link with ``probe``. ``keys``: the probe's order keys, ascending."""
    values, n, found = np.sort(probe), len(probe), []
    stack = [(child, 0, 0) for child in root.children.values()]
    while stack:
        node, depth, overlap = stack.pop()
        at = np.minimum(np.searchsorted(values, node.edge), n - 1)
        overlap += int((values[at] == node.edge).sum())
        depth += len(node.edge)
        left = n - bisect_right(keys, key_of(node.edge[-1]))
        if overlap + min(left, node.most - depth) < need(n, node.least, num, den):
            continue
        if node.ends and den * overlap >= num * (n + depth - overlap):
            found += node.ends
        stack += [(child, depth, overlap) for child in node.children.values()]
    return found


def describe(docs: DataFrame, n: int) -> DataFrame:
    """One pass over the texts: a row per document (``n``, ``sig1``, ``sig2``) and, per task, its chunks of counters."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "sig1", "sig2", "chunk", "counts"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counters = Words(), np.zeros(COUNTERS, np.int32)
        for b in batches:
            sizes, one, two = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(words, text, n)
                if len(s):
                    np.add.at(counters, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                raw = s.tobytes()
                sizes.append(len(s))
                one.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                two.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
            none = [None] * len(sizes)
            cols = [b.column("doc_id"), sizes, one, two, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names)
        for k in range(COUNTERS // CHUNK):
            part = counters[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                cols = [[None]] * 4 + [[k], [zlib.compress(part.astype("<i4").tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return _texts(docs).mapInArrow(run, "doc_id long, n int, sig1 long, sig2 long, chunk int, counts binary")


def counter_table(described: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up chunk by chunk on the cluster; COUNTERS numbers come back."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), "<i4")
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})

    out = np.zeros(COUNTERS, np.int32)
    rows = described.filter("chunk is not null").select("chunk", "counts").groupBy("chunk")
    for row in rows.applyInPandas(add, "chunk int, counts binary").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.counts, "<i4")
    return out


def prefixes(docs: DataFrame, counters, n: int, num: int, den: int) -> DataFrame:
    """``doc, size, tokens``: the prefix of each set in the global order."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            sizes, tokens = [], []
            for text in pdf["text"]:
                s = shingles(words, text, n)
                sizes.append(len(s))
                tokens.append(ordered(s, counters.value)[: len(s) - -(-num * len(s) // den) + 1].view(np.int64))
            out = pd.DataFrame({"doc": pdf["doc_id"], "size": sizes, "tokens": pd.Series(tokens, dtype=object)})
            yield out[out["size"] > 0]

    return _texts(docs).filter("doc_id is not null").mapInPandas(run, "doc long, size int, tokens array<long>")


def repeated_tokens(own: DataFrame) -> DataFrame:
    """``token``: those that more than one row of ``own`` has in its ``tokens``.

    A task sends each of its distinct tokens once, sorted and packed by range of hash, with the places of those it saw more
    than once.
    """
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def slices(held):
            known, counts = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(known, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)).tolist()
            rows = []
            for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(known)])):
                if a < b:
                    rows.append((k, pack(known[a:b]), np.flatnonzero(counts[a:b] > 1).astype("<u4").tobytes()))
            return pd.DataFrame(rows, columns=["slice", "grams", "again"])

        held, size = [], 0
        for pdf in batches:
            held += [np.asarray(x, np.int64).view(np.uint64) for x in pdf["tokens"]]
            size += sum(map(len, pdf["tokens"]))
            if size >= HELD_TOKENS:
                yield slices(held)
                held, size = [], 0
        if size:
            yield slices(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [unpack(x) for x in pdf["grams"]]
        twice = [g[np.frombuffer(x, "<u4")] for g, x in zip(each, pdf["again"])]  # counts as two
        known, counts = np.unique(np.concatenate(each + twice), return_counts=True)
        return pd.DataFrame({"token": known[counts > 1].view(np.int64)})

    small_batches(own.sparkSession)
    sent = own.select("tokens").mapInPandas(send, "slice int, grams binary, again binary")
    return sent.groupBy("slice").applyInPandas(merge, "token long")


def check_pairs(docs: DataFrame, pairs: DataFrame, counters, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs ``a, b`` that link. Partners of an ``a`` are checked in blocks, one trie a block."""
    small_batches(docs.sparkSession)
    pairs = materialize(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).cast("int").alias("blocks"))
    blocks = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("doc"))
    wanted = materialize(blocks.unionByName(blocks.select("a", "block", F.col("a").alias("doc")).distinct()), "wanted")
    texts = members(_texts(docs).filter("doc_id is not null"), F.col("doc_id"), wanted, F.col("doc"))
    rows = texts.join(wanted, texts.doc_id == wanted.doc).select("a", "block", "doc", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        table = counters.value

        def key_of(h) -> tuple[int, int]:
            return -int(table[int(h) & (COUNTERS - 1)]), -int(h)

        def close(open_) -> list[tuple[int, int]]:
            return [(a, b) for a, probe, keys in open_["probes"] for b in search(open_["root"], probe, keys, key_of, num, den)]

        state = None
        for pdf in batches:
            links: list[tuple[int, int]] = []
            for a, block, doc, text in zip(pdf["a"], pdf["block"], pdf["doc"], pdf["text"]):
                if state is None or state["key"] != (a, block):
                    if state is not None:
                        links += close(state)
                    state = {"key": (a, block), "probes": [], "root": Node(np.empty(0, np.uint64))}
                items = ordered(shingles(words, text, n), table)[::-1]
                if doc == a:
                    state["probes"].append((a, items, [key_of(h) for h in items]))
                else:
                    insert(state["root"], items, doc)
            yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)
        if state is not None:
            yield pd.DataFrame(close(state), columns=["a", "b"], dtype=np.int64)

    return rows.repartition("a", "block").sortWithinPartitions("a", "block").mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``doc, component``: the smallest id that links lead to, for every id that has a link.

    Labels go over the links and then jump to their label's label, so that rounds grow with the logarithm of a chain.
    """
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    total = None
    while True:
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if state == total:  # labels only ever fall
            return labels.select(F.col("a").alias("doc"), F.col("label").alias("component"))
        total = state
        of = labels.select(F.col("a").alias("b"), F.col("label").alias("near"))
        over = edges.join(of, "b").select("a", F.col("near").alias("label"))
        jumped = labels.join(of, F.col("label") == F.col("b")).select("a", F.col("near").alias("label"))
        labels = materialize(over.unionByName(jumped).groupBy("a").agg(F.min("label").alias("label")), "labels")


def classes(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Every document with its set's size and signature, and the counters of the global order."""
    described = materialize(describe(docs, n), "sets")
    return described.filter("n is not null").drop("chunk", "counts"), counter_table(described)


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are runs other than [\\x20\\x09-\\x0D], A-Z lower-cased. Sets link when ``den * intersection >= num * union``. A
    document without words has no n-grams and links with nothing; its component is its own id. Rows with a null id link
    with nothing and have no component. Rows that repeat an id are one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows, table = classes(docs, n)
    counters = spark.sparkContext.broadcast(table)
    same = materialize(
        rows.filter("n > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("doc")), "classes"
    )

    def prefix_rest(size: Column) -> Column:
        """How many of a set's n-grams come after its prefix."""
        return F.ceil(size * num / F.lit(den)).cast("int") - 1

    def least(n_: Column, m: Column) -> Column:
        return F.ceil((n_ + m) * num / F.lit(num + den)).cast("int")

    own = materialize(prefixes(docs, counters, n, num, den).join(same.select("doc"), "doc"), "prefixes")
    common = materialize(repeated_tokens(own), "common")
    tokens = own.select("doc", "size", F.posexplode("tokens").alias("pos", "token"))
    tokens = members(tokens, F.col("token"), common, F.col("token"), TOKEN_BITS)  # most n-grams stop here
    by_doc = tokens.join(common, "token").groupBy("doc", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    # k: how many of the prefix any other class has; s: the place among those.
    shared = materialize(
        by_doc.select("doc", "size", F.size("t").alias("k"), F.posexplode("t.token").alias("s", "token")), "prefixes"
    )

    leaders = shared.groupBy("token").agg(F.min(F.struct(-F.col("k"), "doc", "size")).alias("m"))
    led = shared.join(leaders.select("token", F.col("m.doc").alias("lead"), F.col("m.size").alias("other")), "token")
    likely = (
        led.filter((F.col("doc") != F.col("lead")) & (F.least("size", "other") * den >= F.greatest("size", "other") * num))
        .groupBy("doc", "size", "lead", "other")
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") + F.greatest(prefix_rest(F.col("size")), prefix_rest(F.col("other"))) >= least(F.col("size"), F.col("other")))
    )
    best = likely.groupBy("doc").agg(F.max(F.struct("c", -F.col("lead"))).alias("m"))
    first = best.select((-F.col("m.col2")).alias("a"), F.col("doc").alias("b"))
    links = materialize(check_pairs(docs, first, counters, n, num, den), "links")

    label = links.groupBy("b").agg(F.min("a").alias("up"))
    above = label.select(F.col("b").alias("up"), F.col("up").alias("top"))
    label = label.join(above, "up", "left").select(F.col("b").alias("doc"), F.coalesce("top", "up").alias("label"))
    placed = shared.join(label, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    open_ = materialize(placed.join(mixed, "token").withColumn("rest", prefix_rest(F.col("size"))), "open")
    x, y = open_.alias("x"), open_.alias("y")
    c = {k: (F.col(f"x.{k}"), F.col(f"y.{k}")) for k in ("doc", "size", "k", "s", "label", "rest")}
    in_prefix = F.least(*c["s"]) + 1 + F.least(c["k"][0] - c["s"][0] - 1, c["k"][1] - c["s"][1] - 1)
    reach = F.greatest(*c["rest"])
    fits = (
        (c["doc"][0] < c["doc"][1])
        & (c["label"][0] != c["label"][1])
        & (F.least(*c["size"]) * den >= F.greatest(*c["size"]) * num)
        & (in_prefix + reach >= least(*c["size"]))
    )
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & fits)
    rest = (
        met.groupBy(c["doc"][0].alias("a"), c["doc"][1].alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.first(reach).alias("reach"), F.first(least(*c["size"])).alias("least"))
        .filter("c + reach >= least")
        .select("a", "b")
    )
    more = check_pairs(docs, rest, counters, n, num, den)
    found = components(links.unionByName(more))
    by_class = same.join(found, "doc", "left").select("sig1", "sig2", F.coalesce("component", "doc").alias("component"))
    linked = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.join(by_class, ["sig1", "sig2"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"),
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
