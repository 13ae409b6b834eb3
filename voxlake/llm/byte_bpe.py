"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece of text is a row of bytes. The leaf of a live position holds the rank of the pair that starts there, together with
the position, so that the minimum over the tree is the lowest rank and, among equals, the leftmost. A merge takes the root,
unlinks the right neighbour and updates three leaves (the merged pair, the one before it, the one that is gone) in
logarithmic time. Short pieces are merged many at a time, one tree per row of an array; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import small_batches

POS_BITS = 31
NONE = np.int64(1) << 62
#: Pieces up to this many bytes are merged in batches.
SHORT = 64
#: Bytes of the pieces and stretches of text that a task remembers, half of them met since the last turn, and what an entry
#: takes besides its content.
HELD_BYTES, ENTRY_BYTES = 1 << 26, 250
#: Tree nodes of one batch of short pieces.
BATCH_NODES = 1 << 20


def read_ranks(path: str) -> bytes:
    """The content of a rank file (one line a token: base64 bytes, rank). Its size is the vocabulary's, not the corpus's."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Token bytes by rank, and the pairs of tokens that merge."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.width = max(self.tokens) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` shifted down where the pair does not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE >> POS_BITS)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of at most one power-of-two size class."""
        size = 2
        while size < max(map(len, pieces)):
            size *= 2
        n, cols = len(pieces), np.arange(size)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        token = np.where(cols < lengths[:, None], self.single[raw], -1)
        after = np.broadcast_to(cols + 1, (n, size)).copy()
        after[np.arange(n), lengths - 1] = size
        before = np.broadcast_to(cols - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        r, c = np.nonzero(cols[:-1] < (lengths - 1)[:, None])
        tree[r, size + c] = (self.pair_ranks(token[r, c], token[r, c + 1]) << POS_BITS) | c
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        # One-dimensional views: row i of the pieces begins at i * size, row i of the trees at i * 2 * size.
        tokens, nexts, prevs, nodes = token.ravel(), after.ravel(), before.ravel(), tree.ravel()
        base = np.arange(n) * size
        while True:
            top = nodes.take(2 * base + 1)
            some = top < NONE
            if not some.all():
                base, top = base[some], top[some]
            if not len(base):
                break
            at, rank = top & ((1 << POS_BITS) - 1), top >> POS_BITS
            gone = nexts.take(base + at)
            follow = nexts.take(base + gone)
            tokens[base + at], tokens[base + gone], nexts[base + at] = rank, -1, follow
            prev = prevs.take(base + at)
            right, left = np.flatnonzero(follow < size), np.flatnonzero(prev >= 0)
            rb, ra, rf = base[right], at[right], follow[right]
            lb, lp = base[left], prev[left]
            prevs[rb + rf] = ra
            pairs = self.pair_ranks(
                np.concatenate([rank[right], tokens.take(lb + lp)]), np.concatenate([tokens.take(rb + rf), rank[left]])
            )
            trees = 2 * base
            nodes[trees + size + gone] = NONE
            nodes[trees + size + at] = NONE
            nodes[2 * rb + size + ra] = (pairs[: len(right)] << POS_BITS) | ra
            nodes[2 * lb + size + lp] = (pairs[len(right) :] << POS_BITS) | lp
            # The merged pair and its right neighbour are close together, the one before may lie in another subtree.
            own, node = np.concatenate([trees, trees, 2 * lb]), np.concatenate([at, gone, lp]) + size
            for _ in range(size.bit_length() - 1):
                node >>= 1
                child = own + 2 * node
                nodes[own + node] = np.minimum(nodes.take(child), nodes.take(child + 1))
        live = token >= 0
        ids, ends = token[live].astype("<i4").tobytes(), (np.cumsum(live.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, piece: bytes) -> bytes:
        size, n, none = 1, len(piece), int(NONE)
        while size < n:
            size *= 2
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width = self.pairs, self.width

        def leaf(i: int, j: int) -> int:
            rank = pairs.get(token[i] * width + token[j])
            return none if rank is None else rank << POS_BITS | i

        tree = [none] * (2 * size)
        tree[size : size + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] < none:
            at = tree[1] & ((1 << POS_BITS) - 1)
            gone, token[at] = after[at], tree[1] >> POS_BITS
            token[gone], follow, prev = -1, after[gone], before[at]
            after[at] = follow
            put(gone, none)
            if follow < n:
                before[follow] = at
                put(at, leaf(at, follow))
            else:
                put(at, none)
            if prev >= 0:
                put(prev, leaf(prev, at))
        return np.array([t for t in token if t >= 0], "<i4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, four bytes an id. A piece that is a token itself is that token."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None or not piece:
                out[i] = rank.to_bytes(4, "little") if piece else b""
            elif len(piece) > SHORT:
                out[i] = self.encode_long(piece)
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            step = max(1, BATCH_NODES >> (bits + 1))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.encode_short([pieces[i] for i in part])):
                    out[i] = ids
        return out


class Encoder:
    """Encodes texts piece by piece and remembers pieces up to a bound.

    A cut before a space that is followed by other than white space, or before a line feed between such characters, never
    falls inside a match of the pattern. Texts are cut there first, and whole stretches are remembered.
    """

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = Vocabulary(content)
        self.pattern = regex.compile(pattern)
        self.forget()
        decimals = [f"{i},".encode() for i in range(self.vocabulary.width)]
        self.decimals = np.array(decimals)
        self.token_list = [self.vocabulary.tokens.get(i, b"") for i in range(self.vocabulary.width)]

    def forget(self) -> None:
        """Drop what is remembered; the vocabulary stays."""
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.unsafe: set[str] = set()
        self.turn()
        self.turn()

    def turn(self) -> None:
        """Drop what has not been met since the last turn. What is met again moves on, so frequent words stay."""
        self.old_pieces, self.old_chunks, self.pieces, self.chunks = self.pieces, self.chunks, {}, {}
        self.unsafe.intersection_update(self.old_chunks)
        self.held = 0

    def matches(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in set(pieces) if p not in self.pieces]
        self.pieces.update((p, self.old_pieces[p]) for p in new if p in self.old_pieces)
        unknown = [p for p in new if p not in self.old_pieces]
        self.pieces.update(zip(unknown, self.vocabulary.encode_pieces([p.encode() for p in unknown])))
        self.held += ENTRY_BYTES * len(new) + 5 * sum(map(len, new))

    def whole(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def learn_chunks(self, new: set[str]) -> None:
        split = {}
        self.held += ENTRY_BYTES * len(new) + 5 * sum(map(len, new))
        for c in new:
            if c in self.old_chunks:
                self.chunks[c] = self.old_chunks[c]
            elif not c or (c[0] != "\n" and c[0].isspace()) or (len(c) > 1 and c[-1].isspace()):
                self.unsafe.add(c)  # white space that the pattern may match across the cut
                self.chunks[c] = b""
            else:
                split[c] = self.matches(c if c[0] == "\n" else " " + c)
        self.learn(p for pieces in split.values() for p in pieces)
        for c, pieces in split.items():
            self.chunks[c] = self.whole(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if 2 * self.held > HELD_BYTES:
            self.turn()
        get, cut, new = self.chunks.get, [], set()
        for t in texts:
            if "\n\n" in t:
                cut.append(None)
                continue
            head, *parts = t.replace("\n", " \n").split(" ")
            ids = list(map(get, parts))
            if None in ids:
                new.update(p for p, x in zip(parts, ids) if x is None)
                ids = None
            cut.append((head, parts, ids))
        self.learn_chunks(new)
        out = []
        for t, c in zip(texts, cut):
            if c is None or not self.unsafe.isdisjoint(c[1]):
                pieces = self.matches(t)
                self.learn(pieces)
                out.append(self.whole(pieces))
                continue
            head, parts, ids = c
            first = self.matches(head)
            self.learn(first)
            out.append(self.whole(first) + b"".join(map(get, parts) if ids is None else ids))
        return [np.frombuffer(x, "<i4") for x in out]

    def decimal_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        return hashlib.sha256(self.decimals[ids].tobytes().translate(None, b"\0")[:-1]).hexdigest()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_list.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = (hash(content), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


@contextmanager
def task_encoder(content: bytes, pattern: str) -> Iterator[Encoder]:
    """The worker's encoder for the length of a task; the next one finds the vocabulary, not the pieces."""
    enc = encoder(content, pattern)
    try:
        yield enc
    finally:
        enc.forget()


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, without special tokens. A null text is the empty text and has no
    tokens. Rows are encoded one by one, so repeated rows and ids are kept; other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_encoder(ranks, pattern) as enc:
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": pd.Series(enc.encode(pdf["text"].tolist()), dtype=object)})

    return _with_ids(_texts(docs).mapInPandas(run, "doc_id string, ids array<int>"))


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, bytes``: the bytes of the token ids."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_encoder(ranks, pattern) as enc:
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "bytes": [enc.decode(np.asarray(x)) for x in pdf["ids"]]})

    return _with_ids(encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(run, "doc_id string, bytes binary"))


def token_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Encode and decode in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_encoder(ranks, pattern) as enc:
            for pdf in batches:
                each = enc.encode(pdf["text"].tolist())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"],
                    "n_tokens": [len(x) for x in each],
                    "ids_sha256": [enc.decimal_digest(x) for x in each],
                    "decoded_sha256": [hashlib.sha256(enc.decode(x)).hexdigest() for x in each],
                })

    return _with_ids(_texts(docs).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _with_ids(rows: DataFrame) -> DataFrame:
    """Ids pass through Python as text: numbers beside nulls would turn into floating point."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
