"""Pair finding of the decontamination against aligning every document with every item; bounded memos; settings put back."""

import random

import numpy as np
import pytest

from voxlake.llm import byte_bpe, decontamination, importance, ngram_join
from voxlake.llm.common import MEMO, Words, batch_rows, text_chunks


def corpus(seed, copies):
    """Documents that hold edited copies of items, and phrases that items and documents share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    phrases = [[rng.choice(words) for _ in range(4)] for _ in range(3)]

    def say(k):
        out = []
        while len(out) < k:
            out += rng.choice(phrases) if rng.random() < 0.3 else [rng.choice(words)]
        return out[:k]

    items = [say(rng.randint(3, 40)) for _ in range(12)]
    texts = []
    for _ in range(copies):
        body = list(rng.choice(items))
        step = rng.choice([4, 5, 7, 11, 99])
        body = [f"e{rng.randrange(9)}" if i % step == step - 1 else w for i, w in enumerate(body)]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body) + 1), "added")
        texts.append(say(rng.randint(0, 120)) + body + say(rng.randint(0, 60)))
    return items, texts + [say(rng.randint(1, 150)) for _ in range(copies)]


def aligned(items, texts):
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    found = {}
    for d, t in enumerate(map(number, texts)):
        for i, x in enumerate(map(number, items)):
            score = decontamination.local_alignment(x, t)[0] / (decontamination.MATCH * len(x))
            if score >= decontamination.LEAST_SCORE:
                found[d, i] = score
    return found


@pytest.mark.parametrize("rare", [0, 20])
def test_pairs_are_those_of_all_alignments(spark, docs, monkeypatch, rare):
    monkeypatch.setattr(decontamination, "RARE_DOCS", rare)  # 0: every n-gram is common
    items, texts = corpus(rare, 60)
    want = aligned(items, texts)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs([(d, " ".join(t)) for d, t in enumerate(texts)]), bench).collect()}
    assert got.keys() <= want.keys()
    # Chance likeness has few n-grams on its diagonal. What the copies are is found whole.
    strong = {k for k, s in want.items() if s >= 0.6}
    assert len(strong) >= 50 and len(strong & got.keys()) >= 0.98 * len(strong)
    assert sum(got[k] == pytest.approx(want[k]) for k in got) >= 0.98 * len(got)


def test_texts_of_one_id(spark, docs):
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(300))
    got = decontamination.contaminated(docs([(7, f"{filler} {item}"), (7, filler), (7, "short"), (7, f"{filler} {item}"), (8, filler)]), bench).collect()
    assert [(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in got] == [(7, 1, 1.0, 300, 320)]


def test_memos_are_bounded(monkeypatch):
    words = Words()
    words.of(b" ".join(b"w%d" % i for i in range(3 * MEMO)))
    words.of(b"x" * 100_000)
    assert len(words) <= MEMO and max(map(len, words)) < 100
    plain = decontamination.PlainWords()
    plain.of(" ".join(f"w{i}" for i in range(MEMO + 9)) + " " + "y" * 100_000)
    assert len(plain) <= MEMO and max(map(len, plain)) < 100
    hashes = importance.Hashes()
    importance.features([b" ".join(b"w%d" % i for i in range(importance.MEMO_WORDS + 9))], 1, hashes)
    assert len(hashes) <= importance.MEMO_WORDS
    assert ngram_join.HELD_TOKENS <= 1 << 20


def test_encoder_forgets(monkeypatch):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    monkeypatch.setattr(byte_bpe, "HELD_BYTES", 50_000)
    with byte_bpe.task_encoder(ranks, public_tokenizers.PATTERN) as enc:
        plain = [enc.encode([f"word{i} other{i}"])[0].tolist() for i in range(500)]
        assert len(enc.pieces) < 500
        assert [enc.encode([f"word{i} other{i}"])[0].tolist() for i in range(500)] == plain
    assert not enc.pieces and not enc.chunks and not enc.held


def test_settings_are_put_back(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ValueError), batch_rows(spark):
        assert [spark.conf.get(n) for n in names] != before
        raise ValueError
    assert [spark.conf.get(n) for n in names] == before


def test_text_chunks():
    texts = [b"a" * n for n in (3, 4, 50, 0, 2, 9)]
    assert [[len(t) for t in c] for c in text_chunks(texts, 10)] == [[3, 4], [50], [0, 2], [9]]
    assert list(text_chunks([])) == []


def test_frequent_words_outlast_the_bound(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "HELD_BYTES", 100_000)
    enc = byte_bpe.Encoder(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    first, encoded = enc.encode(["so qzfrequentword"])[0].tolist(), []
    encode = enc.vocabulary.encode_pieces
    monkeypatch.setattr(enc.vocabulary, "encode_pieces", lambda pieces: encoded.extend(pieces) or encode(pieces))
    for i in range(40):
        got = enc.encode(["so qzfrequentword", "so " + " ".join(f"w{i}x{j}" for j in range(50))])
        assert got[0].tolist() == first and enc.held <= 100_000
    assert encoded and b" qzfrequentword" not in encoded
    assert len(enc.chunks) + len(enc.old_chunks) < 500
