import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import byte_bpe, decontamination, language_id, ngram_lm, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 abzAB'stre123²½Ⅷ٣éñ漢🎉!.,-_<|"), max_size=40))
def test_ids_are_the_library_s(text):
    enc = byte_bpe.encoder(RANKS, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())} if not hasattr(enc, "_lib") else None
    if ranks:
        enc._lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = enc.encode([text])[0]
    assert ids.tolist() == enc._lib.encode_ordinary(text) and enc.decode(ids).decode() == text


def test_long_pieces(encoder, library):
    rng = random.Random(1)
    for text in ("".join(rng.choice("abcdef") for _ in range(5000)), "a" * 3000, "漢字" * 900, " " * 700 + "x", "thethethe" * 9):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_documents_round_trip(odd_docs, docs, library):
    ids = byte_bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode_documents(ids, RANKS, public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect() if r.doc_id is not None}
    assert {r.doc_id: r.bytes.decode() for r in back if r.doc_id is not None} == texts and len(back) == 14
    digests = byte_bpe.token_digests(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.n_tokens for r in digests if r.doc_id is not None} == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}
    assert byte_bpe.token_digests(docs([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_local_alignment_is_smith_waterman():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 15))] for _ in range(2))
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(len(a)):
            for j in range(len(b)):
                step = decontamination.MATCH if a[i] == b[j] else decontamination.MISMATCH
                h[i + 1][j + 1] = max(0, h[i][j] + step, h[i][j + 1] - decontamination.GAP, h[i + 1][j] - decontamination.GAP)
                best = max(best, h[i + 1][j + 1])
        assert decontamination.local_alignment(np.array(a), np.array(b))[0] == best


def test_contaminated(spark, docs, odd_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    items = [(i, say(rng.randint(15, 40))) for i in range(8)]
    pairs, want = [], {}
    for d in range(60):
        text = say(rng.randint(30, 200))
        if d % 3 == 0:
            item, body = items[d % 8][0], list(items[d % 8][1])
            if d % 2:  # an edited copy: words changed, one added, one gone
                for k in range(4, len(body), 9):
                    body[k] = "edited"
                body.insert(7, "more")
                del body[1]
            at = rng.randrange(len(text))
            text[at:at] = ["“" + body[0].upper() + "”,", *body[1:]]
            want[d] = item
        pairs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, ""), (None, "w1 w2 w3")], "item_id long, text string")
    got = decontamination.contaminated(docs(pairs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(want.items())
    assert all(r.score == 1.0 and r.end_word - r.start_word == len(items[r.item_id][1]) for r in got if r.doc_id % 2 == 0)
    assert decontamination.contaminated(odd_docs, bench).collect() == []
    assert decontamination.contaminated(docs([]), bench).collect() == decontamination.contaminated(docs(pairs), bench.limit(0)).collect() == []


def test_edited_copy_next_to_verbatim_copies(spark, docs):
    item = [f"w{i}" for i in range(40)]
    edited = ["edited" if i % 4 == 3 else w for i, w in enumerate(item)]
    texts = [*[item] * 5, edited]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontamination.contaminated(docs([(i, f"x{i} y{i} " + " ".join(w)) for i, w in enumerate(texts)]), bench).collect()
    assert {r.doc_id: r.score for r in got} == {**dict.fromkeys(range(5), 1.0), 5: pytest.approx(51 / 80)}


def test_short_items_are_found(spark, docs):
    bench = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(k))) for k in range(1, 7)], "item_id long, text string")
    said = {r.item_id: f"before it {r.text} after it" for r in bench.collect()}
    said[7] = "i6w0 i6w1 i6w2 other i6w4 i6w5"
    said[8] = "i1w0"
    got = decontamination.contaminated(docs(said.items()), bench).collect()
    want = {(k, k): 1.0 for k in range(1, 7)} | {(7, 6): 0.75, (8, 1): 1.0}
    assert {(r.doc_id, r.item_id): r.score for r in got} == want
    assert all((r.start_word, r.end_word) == (2, 2 + r.item_id) for r in got if r.doc_id < 7)


def test_languages(docs, odd_docs):
    said = {"a": "der die und nicht ist ein von zu das mit", "b": "the of and to in that is was for it"}
    rng = random.Random(4)
    train = [(lang, " ".join(rng.choice(w.split()) for _ in range(40))) for lang, w in said.items() for _ in range(50)]
    spark = odd_docs.sparkSession
    found = language_id.fit_dictionaries(spark.createDataFrame([*train, (None, "x"), ("c", None), ("c", "12")], "lang string, text string"))
    assert sorted(found) == ["a", "b"]
    tests = [(i, " ".join(rng.choice(said[lang].split()) for _ in range(12))) for i, lang in enumerate("ab" * 20)]
    got = {r.doc_id: r for r in language_id.predict_languages(docs(tests), found).collect()}
    assert sum(got[i].lang_pred == lang for i, lang in enumerate("ab" * 20)) >= 39
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r.lang_pred for r in language_id.predict_languages(odd_docs, found).collect()}
    assert [odd[i] for i in range(6)] == ["und"] * 6 and odd[6] in "ab" and len(odd) == 11
    assert language_id.predict_languages(docs([]), found).collect() == []
    assert language_id.predict_languages(docs([(1, "abc")]), {}).collect()[0].lang_pred == "und"


def test_copies_do_not_fill_a_dictionary(spark):
    texts = [f"text number {i}" for i in range(300)]
    for copied in texts[:3]:
        frame = spark.createDataFrame([("a", t) for t in [*texts, *[copied] * 3000]], "lang string, text string")
        found = language_id.fit_dictionaries(frame, snippets=50)["a"].decode().split("\n")
        assert len(found) == len(set(found)) == 50


def test_hidden_words_are_restored(docs):
    texts = [(i, "such a worthless idiot and a moron they said that stupid things happen") for i in range(50)]
    restorer = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs(texts))))
    for shown, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("wooorthlesss", "worthless"), ("$tup1d", "stupid"), ("plain", "plain")):
        assert restorer.word(shown) == meant
    assert restorer.text("An  1d10t, i d i o t!") == "An  idiot, idiot!"


def test_spaced_words_are_restored(docs):
    said = "you are such a dumb idiot and a moron they said i scumbag that i think things happen to a person like i am"
    restorer = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs([(i, said) for i in range(50)]))))
    for shown, meant in (
        ("you are a m o r o n", "you are a moron"), ("so I m o r o n", "so i moron"), ("d u m b i d i o t", "dumb idiot"),
        ("d u m b  i d i o t", "dumb idiot"), ("i d ! o t", "idiot"), ("$ c u m b a g", "scumbag"), ("m/o/r/o/n", "moron"),
        ("m|o|r|o|n", "moron"), ("m, o, r, o, n", "moron"), ("m~o~r~o~n", "moron"), ("m.0.r.0.n", "moron"),
        ("i d i o t ! now", "idiot ! now"), ("1/2/3 and 4, 5, 6", "1/2/3 and 4, 5, 6"),
    ):
        assert restorer.text(shown) == meant
        assert {w.encode() for w in meant.split() if w in ("moron", "dumb", "idiot", "scumbag")} <= restorer.words(shown)


def test_toxicity(spark, docs, odd_docs):
    rng = random.Random(6)
    plain = ["apple", "river", "stone", "cloud", "house", "green", "table", "light"]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["moron", "scumbag", "idiot"])
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.language_model(toxicity.trigram_counts(docs(rows)))
    weights = toxicity.fit_words(docs(rows), labels, model)
    tests = [(0, "a green m0r0n there"), (1, "green stone"), (2, "i d i o t"), (3, "IDIOT!"), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs(tests), model, weights).collect()}
    assert {i for i, s in got.items() if s >= 0.3} == {0, 2, 3} and got[4] == got[5]
    assert len(toxicity.score_documents(odd_docs, model, weights).collect()) == 14
    assert toxicity.score_documents(docs([]), model, weights).collect() == []
    assert not toxicity.trigram_counts(docs([])).any() and toxicity.fit_words(docs([]), labels, model) == {}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(docs, order):
    rng = random.Random(order)
    pairs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(30)] + [(50, None), (None, "a b"), (50, "z")]
    each = [(t or "").split() for _, t in pairs]
    count = lambda w, g: sum(tuple(w[i : i + len(g)]) == g for i in range(len(w) - len(g) + 1))
    want = []
    for k, w in enumerate(each):
        rest = [x for i, x in enumerate(each) if i != k]
        seen = lambda g: sum(count(x, g) for x in rest)  # noqa: B023, E731
        total = 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    total += np.log(max(seen(g), ngram_lm.UNSEEN) / max(1, sum(map(len, rest))))
                elif seen(g):
                    total += np.log(seen(g) / seen(g[:-1]))
                    break
                else:
                    total += np.log(ngram_lm.BACKOFF)
        want.append((pairs[k][0], len(w), round(total, 6)))
    got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in ngram_lm.stupid_backoff(docs(pairs), order).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stupid_backoff_of_odd_rows(odd_docs, docs):
    assert len(ngram_lm.stupid_backoff(odd_docs).collect()) == 14
    assert ngram_lm.stupid_backoff(docs([])).collect() == []


def test_numbers_are_no_letters(docs):
    model = {"a": b"der die das und nicht", "b": b"the of and to in"}
    got = language_id.predict_languages(docs([(1, "\u00b2\u00b3 \u00bd"), (2, "\u2460\u2461"), (3, "12_3"), (4, "\u00e9\u00b2 the")]), model).collect()
    assert {r.doc_id: (r.lang_pred == "und", r.score > 0) for r in got} == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True)}
