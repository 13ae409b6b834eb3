import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxlake.llm import exact_dedup, line_dedup, ngram_join


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    for bits in (0, 3):
        prints, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        drawn = []
        for _ in range(4):
            part = rng.choice(pool, 500)
            drawn += part.tolist()
            fp, n = exact_dedup.add_up(part, np.ones(len(part), np.int64))
            ids = (fp >> np.uint64(64 - bits)) if bits else np.zeros(len(fp), np.uint64)
            for k in np.unique(ids):
                back = exact_dedup.decode(exact_dedup.encode(fp[ids == k], n[ids == k], bits), int(k), bits)
                prints, counts = np.concatenate([prints, back[0]]), np.concatenate([counts, back[1]])
        fp, n = exact_dedup.add_up(prints, counts)
        assert dict(zip(fp.tolist(), n.tolist())) == Counter(drawn)


def test_exact_groups(docs):
    rng = random.Random(1)
    pairs = [(i, rng.choice(["a", "b", "", None, f"only {i}", "hot", "hot", "hot"])) for i in range(200)]
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    want = {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in pairs}
    got = exact_dedup.exact_groups(docs(pairs)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == 200
    assert {r.doc_id: r.text_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in pairs}


def test_exact_groups_of_odd_rows(odd_docs, docs):
    got = exact_dedup.exact_groups(odd_docs).collect()
    assert len(got) == 14
    assert {(r.doc_id, r.keep_id) for r in got if r.group_size == 3} == {(0, 1), (1, 1), (None, 1)}
    assert sum(r.kept for r in got if r.doc_id == 8) == 2  # repeated rows are one document
    assert exact_dedup.exact_groups(docs([])).collect() == []


def lines_by_hand(pairs, least, keep_first=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    where = defaultdict(set)
    for i, t in pairs:
        for p, x in enumerate((t or "").split("\n")):
            if key(x):
                where[key(x)].add((i, p))
    gone = {k: v for k, v in where.items() if len({i for i, _ in v}) >= least}
    drop = set().union(*gone.values()) if gone else set()
    if keep_first:
        drop -= {min(v) for v in gone.values()}
    out = {}
    for i, t in pairs:
        x = (t or "").split("\n")
        left = [y for p, y in enumerate(x) if (i, p) not in drop]
        out[i] = (len(x), len(x) - len(left), "\n".join(left))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(docs, keep_first):
    rng = random.Random(2)
    pool = ["Footer", " footer\t", "", "  ", "Ä", "ä", "one", "two", "\x1cfooter"] + [f"l{i}" for i in range(60)]
    pairs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 150)))) for i in range(40)] + [(90, None), (91, "")]
    got = line_dedup.dedup_lines(docs(pairs), least_docs=25, keep_first=keep_first).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == lines_by_hand(pairs, 25, keep_first)


def test_lines_of_rows_that_share_an_id(docs):
    pairs = [(i, f"hot\nown {i}") for i in range(9)] + [(1, "own line\nhot"), (1, "x\nhot"), (1, "x\nhot"), (None, "a\nHot "), (None, "b")]
    got = line_dedup.dedup_lines(docs(pairs), least_docs=10).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == sorted(
        [(str(i), f"own {i}") for i in range(9)] + [("1", "own line"), ("1", "x"), ("1", "x"), ("None", "a"), ("None", "b")]
    )
    kept = line_dedup.dedup_lines(docs([(1, "a\nb"), (1, "b\na"), (2, "a")]), least_docs=2, keep_first=True).collect()
    assert sum(r.kept_text.split("\n").count("a") for r in kept) == 1 and all("b" in r.kept_text for r in kept if r.doc_id == 1)


def test_lines_of_odd_rows(odd_docs, docs):
    got = line_dedup.dedup_lines(odd_docs, least_docs=2).collect()
    assert len(got) == 14 and all(r.n_dropped == 0 for r in got)
    assert line_dedup.dedup_lines(docs([]), least_docs=2).collect() == []


def test_lines_use_no_python(docs):
    plan = line_dedup.dedup_lines(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def components_by_hand(pairs, n, num, den):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, n, num):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(50)]
    pairs = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(2, 90))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            pairs.append((len(pairs) * 7 + 3, " ".join(copy[: rng.randint(len(copy) - 1, len(copy))])))
    pairs += [(5000, None), (5001, ""), (5002, " \n"), (5003, "W1"), (5004, "w1 "), (5005, "w1 w2")]
    got = ngram_join.jaccard_components(docs(pairs), n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_hand(pairs, n, num, 100)


def test_jaccard_of_odd_rows(odd_docs, docs):
    got = ngram_join.jaccard_components(odd_docs).collect()
    assert len(got) == 14
    assert all(r.component_id == r.doc_id for r in got)
    assert ngram_join.jaccard_components(docs([])).collect() == []


def test_trie_finds_what_pairs_find():
    rng = random.Random(5)
    for _ in range(60):
        counters = np.zeros(ngram_join.COUNTERS, np.int32)
        pool = np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)
        sets = [np.unique(rng.sample(pool.tolist(), rng.randint(1, 30))).astype(np.uint64) for _ in range(15)]
        for s in sets:
            counters[s & np.uint64(ngram_join.COUNTERS - 1)] += 1
        rows = [ngram_join.ordered(s, counters)[::-1] for s in sets]
        key = lambda h: (-int(counters[int(h) & (ngram_join.COUNTERS - 1)]), -int(h))
        root = ngram_join.Node(np.empty(0, np.uint64))
        for i, r in enumerate(rows):
            ngram_join.insert(root, r, i)
        for r in rows:
            want = {i for i, x in enumerate(rows) if 100 * len(set(r.tolist()) & set(x.tolist())) >= 60 * len(set(r.tolist()) | set(x.tolist()))}
            assert set(ngram_join.search(root, r, [key(h) for h in r], key, 60, 100)) == want
