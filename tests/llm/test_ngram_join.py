import random

import numpy as np
import pytest

from vectorloom.llm import ngram_join as N


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, num, den):
    sets = {i: shingles(t, n) for i, t in docs}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b), links[b].add(a)
    comp = {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return {i: (len(sets[i]), len(links[i]), comp[i]) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    shared = [rng.choice(words) for _ in range(50)]
    docs = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.7 else []
        if rng.random() < 0.2:
            text += shared
        docs.append((i * 3 + 1, rng.choice([" ", "\n", "\t"]).join(text)))
    return docs


@pytest.mark.parametrize(("n", "num", "den", "chunk"), [(3, 90, 100, 1000), (5, 80, 100, 1000), (1, 75, 100, 8), (2, 50, 100, 5), (3, 90, 100, 4)])
def test_matches_brute_force(spark, monkeypatch, n, num, den, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    docs = corpus(n * 100 + chunk)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, cluster int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in N.ngram_jaccard_join(df, n, num, den).collect()}
    assert got == brute(docs, n, num, den)


def test_trie_against_pairs():
    rng = np.random.default_rng(13)
    limit = N.Threshold(80, 100)
    for _ in range(30):
        base = rng.choice(500, 60, replace=False)
        sets = []
        for _ in range(25):
            s = set(rng.choice(base, rng.integers(0, 60), replace=False)) if rng.random() < 0.3 else set(base) - set(rng.choice(base, rng.integers(0, 12))) | set(rng.integers(500, 520, rng.integers(0, 5)))
            sets.append(np.array(sorted(s), dtype=np.uint64))
        left = rng.random(25) < 0.5
        for sides in (None, left):
            want = {(i, j) for i in range(25) for j in range(i + 1, 25) if len(sets[i]) and len(sets[j]) and (sides is None or sides[i] != sides[j]) and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
            x, y = N.trie_join(sets, limit, sides, budget=2000)
            assert len(x) == len(want) and set(zip(x.tolist(), y.tolist(), strict=True)) == want


@pytest.mark.parametrize("num", [60, 80, 90, 100])
def test_linked_sets_share_a_prefix_element(num):
    rng = np.random.default_rng(num)
    limit = N.Threshold(num, 100)
    for _ in range(300):
        a = rng.permutation(2000)[: int(rng.integers(1, 200))]
        b = np.setdiff1d(a, rng.choice(a, int(rng.integers(0, len(a) * (100 - num) // 100 + 1)), replace=False))
        b = np.union1d(b, rng.integers(2000, 2400, int(rng.integers(0, 3))))
        k = len(np.intersect1d(a, b))
        if k and 100 * k >= num * (len(a) + len(b) - k):
            assert k >= limit.needed(len(a), len(b))
            assert np.intersect1d(np.sort(a)[: limit.prefix(len(a))], np.sort(b)[: limit.prefix(len(b))]).size


def test_one_large_group_and_a_common_passage(spark, monkeypatch):
    """A giant candidate group in many chunks, beside documents that share one frequent passage."""
    monkeypatch.setattr(N, "CHUNK", 7)
    rng = random.Random(5)
    base, passage = [f"b{k}" for k in range(90)], [f"p{k}" for k in range(40)]
    docs = []
    for i in range(120):
        text = list(base)
        text[rng.randrange(90)] = f"x{rng.randrange(12)}"
        docs.append((i, " ".join(text)))
    for i in range(120, 260):
        docs.append((i, " ".join(passage + [f"y{rng.randrange(40)}" for _ in range(rng.randint(0, 25))])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for n, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in N.ngram_jaccard_join(df, n, num, 100).collect()}
        assert got == brute(docs, n, num, 100)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "long word " * 30_000), (8, "long word " * 30_000 + "x"), (9, "é É")]
    df = spark.createDataFrame([*docs, (None, "a"), (4, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_jaccard_join(df, 3, 90, 100).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (2, 7), 8: (3, 8), 9: (1, 9)}
    assert N.ngram_jaccard_join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        N.ngram_jaccard_join(df, 3, 3, 2)
    kept = N.keep_one(df, 3, 90, 100)
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: i or 0) == [None, 1, 2, 3, 4, 4, 6, 7, 8, 9] and kept.columns == df.columns
