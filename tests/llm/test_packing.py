import random

import pytest

from vectorloom.llm import packing


def test_best_fit_equals_linear_search():
    random.seed(3)
    for _ in range(150):
        n, capacity = random.randint(1, 100), random.randint(1, 40)
        lengths = sorted((random.randint(1, capacity) for _ in range(n)), reverse=True)
        sources = [random.choice(["a", "b", "c", "d", None]) for _ in range(n)]
        clusters = [random.choice([1, 2, 3, None]) for _ in range(n)]
        bins = []
        for length, source, cluster, k in zip(lengths, sources, clusters, packing.best_fit(lengths, sources, clusters, capacity), strict=True):
            fits = [b[0] for b in bins if b[0] >= length and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
            if k == len(bins):
                assert not fits
                bins.append([capacity, set(), set()])
            else:
                assert bins[k][0] == min(fits) and source not in bins[k][1] - {None} and cluster not in bins[k][2] - {None}
            bins[k][0] -= length
            bins[k][1].add(source), bins[k][2].add(cluster)


def test_every_word_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    docs = [(i, " ".join(["w"] * (i * 7 % 90)), f"s{i % 3}") for i in range(120)] + [(500, None, None), (501, "", "s0"), (502, "\t ", "s0"), (None, "a b", "s1"), (7, "same id", "s2"), (600, "long " * 1000, "s0")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, piece int")
    rows = packing.best_fit_pack(df, capacity=64).collect()
    want = sorted((-1 if i is None else i, len((t or "").split()) + 1) for i, t, _ in docs)
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert sum(r.n_tokens for r in rows) == sum(n for _, n in want)
    for r in got[600]:
        assert r.first_word == r.piece * 64
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    source = {i: s for i, _, s in docs}
    for held in bins.values():
        held.sort(key=lambda r: r.start)
        at = 0
        for r in held:
            assert r.start == at
            at += r.n_tokens
        assert at <= 64
        named = [source[r.doc_id] for r in held if r.doc_id != 7 and source[r.doc_id]]
        assert len(named) == len(set(named))


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.best_fit_pack(df).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_pack(df, capacity=0)
    df = spark.createDataFrame([(1, "a b", "s", 5), (2, "c d", "t", 5), (3, "e f", "u", 6)], "doc_id long, text string, source string, cl int")
    got = {r.doc_id: r.bin_id for r in packing.best_fit_pack(df, 100, cluster_col="cl").collect()}
    assert got[1] != got[2] and got[3] in (got[1], got[2])
