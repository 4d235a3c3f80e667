import numpy as np

from vectorloom.llm import common
from vectorloom.llm.common import Scratch, connected_components, mix, mix_int, sample_share, word_hashes


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(1)
    shapes = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(50)] + [(7, 7), (5, 6)]
    want = brute([e for e in shapes if e[0] != e[1]])
    df = spark.createDataFrame([shapes[i] for i in rng.permutation(len(shapes))], "src long, dst long").repartition(7)
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == want
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_components_of_dealt_out_paths_take_one_round(spark, monkeypatch):
    """Forests of all partitions are merged before the rounds; where they are too large for one task, rounds do the rest."""
    edges = [(1000 * p + i, 1000 * p + i + 1) for p in range(5) for i in range(300)]
    df = spark.createDataFrame([edges[i] for i in np.random.default_rng(2).permutation(len(edges))], "src long, dst long").repartition(8)
    scratch = Scratch(spark, "t")
    assert {r.node: r.component for r in connected_components(df, scratch).collect()} == brute(edges)
    assert scratch.count <= 4
    monkeypatch.setattr(common, "FOREST", 400)
    assert {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()} == brute(edges)


def test_word_hashes():
    texts = ["The cat\tsat", None, "", "  \n ", "the CAT sat", "x" * 3_000_000 + " the", "é É"]
    flat, starts = word_hashes(texts)
    assert np.diff(starts).tolist() == [3, 0, 0, 0, 3, 2, 2]
    assert (flat[:3] == flat[3:6]).all() and flat[7] == flat[0] and flat[8] != flat[9]
    assert word_hashes(["a-b, c"], b",-")[0].tolist() == word_hashes(["ab c"])[0].tolist()
    assert int(mix(np.array([5], dtype=np.uint64))[0]) == mix_int(5)


def test_sample_share(spark):
    df = spark.range(10_000)
    assert 700 < df.where(sample_share(10_000, 1000)("id")).count() < 1300
    assert df.where(sample_share(10, 1000)("id")).count() == 10_000
