import numpy as np

from vectorloom.llm import embedding_dedup as E


def brute(rows, threshold):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    links = {i: set() for i, _ in rows}
    for a, x in ok:
        for b, y in ok:
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b), links[b].add(a)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, chunk string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_near_dedup(df, **options).collect()}
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(single, options.get("threshold", 0.95))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)  # large buckets are cut into chunks
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    near = [base[i % 8] + rng.standard_normal(16) * 0.05 for i in range(60)]
    copies = [base[0]] * 25
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, *copies])]
    check(spark, rows, recall=0.9999)


def test_a_large_bucket_of_distinct_near_copies(spark):
    """6 000 distinct vectors around one, in buckets of several chunks in every table, beside others."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(16) + rng.standard_normal((6000, 16)) * 0.04, rng.standard_normal((300, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_near_dedup(df, recall=0.9999999).collect()}
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = y @ y.T >= 0.95
    np.fill_diagonal(close, False)
    assert close[:6000].sum() > 30_000_000
    assert [got[i][0] for i in range(len(x))] == close.sum(axis=1).tolist()
    assert {got[i][1] for i in range(6000)} == {0}


def test_odd_vectors(spark):
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [3e38, 3e38])])


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.embedding_near_dedup(df).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in E.embedding_near_dedup(df).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True)]


def test_plan_grows_with_rows():
    assert E.plan_tables(10**9, 0.95, 0.99)[0] > E.plan_tables(10**5, 0.95, 0.99)[0]
