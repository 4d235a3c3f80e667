import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import queries as core
from vectorloom.functions import vectors as V
from vectorloom.operators import metrics as M
from vectorloom.operators import rerank as R
from vectorloom.operators import search as S
from vectorloom.sources import formats


def lists(spark, *ranked):
    rows = [(k, id_, pos, score, meta) for k, one in enumerate(ranked) for pos, (id_, score, meta) in enumerate(one, 1)]
    return spark.createDataFrame(rows, "list_id int, id string, pos int, score double, metadata map<string,string>")


def test_rrf(spark):
    got = {r.id: r for r in S.rrf(lists(spark, [("d1", None, {"a": "1"}), ("d2", None, None), ("d3", None, None)], [("d2", None, None), ("d4", None, None), ("d1", None, {"a": "2", "b": "3"})])).collect()}
    assert got["d2"].score == pytest.approx(1 / 62 + 1 / 61)
    assert got["d1"].score == pytest.approx(1 / 61 + 1 / 63)
    assert [got[d].rank for d in ("d2", "d1", "d4", "d3")] == [1, 2, 3, 4]


def test_rrf_metadata_later_wins(spark):
    got = {r.id: r.metadata for r in S.rrf(lists(spark, [("d", None, {"a": "1", "c": "0"})], [("d", None, {"a": "2", "b": "3"})])).collect()}
    assert got["d"] == {"a": "2", "b": "3", "c": "0"}


def test_rsf(spark):
    got = {r.id: r.score for r in S.rsf(lists(spark, [("d1", 50.0, None), ("d2", 30.0, None), ("d3", 10.0, None)], [("d2", 0.9, None), ("d4", 0.5, None), ("d3", 0.1, None)]), {0: 0.7, 1: 0.3}).collect()}
    assert got == pytest.approx({"d1": 0.7, "d2": 0.65, "d4": 0.15, "d3": 0.0})
    assert S.rsf(lists(spark, [("x", 5.0, None)])).first().score == 1.0


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[10] = x[11] = x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, None)], "id long, v array<double>").repartition(5)
    q = spark.createDataFrame([(7, x[12].tolist()), (9, x[0].tolist())], "q long, v array<double>")
    for metric in ("cosine", "ip", "l2"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for query, at in ((7, 12), (9, 0)):
            score = {"cosine": u @ u[at], "ip": x @ x[at], "l2": -np.linalg.norm(x - x[at], axis=1)}[metric]
            want = np.lexsort((np.arange(300), -np.round(score, 6)))[:4]
            got = [r.id for r in S.top_k(q, df, 4, metric).where(F.col("q") == query).orderBy("rank").collect()]
            assert got == want.tolist()
    assert S.top_k(q.limit(0), df, 4).count() == 0


def test_sql_search_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert [r.id for r in S.search_by_vector(df, [0.9, 0.1], operator="<=>", k=1).collect()] == [1]
    for bad in ({"operator": "=;"}, {"k": 0}, {"column": "x; drop"}):
        with pytest.raises(Exception):
            S.search_by_vector(df, [1.0, 0.0], **bad)


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, "d3", 1), (0, "d1", 2), (0, "d2", 3), (1, "x", 1)], "q int, id string, rank long")
    want = spark.createDataFrame([(0, "d1"), (0, "d2"), (1, "y")], "q int, id string")
    got = {r.q: r for r in M.query_metrics(ranked, want, [1, 3]).collect()}
    assert got[0].ndcg_3 == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))
    assert (got[0].mrr, got[0].recall_1, got[0].recall_3, got[1].mrr) == (0.5, 0.0, 1.0, 0.0)


def test_positive_rank(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1], [[0.0, 1.0], [0.95, 0.05]])], "query array<double>, positive array<double>, negatives array<array<double>>")
    assert df.select(M.positive_rank(F.col("query"), F.col("positive"), F.col("negatives"))).first()[0] == 2


def test_query_blocks_agree_with_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-50, 50, 16).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>").repartition(3)
    q = df.where("id < 23").withColumnRenamed("id", "q")
    packed = df.withColumn("v", V.quantize_binary(F.col("v")))
    cases = [(df, q, m) for m in ("cosine", "ip", "l2", "int8")] + [(packed, packed.where("id < 23").withColumnRenamed("id", "q"), "binary")]
    for corpus, queries, metric in cases:
        whole = sorted(map(tuple, S.top_k(queries, corpus, 4, metric).collect()))
        with monkeypatch.context() as m:
            m.setattr(S, "QUERY_BLOCK", 5)
            assert sorted(map(tuple, S.top_k(queries, corpus, 4, metric).collect())) == whole
        assert len(whole) == 92
    with monkeypatch.context() as m:
        m.setattr(S, "QUERY_BLOCK", 5)
        assert sorted(map(tuple, S.all_scores(q, df).select("q", "id").collect())) == [(a, b) for a in range(23) for b in range(120)]
    for metric, encoding in (("int8", "int8"), ("binary", "binary")):
        corpus, queries = (df.withColumn("v", F.col("v").cast("array<tinyint>")), q.withColumn("v", F.col("v").cast("array<tinyint>"))) if metric == "int8" else cases[-1][:2]
        want = S.ranked(S.all_scores(queries, corpus, encoding), 4)
        got = S.top_k(queries, corpus, 4, metric)
        assert sorted((r.q, r.id, round(r.score, 9)) for r in got.collect()) == sorted((r.q, r.id, round(r.score, 9)) for r in want.collect())


def _written(monkeypatch, *modules):
    """What is asked of the shared folder from now on."""
    asked = []
    for module in modules:
        monkeypatch.setattr(module, "shared_folder", lambda *a: asked.append(a) or "/nowhere")
    return asked


def test_pairs_of_large_query_sets_are_not_written(spark, monkeypatch):
    """More queries than one block: every pair, in a lazy plan without a table of pairs."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (90, 8)).astype(float)
    x[4] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None)], "id long, v array<double>").repartition(3)
    q = df.where("id < 31 or id = 90").withColumnRenamed("id", "q")
    for name, value in {"QUERY_BLOCK": 7, "QUERY_ROWS": 7, "CORPUS_ROWS": 20, "PAIRS": 25}.items():
        monkeypatch.setattr(S, name, value, raising=False)
    asked = _written(monkeypatch, S)
    pairs = S.with_queries(df, q.withColumnRenamed("v", "a")).select("q", "id")
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in [*range(31), 90] for b in range(91)]
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    for encoding in ("float", "int8"):
        got = {(r.q, r.id): (r.score, r.product) for r in S.all_scores(q, df, encoding, product=True).collect()}
        assert len(got) == 32 * 91 and all(got[a, b] == (None, None) for a, b in got if 90 in (a, b))
        assert all(got[a, b] == (pytest.approx(u[a] @ u[b], abs=1e-12), x[a] @ x[b]) for a in range(31) for b in range(90))
    assert not asked


def test_top_k_by_scores_spills_no_pair(spark, monkeypatch):
    """Each task sorts a bounded number of pairs, and only its k best of a query are shuffled."""
    df = spark.createDataFrame([(i, [float(i % 13), 1.0]) for i in range(200)], "id long, v array<double>").coalesce(1)
    q = df.where("id < 40").withColumnRenamed("id", "q")
    for name, value in {"QUERY_BLOCK": 10, "QUERY_ROWS": 10, "CORPUS_ROWS": 50}.items():
        monkeypatch.setattr(S, name, value, raising=False)
    asked = _written(monkeypatch, S)
    scores = S.all_scores(q, df)
    assert scores.rdd.getNumPartitions() >= 16 and not asked  # 4 blocks of queries by 4 parts of the corpus
    assert max(scores.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) <= 2000
    monkeypatch.undo()
    want = sorted((r.q, r.id, r.rank) for r in S.top_k(q, df, 4).collect())
    assert sorted((r.q, r.id, r.rank) for r in S.ranked(scores, 4).collect()) == want


def test_search_topk_expr_ranks_k_rows_of_few_parts(spark, monkeypatch, tmp_path):
    """What is shuffled grows with the queries, not with queries times parts of the corpus; the rows are those of the SQL."""
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, (900, 64)) / np.float32(8)
    x[100:140], x[300] = x[0], x[20]
    rows = [(i, None if i in (5, 40) else v.tolist(), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, value in {"QUERY_ROWS": 16, "CORPUS_ROWS": 20, "PAIRS": 500}.items():
        monkeypatch.setattr(S, name, value)
    ranked, given = S.ranked, []
    monkeypatch.setattr(S, "ranked", lambda rows, *a, **b: given.append(rows.count()) or ranked(rows, *a, **b))
    got = sorted((r.q, r["rank"], r.id, r.score) for r in core.QUERIES["search_topk_expr"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted((q, rank, id_, score) for q, id_, rank, score in con.execute(core.ORACLES["search_topk_expr"]).fetchall())
    assert [(a[:3], a[3] is None) for a in got] == [(a[:3], a[3] is None) for a in want] and len(got) == 450
    assert [a[3] for a in got if a[3] is not None] == pytest.approx([a[3] for a in want if a[3] is not None], abs=2e-6)
    assert given and max(given) <= 10 * 45 * 8  # 45 queries, 45 parts of 20 rows if nothing bounds them


def test_best_scores_on_odd_vectors(spark, monkeypatch):
    """Nulls last, NaN first, zero vectors 0, copies by number, a number asked twice: as all pairs ranked."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((70, 8))  # not of single precision
    x[30:] = rng.integers(-5, 6, (40, 8))
    x[3], x[50:60], x[7] = 0, x[31], [np.nan] * 8
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, None) for i in range(70, 90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    df = df.where("id < 30").coalesce(1).union(df.where("id >= 30").coalesce(1))
    q = df.where("id % 5 in (0, 1) or id in (3, 7)").withColumnRenamed("id", "q")
    q = q.union(spark.createDataFrame([(5, x[40].tolist())], "q long, v array<double>"))
    bytes_ = df.where("id >= 30").withColumn("v", F.col("v").cast("array<tinyint>"))
    cases = [("float", df, q), ("float", df.where("id in (1, 2, 3, 75, 76)"), q), ("float", df.where("id > 75"), q), ("float", df, q.where("q > 70"))]
    cases += [("int8", bytes_, bytes_.where("id % 7 = 0").withColumnRenamed("id", "q")), ("binary", bytes_, bytes_.where("id % 7 = 0").withColumnRenamed("id", "q"))]
    show = lambda rows: sorted((r.q, r["rank"], r.id, "none" if r.score is None else f"{r.score + 0.0:.9f}".replace("-0.000000000", "0.000000000")) for r in rows)
    for encoding, corpus, queries in cases:
        want = show(S.ranked(S.all_scores(queries, corpus, encoding), 6).collect())
        assert show(S.best_scores(queries, corpus, 6, encoding).collect()) == want and want
        with monkeypatch.context() as m:
            for name, value in {"QUERY_ROWS": 4, "CORPUS_ROWS": 9, "PAIRS": 30, "PACKED": 100}.items():
                m.setattr(S, name, value)
            assert show(S.best_scores(queries, corpus, 6, encoding).collect()) == want
    assert S.best_scores(q.limit(0), df, 6).count() == S.best_scores(q, df.limit(0), 6).count() == 0
    with pytest.raises(Exception, match="dimension"):
        S.best_scores(q, spark.createDataFrame([(1, [1.0] * 4)], "id long, v array<double>"), 6).collect()
    with pytest.raises(Exception, match="unknown"):
        S.best_scores(q, df, 6, "l2")


def test_max_sim_ranks_all_without_a_shuffle_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    docs = [rng.integers(-3, 4, 4 * (k % 4)).astype(float) for k in range(150)]
    ds = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)] + [(999, None)], "id long, v array<double>").repartition(3)
    qs = ds.where("id % 5 = 3").withColumnRenamed("id", "q")
    monkeypatch.setattr(S, "QUERY_BLOCK", 6)
    monkeypatch.setattr(R, "CELLS", 900, raising=False)
    asked = _written(monkeypatch, S)
    out = R.max_sim_rank(qs, ds, 4)
    got = {}
    for r in out.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.id, r.score))
    assert not asked and "Window" not in out._jdf.queryExecution().toString()
    assert sorted(got) == list(range(3, 150, 5))
    for a, rows in got.items():
        score = [(docs[a].reshape(-1, 4) @ d.reshape(-1, 4).T).max(axis=1).sum() if len(d) and len(docs[a]) else 0.0 for d in docs]
        assert rows == sorted(enumerate(score), key=lambda x: (-x[1], x[0]))


def test_max_sim(spark):
    rng = np.random.default_rng(4)
    q, docs = rng.standard_normal((2, 4)), [rng.standard_normal((k, 4)) for k in (1, 3, 5)]
    qs = spark.createDataFrame([(0, q.reshape(-1).tolist())], "q int, v array<double>")
    ds = spark.createDataFrame([(i, d.reshape(-1).tolist()) for i, d in enumerate(docs)] + [(9, [])], "id int, v array<double>")
    got = {r.id: r.score for r in R.max_sim_rank(qs, ds, 4).collect()}
    for i, d in enumerate(docs):
        assert got[i] == pytest.approx((q @ d.T).max(axis=1).sum())
    assert got[9] == 0
    with pytest.raises(Exception, match="multiple"):
        R.max_sim_rank(qs, spark.createDataFrame([(0, [1.0])], "id int, v array<double>"), 4).collect()


def test_multipath_hub():
    x = [[1, 0, 0, 0], [0, 1, 1, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    score, first = R.Multipath(alpha=0.8).score(None, x, [0.8, 0.7, 0.5, 0.5])
    assert score[1] > score[0] and first[0] == 0.8
    with pytest.raises(Exception):
        R.Multipath(alpha=1.0)


def test_time_reversal():
    x = [[1, 0, 0], [0.8, 0.6, 0], [0.8, -0.6, 0], [0, 0, 1]]
    score, first = R.TimeReversal(normalize=False).score(np.array([1, 0.1, 0]), x)
    assert score[0] > first[0] and score[1] < first[1] and score[2] < first[2] and score[3] == pytest.approx(first[3])
    one, s0 = R.TimeReversal().score(None, [[1, 0]], [0.3])
    assert one[0] == 0.3


def test_centroids_bundles(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "g int, v array<double>")
    assert S.bundle(df, "g", unit=False).first().v == [1, 1, 0]
    assert S.centroids(df, "g").first().v == [0.5, 0.5, 0]
    b = spark.createDataFrame([(1, [5, 255]), (1, [5, 0]), (1, [2, 0])], "g int, v array<smallint>")
    assert S.bundle_bytes(b, "g").first().v == [5, 0]
    assert S.bundle_bytes(b.limit(2), "g").first().v == [5, 255]  # ties are 1


def test_plane(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 5)) * [9, 4, 1, 0.5, 0.1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    mean, b1, b2 = S.principal_plane(df, rounds=50)
    w, axes = np.linalg.eigh(np.cov(x.T))
    assert abs(b1 @ axes[:, -1]) > 0.999 and abs(b2 @ axes[:, -2]) > 0.999
    np.testing.assert_allclose(mean, x.mean(0))


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a", "vector": [1, 2]}]))
    (tmp_path / "c.jsonl").write_text('{"id": "a", "vector": [1, 2]}\n{"id": "b", "vector": [3, 4]}\n')
    (tmp_path / "c.csv").write_text('id,vector\na,"[1, 2]"\n')
    (tmp_path / "q.csv").write_text('queryVector,expectedIds\n"[0.5, 1]",a;b\n')
    for name, n in (("c.json", 1), ("c.jsonl", 2), ("c.csv", 1)):
        rows = formats.read_corpus(spark, str(tmp_path / name)).collect()
        assert len(rows) == n and rows[0].v == [1, 2]
    got = formats.read_dataset(spark, str(tmp_path / "q.csv")).first()
    assert got.v == [0.5, 1] and got.expected == ["a", "b"]


def test_grid(spark):
    from vectorloom.operators.blocks import RankOne, map_vectors

    df = spark.createDataFrame([(0, [1.0, 1.0], [1.0, 0.5], [[0.5, 1.0]]), (1, [1.0, 0.9], [1.0, 0.1], [[0.9, 1.0]])], "ex long, query array<double>, positive array<double>, negatives array<array<double>>")
    scores, best = M.grid_search(df, {"s": [0.0, 5.0]}, lambda p: lambda d, c: map_vectors(d, [RankOne([1, 0], p["s"])], c, c))
    rows = {r.setting: r.mrr for r in scores.collect()}
    assert best["s"] == [0.0, 5.0][max(rows, key=lambda k: (round(rows[k], 12), -k))]
