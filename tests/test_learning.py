import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.errors import ValidationError
from vectorloom.operators import feedback as K
from vectorloom.operators import learn as J


def test_adam_first_step():
    x, y = np.array([1.0, 2.0]), np.array([0.5, 3.0])
    w = J.train(J.Regression(), [{"input": x, "target": y}], J.Options(epochs=1, rate=0.1, regularization=0))
    g = x - y
    np.testing.assert_allclose(w.bias, -0.1 * g / (abs(g) + 1e-8))
    np.testing.assert_allclose(w.matrix, np.eye(2) - 0.1 * np.sign(np.outer(g, x)), atol=1e-6)


def test_triplet_margin_grows_and_stops():
    e = {"anchor": np.array([1.0, 0, 0]), "positive": np.array([0.8, 0.2, 0]), "negative": np.array([0.9, 0, 0.1])}
    w = J.train(J.Triplet(), [e], J.Options(epochs=100, rate=0.05))
    y = w.matrix @ e["anchor"] + w.bias
    assert y @ e["positive"] - y @ e["negative"] > e["anchor"] @ (e["positive"] - e["negative"])
    far = e | {"negative": np.array([-9.0, 0, 0])}
    np.testing.assert_array_equal(J.train(J.Triplet(), [far], J.Options(epochs=3)).matrix, np.eye(3))


def test_infonce():
    e = {"anchor": np.array([1.0, 0, 0]), "positive": np.array([0.8, 0.2, 0]), "negatives": np.array([[0.9, 0, 0.1], [0.85, 0, 0.2], [0.9, 0.1, 0.1]])}
    w = J.train(J.InfoNce(), [e], J.Options(epochs=60, rate=0.05))
    y = w.matrix @ e["anchor"] + w.bias
    assert all(y @ e["positive"] > y @ n for n in e["negatives"])


def test_migration_and_cross_encoder():
    pairs = [{"source": np.eye(4)[i], "target": t} for i, t in enumerate(np.array([[0.5, 0.5], [-0.5, 0.5], [0.5, -0.5], [-0.5, -0.5]]))]
    w = J.train(J.Regression("source", "target"), pairs, J.Options(rate=0.1, epochs=300))
    for p in pairs:
        y = w.matrix @ p["source"] + w.bias
        assert y @ p["target"] / np.linalg.norm(y) / np.linalg.norm(p["target"]) > 0.95
    rows = [{"query": np.array([1.0, 0]), "document": d, "score": np.array(s)} for d, s in ((np.array([1.0, 0]), 1.0), (np.array([0, 1.0]), 0.0))]
    c = J.train(J.CrossEncoder(), rows, J.Options(epochs=200))
    score = [float((c.matrix @ np.concatenate([r["query"], r["document"]]) + c.bias)[0]) for r in rows]
    assert score[0] > score[1]


def test_patience_generator_and_rates():
    e = [{"input": np.array([1.0]), "target": np.array([1.0])}]
    w = J.train(J.Regression(), e, J.Options(epochs=1000, patience=2, regularization=0))
    np.testing.assert_array_equal(w.matrix, [[1.0]])
    a = J.train(J.Regression(), lambda: iter(e), J.Options(epochs=5))
    np.testing.assert_allclose(a.matrix, J.train(J.Regression(), e, J.Options(epochs=5)).matrix)
    options = J.Options(auto_rate=True, epochs=3)
    J.train(J.Regression(), [{"input": np.array([1.0]), "target": np.array([3.0])}], options)
    assert options.auto_rate and J.best_rate(J.Regression(), [{"input": np.array([1.0]), "target": np.array([3.0])}], options) == 0.1
    for bad in (J.Options(rate=0), J.Options(epochs=0), J.Options(margin=-1), J.Options(temperature=float("nan"))):
        with pytest.raises(ValidationError):
            bad.check()
    with pytest.raises(ValidationError):
        J.train(J.Regression(), [], J.Options())


def test_models_match_local(spark):
    rng = np.random.default_rng(6)
    rows = [(m, s, rng.standard_normal(3).tolist(), rng.standard_normal(2).tolist()) for m in (0, 1) for s in range(5)]
    df = spark.createDataFrame(rows, "model int, seq long, input array<double>, target array<double>")
    got = J.train_models(df, J.Regression(), J.Options(epochs=3)).where("model = 1").collect()
    want = J.train(J.Regression(), [{"input": np.array(r[2]), "target": np.array(r[3])} for r in rows if r[0] == 1], J.Options(epochs=3))
    for r in got:
        assert r.w == pytest.approx(want.bias[r.i] if r.j is None else want.matrix[r.i, r.j])


def test_factory_small(spark):
    df = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0]), ("b", 2, [3.0])], "c string, o int, v array<double>")
    rows = {(r.c, r.seq): r for r in J.factory_examples(df, "c", "o").collect()}
    assert rows["a", 0].positive == [2.0] and rows["a", 1].positive == [1.0] and rows["b", 0].positive == [3.0]
    assert rows["a", 0].negatives == [[3.0]] and rows["b", 0].negatives == [[1.0], [2.0]]
    with pytest.raises(ValidationError):
        J.build_intents(df.where("c = 'a'"), "c", "o")


def test_whitening_fit_finds_axis(spark):
    rng = np.random.default_rng(7)
    x = np.outer(rng.standard_normal(400), [0.6, 0.8]) * 3 + rng.standard_normal((400, 2)) * 0.05
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "model int, seq long, v array<double>")
    axis = np.array(J.fit_whitening(df, 2, 1, 0.01).first().components[0])
    assert abs(axis @ [0.6, 0.8]) > 0.99


def feedback(spark, signals):
    imps = spark.createDataFrame([("i", [9.0], [[0.0], [1.0], [2.0], [3.0]], 1)], "imp_id string, query array<double>, results array<array<double>>, ts long")
    return imps, spark.createDataFrame(signals, "imp_id string, idx int, type string, value double")


def test_feedback_rules(spark):
    imps, s = feedback(spark, [("i", 0, "click", None), ("i", 0, "skip", None), ("i", 1, "dwell", 3000.0), ("i", 2, "dwell", None), ("i", 7, "click", None), ("gone", 0, "click", None)])
    rows = {r.idx: (r.positive, r.negative) for r in K.classify_results(imps, s).collect()}
    assert rows == {0: (True, False), 1: (True, False), 2: (False, True), 3: (False, True)}
    assert K.accept_signals(s, imps)[1].count() == 2
    assert K.triplets(imps, s).count() == 4
    got = K.infonce_examples(imps, s).where("pos_idx = 0").first()
    assert got.negatives == [[2.0], [3.0]]
    assert K.counters(imps, s).first().actionable == 1
    imps, none = feedback(spark, [("i", 1, "skip", None)])
    assert K.triplets(imps, none).count() == 0


def test_eviction(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("imp_id"), F.col("id").alias("ts"))
    kept = K.keep_latest(df)
    assert kept.count() == 200 and kept.agg(F.min("ts")).first()[0] == 100


def test_scheduler():
    s = K.Scheduler(J.OnlineTrainer(J.Regression()), batch=3)
    w, e = J.initial(1, 1), {"input": np.array([1.0]), "target": np.array([2.0])}
    assert s.add(w, [e, e]) is None and s.steps == 0
    assert s.add(w, [e]) is not None and s.steps == 3
    assert s.flush(w) is None
    d = K.Scheduler(J.OnlineTrainer(J.Regression()), least=0.001, decay=0.1, batch=1)
    d.add(w, [e] * 100)
    assert d.rate == pytest.approx(0.001, abs=5e-4)
    assert K.Scheduler.import_state(d.trainer, d.export_state()).steps == 100
    with pytest.raises(ValidationError):
        K.Scheduler.import_state(d.trainer, "[]")


def test_stream_ewma_equals_batch(spark, tmp_path):
    from vectorloom.streaming.streams import ewma_stream

    rows = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * F.col("id") % 17).cast("double").alias("x"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = {}
    out = ewma_stream(stream, "k", "o", "x", 0.1).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: found.update({r.k: r.ewma for r in df.collect()})).start()
    out.awaitTermination()
    want = {r.k: r.ewma for r in J.ewma(rows, "k", "o", "x", 0.1).collect()}
    assert found == pytest.approx(want)


def test_stream_training(spark, tmp_path):
    from vectorloom.streaming.streams import online_training

    rows = spark.range(12).select(F.col("id").alias("seq"), F.array(F.lit(1.0)).alias("input"), F.array(F.lit(2.0)).alias("target"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = K.Scheduler(J.OnlineTrainer(J.Regression()))
    query, held = online_training(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), s, J.initial(1, 1), ("input", "target"), str(tmp_path / "c"))
    query.awaitTermination()
    assert s.steps == 10 and len(s.held) == 2 and held["weights"].bias[0] > 0
