import json

import numpy as np
import pytest

from vectorloom.errors import DimensionError, StepError, ValidationError
from vectorloom.operators import blocks as B
from vectorloom.operators import weights as W
from vectorloom.plans.pipeline import Pipeline, Tracer


def run(step, *rows):
    return step.apply(np.array(rows, dtype=float))


def test_intents():
    m = [[0.5, -0.2, 0.1], [0.1, 0.8, -0.3], [-0.4, 0.5, 0.9]]
    step = B.Intents({"a": B.Weights(m, [0.1, 0.2, -0.1]), "i": B.Weights(np.eye(3), np.zeros(3))}, "a")
    np.testing.assert_allclose(run(step, [1, 2, 3]), [[0.5, 1, 3.2]])
    np.testing.assert_allclose(run(step.with_mode({"a": 0.5, "i": 0.5}), [1, 2, 3]), [[0.75, 1.5, 3.1]])
    with pytest.raises(ValidationError):
        step.with_mode("none")
    with pytest.raises(ValidationError):
        step.with_mode("auto")
    assert step.remove("i").names == ["a"]
    assert step.add("a", B.Weights(np.eye(3), np.zeros(3))).routings[0] is None


def test_auto_blend():
    step = B.Intents({"a": B.Weights(np.eye(2), [1, 1], [1, 0]), "b": B.Weights(np.eye(2), [-1, -1], [0, 1])}, "auto")
    out = run(step, [1, 0.1])[0]
    assert out[0] > 1 and out[1] > 0


def test_low_rank_projection_mlp():
    np.testing.assert_allclose(run(B.LowRank({"a": ([[1], [1], [1]], [[1, 1, 1]], [1, 2, 3])}, "a"), [1, 2, 3]), [[8, 10, 12]])
    np.testing.assert_allclose(run(B.LowRank({"a": ([[2], [0], [0]], [[1, 0, 0]], [0, 0, 0])}, "a"), [5, 5, 5]), [[15, 5, 5]])
    np.testing.assert_allclose(run(B.Projection({"default": B.Weights([[1, 0, 0], [0, 1, 0]], None)}), [5, 10, 15]), [[5, 10]])
    np.testing.assert_allclose(run(B.Mlp([(np.diag([2.0, 3.0]), [1, -1], "linear")]), [5, 4]), [[11, 11]])
    with pytest.raises(DimensionError):
        B.Mlp([(np.eye(2), [0, 0], "relu"), (np.eye(3), [0, 0, 0], "relu")])


def test_experts():
    step = B.Experts([("x", B.Weights(2 * np.eye(2), None)), ("y", B.Weights(-np.eye(2), None))], [[1, 0], [0, 1]])
    np.testing.assert_allclose(run(step, [1, 0.1], [0.1, 1]), [[2, 0.2], [-0.1, -1]])
    custom = B.Experts([("p", B.Weights(np.eye(1), [1])), ("m", B.Weights(np.eye(1), [-1]))], router=lambda x: (x[:, 0] < 0).astype(int))
    np.testing.assert_allclose(run(custom, [5], [-5]), [[6], [-6]])


def test_guard():
    np.testing.assert_allclose(run(B.AnomalyGuard(50, "safe"), [10, 100, -60, 25]), [[5, 50, -30, 12.5]])
    for bad in ([1, np.nan, 3], [1, np.inf, 3], [100.1, 2, 3]):
        with pytest.raises(ValidationError):
            run(B.AnomalyGuard(), bad)


def test_whitening():
    w = np.array([[1.0, 0, 0]])
    np.testing.assert_allclose(run(B.Whitening([1, 1, 1], w), [3, 2, 1]), [[0, 1, 0]])
    np.testing.assert_allclose(run(B.SoftWhitening([0, 0, 0], w, [1e9]), [3, 2, 0]), [[0, 1, 0]], atol=1e-9)


def test_merge_and_federate():
    out = W.merge([(B.Weights(2 * np.eye(2), [1, 1]), 0.5)])
    np.testing.assert_allclose(out.matrix, 1.5 * np.eye(2))
    base = B.Weights([[1, 2], [3, 4]], [1, -1])
    out = W.merge([(B.Weights([[2, 2], [3, 5]], [2, 0]), 1.0), (B.Weights([[1, 0], [0, 4]], [1, -3]), 0.5)], base)
    np.testing.assert_allclose(out.matrix, [[2, 1], [1.5, 5]])
    np.testing.assert_allclose(out.bias, [2, -1])
    agg = W.FederatedAggregator(B.Weights(np.eye(2), np.zeros(2)))
    agg.submit(B.Weights([[1.1, 0], [0, 1]], [0, 0]), 75)
    agg.submit(B.Weights([[1.5, 0], [0, 1]], [0, 0]), 25)
    assert agg.client_count == 2
    assert agg.aggregate().matrix[0, 0] == pytest.approx(1.2)
    with pytest.raises(ValidationError):
        agg.submit(agg.base, 0)
    agg.reset()
    with pytest.raises(ValidationError):
        agg.aggregate()


def test_bytes_round_trip():
    w = B.Weights([[1, 2], [3, 4]], [5, 6], [7, 8])
    back = W.from_bytes(W.to_bytes(w))
    np.testing.assert_allclose(back.matrix, w.matrix)
    np.testing.assert_allclose(back.routing, w.routing)
    with pytest.raises(ValidationError):
        W.from_bytes(W.to_bytes(w)[:-1])


STEPS = [
    B.Intents({"a": B.Weights(np.eye(3) * 2, [1, 2, 3], [1, 0, 0])}, "a", "tanh"),
    B.LowRank({"a": (np.ones((3, 1)), np.ones((1, 3)), np.zeros(3))}, "a"),
    B.Projection({"default": B.Weights(np.ones((2, 3)), None)}),
    B.Mlp([(np.ones((2, 3)), [0, 1], "relu")]),
    B.Experts([("a", B.Weights(np.eye(3), None))], [[1, 0, 0]]),
    B.Whitening(np.ones(3), np.eye(1, 3)),
    B.SoftWhitening(np.ones(3), np.eye(1, 3), [0.5]),
    B.AnomalyGuard(2.0, "safe"),
    B.Normalize(),
    B.RankOne([1, 0, 0], 0.5),
]


@pytest.mark.parametrize("step", STEPS, ids=lambda s: s.kind)
def test_state_round_trip(step):
    x = np.random.default_rng(1).standard_normal((5, 3))
    text = Pipeline(3).add(step).encode("int8", 1.0).to_json()
    again = Pipeline.from_json(text)
    np.testing.assert_array_equal(step.apply(x), again.steps[0].apply(x))
    json.loads(text)
    assert again.encoder.clip == 1.0


def test_pipeline_errors_and_inspection():
    p = Pipeline(3).add(B.Projection({"default": B.Weights(np.ones((2, 3)), None)}))
    with pytest.raises(StepError):
        p.add(B.Projection({"default": B.Weights(np.ones((2, 3)), None)}))
    assert "projection -> 2" in p.inspect()
    assert p.dry_run([1, 2, 3])[0]["output"] == [6, 6]
    with pytest.raises(ValidationError):
        Pipeline.from_json("{}")
    with pytest.raises(StepError):
        Pipeline.from_json('{"dim": 3, "steps": [{"kind": "unknown", "state": {}}]}')


def test_fused_equals_unfused():
    rng = np.random.default_rng(2)
    p = Pipeline(4).intents({"a": B.Weights(rng.standard_normal((4, 4)), rng.standard_normal(4))}, "a").add(B.RankOne([1, 0, 0, 0], 0.5)).projection({"default": B.Weights(rng.standard_normal((2, 4)), rng.standard_normal(2))})
    x = rng.standard_normal((6, 4))
    y = x
    for s in p.steps:
        y = s.apply(y)
    f = p.fused()
    assert len(f.steps) == 1
    np.testing.assert_allclose(f.steps[0].apply(x), y)


def test_map_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, None, "b"), (3, [0.0, 0.0], None)], "id long, v array<double>, note string")
    rows = {r.id: r for r in B.map_vectors(df, [B.Normalize()]).collect()}
    assert rows[1].v == pytest.approx([0.6, 0.8]) and rows[2].v is None and rows[3].v == [0, 0] and rows[1].note == "a"
    enc = B.map_vectors(df, [], encoder=B.Encoder("int8_dynamic")).where("id = 1").first().v
    assert list(enc.q) == [95, 127] and enc.scale == 4
    assert B.map_vectors(df.limit(0), [B.Normalize()]).count() == 0
    with pytest.raises(Exception, match="expected dimension"):
        B.map_vectors(df, [B.Whitening(np.zeros(3), np.eye(1, 3))]).collect()
    out = Pipeline(2).add(B.Normalize()).run_and_format(df.where("id = 1"), "pgvector").first()
    assert out.formatted == "[0.6, 0.8]"


def test_tracer():
    t = Tracer()
    t.trace("ok", lambda: 1)
    with pytest.raises(ZeroDivisionError):
        t.trace("ok", lambda: 1 / 0)
    assert t.get()["ok"]["count"] == 2
