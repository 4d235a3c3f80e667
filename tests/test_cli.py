import json

import pytest

from vectorloom import cli
from vectorloom.errors import ValidationError
from vectorloom.operators import blocks as B
from vectorloom.plans.pipeline import Pipeline


def test_evaluation_of_files(spark, tmp_path):
    corpus = [{"id": "x", "vector": [1, 0, 0]}, {"id": "y", "vector": [0, 1, 0]}, {"id": "z", "vector": [0, 0, 1]}]
    dataset = [{"queryVector": [0.9, 0.1, 0], "expectedDocIds": ["x"]}, {"queryVector": [0.1, 0.8, 0.1], "expectedDocIds": ["y"]}]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    (tmp_path / "d.json").write_text(json.dumps(dataset))
    stretch = B.Projection({"default": B.Weights([[100, 0, 0], [0, 1, 0], [0, 0, 1]], None)})
    (tmp_path / "p.json").write_text(Pipeline(3).add(stretch).to_json())
    config = {"corpus": str(tmp_path / "c.json"), "dataset": str(tmp_path / "d.json"), "pipeline": str(tmp_path / "p.json"), "kList": [1, 3]}
    got = {r.variant: r for r in cli.evaluate_files(spark, config).collect()}
    assert got["vanilla"].mrr == 1 and got["warped"].mrr < 1 and got["vanilla"].recall_1 == 1
    (tmp_path / "config.json").write_text(json.dumps(config))
    assert "ndcg_3" in cli.main(["--config", str(tmp_path / "config.json")])
    with pytest.raises(ValidationError):
        cli.evaluate_files(spark, {"corpus": "x"})
