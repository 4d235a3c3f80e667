"""Evaluation from a configuration file: ``python -m vectorloom.cli --config eval.json``.

The file names ``corpus`` and ``dataset`` (.json, .jsonl or .csv), optionally ``pipeline`` (a file with stored state),
``intent`` and ``kList``. Ids of the corpus are strings.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.errors import ValidationError
from vectorloom.operators import metrics as M
from vectorloom.operators.search import top_k
from vectorloom.plans.pipeline import Pipeline
from vectorloom.sources.formats import read_corpus, read_dataset


def evaluate_files(spark: SparkSession, config: dict) -> DataFrame:
    """(variant, queries, mrr, recall_k, ndcg_k ...) of a configuration."""
    for key in ("corpus", "dataset"):
        if key not in config:
            raise ValidationError(key, "is missing from the configuration")
    # ids become numbers in the order of the strings, so that ties of the score fall as they do for strings
    named = read_corpus(spark, config["corpus"]).withColumnRenamed("id", "name")
    numbers = named.select("name").distinct().withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    corpus = named.join(numbers, "name").select("id", "v")
    dataset = read_dataset(spark, config["dataset"]).cache()
    wanted = dataset.select("q", F.explode("expected").alias("name")).join(numbers, "name").select("q", "id")
    pipeline = None
    if config.get("pipeline"):
        pipeline = Pipeline.from_json(Path(config["pipeline"]).read_text())
        if config.get("intent"):
            pipeline = pipeline.with_context(config["intent"])
    ks = [int(k) for k in config.get("kList", (1, 3, 5, 10))]
    queries = dataset.select("q", "v")
    parts = []
    for variant, warp in (("vanilla", None), ("warped", pipeline)):
        if variant == "warped" and warp is None:
            continue
        a, b = (warp.run(queries), warp.run(corpus)) if warp else (queries, corpus)
        found = top_k(a, b, max(ks))
        parts.append(M.summary(M.query_metrics(found, wanted, ks)).withColumn("variant", F.lit(variant)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def main(arguments: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="vectorloom.cli", description=__doc__)
    parser.add_argument("--config", required=True)
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    text = M.report(evaluate_files(spark, json.loads(Path(options.config).read_text())))
    print(text)
    return text


if __name__ == "__main__":
    main()
