"""The same steps on Structured Streaming, and state that lives in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.blocks import Weights
from vectorloom.operators.feedback import Scheduler
from vectorloom.plans.pipeline import Pipeline


def run_stream(stream: DataFrame, pipeline: Pipeline, column: str = "v", output: str | None = None) -> DataFrame:
    """A pipeline on a streaming DataFrame: stateless, so order and batch size do not matter."""
    return pipeline.run(stream, column, output)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Write all that is available to Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ewma_stream(stream: DataFrame, key: str, order: str, value: str, rate: float = 0.01) -> DataFrame:
    """(key, ewma, n) after each micro-batch: a running exponentially weighted mean with its state in Spark's store.
    Values within a batch are taken in order of ``order``; batches follow one another."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("o", kind="stable")
        for x in rows["x"]:
            mean = x if mean is None else mean * (1 - rate) + x * rate
            n += 1
        state.update((mean, n))
        yield pd.DataFrame({key: [k[0]], "ewma": [mean], "n": [n]})

    rows = stream.select(key, F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ewma double, n long", "ewma double, n long", "update", "NoTimeout")


def signals_with_watermark(signals: DataFrame, impressions: DataFrame, delay: str = "1 hour", keep: str = "1 hour") -> DataFrame:
    """Signals joined to their impressions on streams; the watermarks bound the state. A signal counts within ``keep`` of
    its impression (columns ts on both sides)."""
    a = impressions.withWatermark("ts", delay).select("imp_id", F.col("ts").alias("shown"), "query", "results")
    b = signals.withWatermark("ts", delay).select(F.col("imp_id").alias("_id"), F.col("ts").alias("given"), "idx", "type", "value")
    near = (F.col("given") >= F.col("shown")) & (F.col("given") <= F.col("shown") + F.expr(f"interval {keep}"))
    return a.join(b, (F.col("imp_id") == F.col("_id")) & near).drop("_id").where((F.col("idx") >= 0) & (F.col("idx") < F.size("results")))


def online_training(stream: DataFrame, scheduler: Scheduler, weights: Weights, columns: tuple[str, ...], checkpoint: str, on_update=None, limit: int = 10_000):
    """Feed a stream of examples (seq and ``columns``) to a scheduler, micro-batch by micro-batch in order of seq.

    A model's steps follow one another, so they run on the driver; a batch of more than ``limit`` examples is read
    piece by piece, never as a whole.
    """
    held = {"weights": weights}

    def feed(batch: DataFrame, _: int) -> None:
        import numpy as np

        rows, part = batch.select("seq", *columns).orderBy("seq").toLocalIterator(), []
        for row in rows:
            part.append({c: np.asarray(row[c], dtype=float) for c in columns})
            if len(part) == min(limit, scheduler.limit):
                held["weights"], part = scheduler.add(held["weights"], part) or held["weights"], []
        if part:
            held["weights"] = scheduler.add(held["weights"], part) or held["weights"]
        if on_update:
            on_update(held["weights"])

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(feed).start()
    return query, held
