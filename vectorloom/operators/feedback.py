"""Feedback logs as training examples, and the schedule that feeds them to an online trainer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import ValidationError, positive, positive_int
from vectorloom.operators.blocks import Weights
from vectorloom.operators.learn import OnlineTrainer

#: Impressions that are kept, and the dwell time that counts as interest.
KEPT, DWELL_MS = 200, 3000.0


def keep_latest(impressions: DataFrame, limit: int = KEPT, by: list[str] | None = None) -> DataFrame:
    """The ``limit`` latest impressions (of each ``by``) by ts, then id."""
    rank = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.col("ts").desc(), F.col("imp_id").desc()))
    return impressions.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def accept_signals(signals: DataFrame, impressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) signals: the impression must be kept and the index within its results."""
    known = impressions.select("imp_id", F.size("results").alias("_n"))
    rows = signals.join(known, "imp_id", "left")
    good = F.coalesce((F.col("idx") >= 0) & (F.col("idx") < F.col("_n")), F.lit(False))
    return rows.where(good).drop("_n"), rows.where(~good).drop("_n")


def classify(signals: DataFrame, keys: list[str], idx: str = "idx", kind: str = "type", value: str = "value") -> DataFrame:
    """(keys, idx, positive, negative): click, or dwell of ``DWELL_MS`` or more: positive; skip, shorter or missing dwell:
    negative; positive wins over negative on one result. Results without a signal are not listed here."""
    long = (F.col(kind) == "dwell") & (F.coalesce(F.col(value), F.lit(-1.0)) >= DWELL_MS)
    pos = F.max(F.when((F.col(kind) == "click") | long, 1).otherwise(0)).alias("pos")
    neg = F.max(F.when((F.col(kind) == "skip") | ((F.col(kind) == "dwell") & ~long), 1).otherwise(0)).alias("neg")
    rows = signals.groupBy(*keys, idx).agg(pos, neg)
    return rows.select(*keys, idx, (F.col("pos") == 1).alias("positive"), ((F.col("pos") == 0) & (F.col("neg") == 1)).alias("negative"))


def classify_results(impressions: DataFrame, signals: DataFrame) -> DataFrame:
    """(imp_id, idx, v, positive, negative) for every result; unlabelled results are negative where the impression has a
    positive one."""
    marks = classify(accept_signals(signals, impressions)[0], ["imp_id"])
    results = impressions.select("imp_id", F.posexplode("results").alias("idx", "v"))
    rows = results.join(marks, ["imp_id", "idx"], "left")
    pos, neg = F.coalesce("positive", F.lit(False)), F.coalesce("negative", F.lit(False))
    any_pos = F.max(pos.cast("int")).over(Window.partitionBy("imp_id")) == 1
    return rows.select("imp_id", "idx", "v", pos.alias("positive"), (neg | (~pos & ~neg & any_pos)).alias("negative"))


def triplets(impressions: DataFrame, signals: DataFrame) -> DataFrame:
    """(imp_id, pos_idx, neg_idx, anchor, positive, negative): every positive with every negative of its impression."""
    rows = classify_results(impressions, signals)
    pos = rows.where("positive").select("imp_id", F.col("idx").alias("pos_idx"), F.col("v").alias("positive"))
    neg = rows.where("negative").select("imp_id", F.col("idx").alias("neg_idx"), F.col("v").alias("negative"))
    return pos.join(neg, "imp_id").join(impressions.select("imp_id", F.col("query").alias("anchor")), "imp_id").select("imp_id", "pos_idx", "neg_idx", "anchor", "positive", "negative")


def infonce_examples(impressions: DataFrame, signals: DataFrame) -> DataFrame:
    """(imp_id, pos_idx, anchor, positive, negatives): one example a positive, with all negatives in order; impressions
    without negatives give none."""
    rows = triplets(impressions, signals)
    return rows.groupBy("imp_id", "pos_idx").agg(F.first("anchor").alias("anchor"), F.first("positive").alias("positive"), F.transform(F.array_sort(F.collect_list(F.struct("neg_idx", "negative"))), lambda r: r["negative"]).alias("negatives"))


def counters(impressions: DataFrame, signals: DataFrame) -> DataFrame:
    """pending: kept impressions; actionable: those that give a triplet."""
    rows = classify_results(impressions, signals).groupBy("imp_id").agg(F.max(F.col("positive").cast("int")).alias("p"), F.max(F.col("negative").cast("int")).alias("n"))
    return impressions.select("imp_id").distinct().join(rows, "imp_id", "left").agg(F.count("*").alias("pending"), F.sum(F.when((F.col("p") == 1) & (F.col("n") == 1), 1).otherwise(0)).alias("actionable"))


class Scheduler:
    """Feeds examples to an online trainer in batches with a decaying rate: max(least, first / (1 + decay * steps))."""

    def __init__(self, trainer: OnlineTrainer, first: float = 0.01, least: float = 0.0001, decay: float = 0.001, batch: int = 5, buffer: int = 100):
        self.trainer = trainer
        self.first, self.least, self.decay = positive(first, "first"), positive(least, "least"), float(decay)
        self.batch, self.limit = positive_int(batch, "batch"), positive_int(buffer, "buffer")
        self.steps, self.held = 0, []

    @property
    def rate(self) -> float:
        return max(self.least, self.first / (1 + self.decay * self.steps))

    def _run(self, weights: Weights, examples: list[dict]) -> Weights:
        for example in examples:
            weights = self.trainer.update(weights, example, self.rate)
            self.steps += 1
        return weights

    def add(self, weights: Weights, examples: list[dict]) -> Weights | None:
        """New weights after every full batch, or None while fewer than a batch is held; the newest ``buffer`` stay."""
        self.held = (self.held + list(examples))[-self.limit :]
        if len(self.held) < self.batch:
            return None
        whole = len(self.held) // self.batch * self.batch
        now, self.held = self.held[:whole], self.held[whole:]
        return self._run(weights, now)

    def flush(self, weights: Weights) -> Weights | None:
        now, self.held = self.held, []
        return self._run(weights, now) if now else None

    def export_state(self) -> str:
        return json.dumps({"first": self.first, "least": self.least, "decay": self.decay, "batch": self.batch, "buffer": self.limit, "steps": self.steps})

    @classmethod
    def import_state(cls, trainer: OnlineTrainer, state: str) -> Scheduler:
        try:
            s = json.loads(state)
            out = cls(trainer, s["first"], s["least"], s["decay"], s["batch"], s["buffer"])
            out.steps = int(s["steps"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValidationError("state", f"cannot be read: {e}") from e
        return out


def schedule(examples: DataFrame, by: str, order: str, first: float = 0.01, least: float = 0.0001, decay: float = 0.001, batch: int = 5) -> DataFrame:
    """The rate and batch of each example as a column computation: step n (from 0) has max(least, first / (1 + decay n))."""
    step = (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long")
    return examples.withColumn("step", step).withColumn("chunk", F.floor(F.col("step") / batch).cast("long")).withColumn("rate", F.greatest(F.lit(float(least)), F.lit(float(first)) / (1 + F.lit(float(decay)) * F.col("step"))))
