"""Algebra on weight sets: task merges, federated averages, and their storage forms.

Weight tables have the rows (name, i, j, w): row i and column j of a matrix, with j null for the bias.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.errors import DimensionError, ValidationError
from vectorloom.operators.blocks import Weights


def task_merge(tasks: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """W0 + sum of scale * (W_t - W0), elementwise, over the rows (task, scale, i, j, w) of ``tasks``.

    ``base`` has (i, j, w); without it the base is the identity with zero bias. Elements with a null j are the bias.
    Returns (i, j, w), a row for each element of the tasks. One aggregation with partial sums.
    """
    if base is None:
        origin = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
        rows = tasks.withColumn("w0", origin)
    else:
        known = base.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("w").alias("w0"))
        rows = tasks.join(known, F.col("i").eqNullSafe(F.col("bi")) & F.col("j").eqNullSafe(F.col("bj")), "left").withColumn("w0", F.coalesce("w0", F.lit(0.0)))
    return rows.groupBy("i", "j").agg((F.first("w0") + F.sum(F.col("scale") * (F.col("w") - F.col("w0")))).alias("w"))


def federated_average(updates: DataFrame) -> DataFrame:
    """Average of (client, n, i, j, w) weighted by the interaction counts n; counts must be positive."""
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("interaction counts must be positive")).cast("long"))
    return updates.withColumn("n", n).groupBy("i", "j").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w"))


def merge(tasks: list[tuple[Weights, float]], base: Weights | None = None) -> Weights:
    """The same for weights in hand; the routing vector is dropped."""
    if not tasks:
        raise ValidationError("tasks", "at least one is needed")
    shape = tasks[0][0].matrix.shape
    for w, _ in tasks:
        if w.matrix.shape != shape:
            raise DimensionError(shape[0], w.matrix.shape[0], "task")
    m0 = base.matrix if base else np.eye(*shape)
    b0 = base.bias if base else np.zeros(shape[0])
    return Weights(m0 + sum(s * (w.matrix - m0) for w, s in tasks), b0 + sum(s * (w.bias - b0) for w, s in tasks))


class FederatedAggregator:
    """Collects client updates against a base and averages them by interaction count."""

    def __init__(self, base: Weights):
        self.base, self.updates = base, []

    def submit(self, weights: Weights, interactions: int) -> None:
        if interactions <= 0:
            raise ValidationError("interactions", "must be positive")
        if weights.matrix.shape != self.base.matrix.shape:
            raise DimensionError(len(self.base.bias), len(weights.bias), "update")
        self.updates.append((weights, interactions))

    @property
    def client_count(self) -> int:
        return len(self.updates)

    def aggregate(self) -> Weights:
        if not self.updates:
            raise ValidationError("updates", "none were submitted")
        n = sum(k for _, k in self.updates)
        out = merge([(w, k / n) for w, k in self.updates], self.base)
        return Weights(out.matrix, out.bias, self.base.routing)

    def reset(self, base: Weights | None = None) -> None:
        self.updates = []
        self.base = base or self.base


def to_bytes(weights: Weights) -> bytes:
    """Little-endian: dimension (u32), whether a routing vector follows (u8), three zero bytes, then single-precision matrix, bias and routing."""
    parts = [weights.matrix.astype("<f4").tobytes(), weights.bias.astype("<f4").tobytes()]
    if weights.routing is not None:
        parts.append(weights.routing.astype("<f4").tobytes())
    return struct.pack("<IB3x", len(weights.bias), weights.routing is not None) + b"".join(parts)


def from_bytes(data: bytes) -> Weights:
    if len(data) < 8:
        raise ValidationError("data", "is shorter than its header")
    dim, routed = struct.unpack("<IB3x", data[:8])
    if len(data) != 8 + 4 * (dim * dim + dim * (2 if routed else 1)):
        raise ValidationError("data", "length does not suit its dimension")
    values = np.frombuffer(data, dtype="<f4", offset=8).astype(np.float64)
    square = dim * dim
    return Weights(values[:square].reshape(dim, dim), values[square : square + dim], values[square + dim :] if routed else None)


def blend_rows(table: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the named maps of a weight table, once, before any vector meets them."""
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
    share = F.create_map(*pairs)[F.col("name")]
    return table.where(F.col("name").isin(*weights)).groupBy("i", "j").agg(F.sum(share * F.col("w")).alias("w"))
