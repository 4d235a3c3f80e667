"""Pipelines of vector steps: building, running, formatting, state, inspection and metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vectorloom.errors import StepError, ValidationError, VectorError
from vectorloom.operators import blocks as B
from vectorloom.sources.formats import FORMATS, register_format

__all__ = ["FORMATS", "Metrics", "Pipeline", "Tracer", "register_format", "register_step"]

#: Step kinds that stored state may name; ``register_step`` adds to them.
STEPS: dict[str, type[B.Step]] = {s.kind: s for s in (B.Intents, B.LowRank, B.Projection, B.Alignment, B.Mlp, B.Experts, B.Whitening, B.SoftWhitening, B.AnomalyGuard, B.Normalize, B.RankOne)}


def register_step(cls: type[B.Step]) -> type[B.Step]:
    """Make a step class known to ``Pipeline.from_json`` (also usable as a decorator)."""
    STEPS[cls.kind] = cls
    return cls


class Pipeline:
    """An ordered list of steps and an optional encoder. All steps run in one Arrow pass over the data."""

    def __init__(self, dim: int):
        self.dim_in = B.positive_dim(dim)
        self.dim = dim
        self.steps: list[B.Step] = []
        self.encoder: B.Encoder | None = None
        self.metrics: Metrics | None = None

    def measured(self, metrics: Metrics) -> Pipeline:
        """Runs report to ``metrics`` as long as it is enabled."""
        self.metrics = metrics
        return self

    def add(self, step: B.Step) -> Pipeline:
        try:
            self.dim = B.check_dims([step], self.dim)
        except VectorError as e:
            raise StepError(len(self.steps), step.kind, str(e)) from e
        self.steps.append(step)
        return self

    def intents(self, intents: dict[str, B.Weights], mode="default", activation: str | None = None) -> Pipeline:
        return self.add(B.Intents(intents, mode, activation))

    def low_rank(self, factors: dict[str, tuple], name: str = "default", activation: str | None = None) -> Pipeline:
        return self.add(B.LowRank(factors, name, activation))

    def projection(self, versions: dict[str, B.Weights], version: str = "default") -> Pipeline:
        return self.add(B.Projection(versions, version))

    def encode(self, encoding: str, clip: float | None = None) -> Pipeline:
        """The final stage."""
        self.encoder = B.Encoder(encoding, clip)
        return self

    def with_context(self, intent=None, version: str | None = None) -> Pipeline:
        """A copy whose intent steps use ``intent`` and whose projections use ``version``, or else the intent's name."""
        out = Pipeline(self.dim_in)
        for step in self.steps:
            if isinstance(step, B.Intents) and intent is not None:
                step = step.with_mode(intent)
            elif isinstance(step, B.LowRank) and isinstance(intent, str):
                step = B.LowRank({n: tuple(f) for n, f in step.factors.items()}, intent, step.activation)
            elif isinstance(step, B.Projection) and (version or intent) in step.versions:
                step = type(step)({n: B.Weights(*w) for n, w in step.versions.items()}, version or intent)
            out.add(step)
        out.encoder = self.encoder
        return out

    def run(self, df: DataFrame, column: str = "v", output: str | None = None, single: bool = False) -> DataFrame:
        """``df`` with the result; without steps and encoder the input comes back as it is. Works on streams too."""
        if self.metrics is None or not self.metrics.enabled:
            return B.map_vectors(df, self.steps, column, output or column, self.encoder, single)
        steps = self.metrics.timed(df.sparkSession, self.steps)
        return self.metrics.watch(B.map_vectors(df, steps, column, output or column, self.encoder, single))

    def run_and_format(self, df: DataFrame, fmt: str, column: str = "v", output: str = "formatted", **options) -> DataFrame:
        if fmt not in FORMATS:
            raise ValidationError("format", f"unknown: {fmt}")
        out = self.run(df, column)
        return out.withColumn(output, FORMATS[fmt](F.col(column), **options))

    def fused(self) -> Pipeline:
        """Neighbouring affine steps without an activation between them made one; changes the last bits of results."""
        out = Pipeline(self.dim_in)
        held: tuple[np.ndarray, np.ndarray] | None = None

        def close() -> None:
            nonlocal held
            if held:
                out.add(B.Projection({"default": B.Weights(*held)}))
            held = None

        for step in self.steps:
            pair = None
            if isinstance(step, B.Intents) and isinstance(step.mode, str) and step.mode != "auto" and not (step.activation and step.activation != "linear"):
                i = step.names.index(step.mode)
                pair = (step.matrices[i], step.biases[i])
            elif isinstance(step, B.Projection):
                pair = tuple(step.versions[step.version])
            elif isinstance(step, B.RankOne):
                w = step.weights()
                pair = (w.matrix, w.bias)
            if pair is None:
                close()
                out.add(step)
            else:
                held = pair if held is None else (pair[0] @ held[0], pair[0] @ held[1] + pair[1])
        close()
        out.encoder = self.encoder
        return out

    def to_json(self) -> str:
        return json.dumps({"dim": self.dim_in, "steps": [{"kind": s.kind, "state": s.state()} for s in self.steps], "encoder": None if self.encoder is None else {"encoding": self.encoder.encoding, "clip": self.encoder.clip}})

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        """From stored state: an object, or the older form, an array of steps whose first tells the dimension."""
        try:
            data = json.loads(text)
            if isinstance(data, list):
                if not data:
                    raise ValidationError("state", "holds no steps")
                state = data[0]["state"]
                dim = (json.loads(state) if isinstance(state, str) else state).get("dim_in")
                data = {"dim": dim, "steps": data}
            out = cls(data["dim"])
            for i, entry in enumerate(data["steps"]):
                if entry["kind"] not in STEPS:
                    raise StepError(i, entry["kind"], "unknown kind")
                state = entry["state"]
                out.add(STEPS[entry["kind"]].from_state(json.loads(state) if isinstance(state, str) else state))
            if data.get("encoder"):
                out.encode(data["encoder"]["encoding"], data["encoder"].get("clip"))
        except (KeyError, TypeError, ValueError) as e:
            raise ValidationError("state", f"cannot be read: {e}") from e
        return out

    def inspect(self) -> str:
        lines, dim = [f"input: {self.dim_in}"], self.dim_in
        for i, step in enumerate(self.steps):
            dim = step.dim_out if step.dim_out is not None else dim
            lines.append(f"{i + 1}. {step.kind} -> {dim}")
        if self.encoder:
            lines.append(f"encode: {self.encoder.encoding}")
        return "\n".join(lines)

    def dry_run(self, vector) -> list[dict]:
        """Output and milliseconds of each step on one vector, on the driver."""
        x, out = np.asarray(vector, dtype=np.float64)[None], []
        for i, step in enumerate(self.steps):
            began = time.perf_counter()
            try:
                x = step.apply(x)
            except (VectorError, ValueError) as e:
                raise StepError(i, step.kind, str(e)) from e
            out.append({"step": step.kind, "output": x[0].tolist(), "ms": (time.perf_counter() - began) * 1000})
        return out


class _Timed(B.Step):
    """A step that adds its milliseconds and calls to accumulators."""

    def __init__(self, step: B.Step, milliseconds, calls):
        self.step, self.kind, self.dim_in, self.dim_out = step, step.kind, step.dim_in, step.dim_out
        self.milliseconds, self.calls = milliseconds, calls

    def apply(self, x: np.ndarray) -> np.ndarray:
        began = time.perf_counter()
        out = self.step.apply(x)
        self.milliseconds.add((time.perf_counter() - began) * 1000)
        self.calls.add(1)
        return out


class Metrics:
    """Runs, the rows that they produced and the time of their steps, off until enabled. Counting rides on the jobs
    themselves: rows by an observation, times by accumulators (a task that is run again counts again)."""

    def __init__(self):
        self.enabled, self.observed, self.steps = False, [], {}

    def enable(self) -> None:
        self.enabled = True

    def timed(self, spark, steps: list[B.Step]) -> list[B.Step]:
        for s in steps:
            if s.kind not in self.steps:
                self.steps[s.kind] = spark.sparkContext.accumulator(0.0), spark.sparkContext.accumulator(0)
        return [_Timed(s, *self.steps[s.kind]) for s in steps]

    def watch(self, df: DataFrame) -> DataFrame:
        if not self.enabled or df.isStreaming:
            return df
        seen = Observation()
        self.observed.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias("vectors"))

    def get(self) -> dict:
        """Runs, vectors, and by kind of step the blocks and mean milliseconds of one; blocks until the watched jobs have
        run."""
        vectors = sum(o.get["vectors"] for o in self.observed)
        return {"runs": len(self.observed), "vectors": vectors, "steps": {k: {"blocks": n.value, "mean_ms": ms.value / max(1, n.value)} for k, (ms, n) in self.steps.items()}}

    def reset(self) -> None:
        self.observed, self.steps = [], {}


class Tracer:
    """Wall-clock times of named operations; a failing one counts as a call. ``span`` may wrap each call (for an
    external tracing system)."""

    def __init__(self, span: Callable | None = None):
        self.span, self.times = span, {}

    def trace(self, name: str, function: Callable, **attributes):
        began = time.perf_counter()
        try:
            return self.span(name, attributes, function) if self.span else function()
        finally:
            self.times.setdefault(name, []).append((time.perf_counter() - began) * 1000)

    def get(self) -> dict:
        return {name: {"count": len(t), "avg_ms": sum(t) / len(t), "min_ms": min(t), "max_ms": max(t)} for name, t in self.times.items()}
