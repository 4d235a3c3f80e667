"""Dense vector steps in Arrow blocks.

A step maps a block (rows x dimension, float64) to another with BLAS; all steps of a pipeline run in one pass over the
data. Weights travel with the function: their size is that of a model and does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectorloom.errors import DimensionError, ValidationError, positive, positive_int


def _matrix(value, rows: int | None = None, cols: int | None = None) -> np.ndarray:
    out = np.asarray(value, dtype=np.float64)
    if out.ndim == 1 and rows and cols:
        out = out.reshape(rows, cols)
    if out.ndim != 2 or rows and out.shape[0] != rows or cols and out.shape[1] != cols:
        raise ValidationError("matrix", f"shape {out.shape} does not suit")
    if not np.isfinite(out).all():
        raise ValidationError("matrix", "has components that are not finite")
    return out


def activate(x: np.ndarray, name: str | None) -> np.ndarray:
    if not name or name == "linear":
        return x
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-x))
    if name == "tanh":
        return np.tanh(x)
    raise ValidationError("activation", f"unknown: {name}")


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n != 0)


class Step:
    """One transformation. ``apply`` gets a block of the dimension ``dim_in`` (None: any)."""

    kind = "step"
    dim_in: int | None = None
    dim_out: int | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def state(self) -> dict:
        """JSON-safe state, enough to build the step again with ``from_state``."""
        out = {}
        for key, value in vars(self).items():
            out[key] = _plain(value)
        return out

    @classmethod
    def from_state(cls, state: dict) -> Step:
        step = cls.__new__(cls)
        for key, value in state.items():
            setattr(step, key, _rich(value))
        return step


def _plain(value):
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, dict):
        return {"dict": [[k, _plain(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {"list": [_plain(v) for v in value]}
    return value


def _rich(value):
    if isinstance(value, dict):
        if "array" in value:
            return np.asarray(value["array"], dtype=np.float64)
        if "dict" in value:
            return {k: _rich(v) for k, v in value["dict"]}
        return [_rich(v) for v in value["list"]]
    return value


@dataclass
class Weights:
    """An affine map with an optional routing vector."""

    matrix: np.ndarray
    bias: np.ndarray
    routing: np.ndarray | None = None

    def __post_init__(self):
        self.matrix = _matrix(self.matrix)
        self.bias = np.zeros(len(self.matrix)) if self.bias is None else np.asarray(self.bias, dtype=np.float64)
        if self.bias.shape != (len(self.matrix),):
            raise DimensionError(len(self.matrix), len(self.bias), "bias")
        if self.routing is not None:
            self.routing = np.asarray(self.routing, dtype=np.float64)


class Intents(Step):
    """Named square affine maps. ``mode`` is one intent's name, a dict of blend weights (not normalised) or ``auto``:
    softmax of the cosines with the routing vectors. Blending is linear, so weights are blended before they meet the data."""

    kind = "intent"

    def __init__(self, intents: dict[str, Weights], mode="default", activation: str | None = None):
        if not intents:
            raise ValidationError("intents", "at least one is needed")
        self.names = list(intents)
        self.matrices = [w.matrix for w in intents.values()]
        self.biases = [w.bias for w in intents.values()]
        self.routings = [None if w.routing is None else w.routing for w in intents.values()]
        dims = {m.shape for m in self.matrices}
        if len(dims) > 1 or self.matrices[0].shape[0] != self.matrices[0].shape[1]:
            raise ValidationError("intents", "maps must be square and of one dimension")
        self.mode, self.activation = mode, activation
        self.dim_in = self.dim_out = self.matrices[0].shape[0]
        self.check()

    def check(self) -> None:
        wanted = self.mode if isinstance(self.mode, dict) else {} if self.mode == "auto" else {self.mode: 1.0}
        for name in wanted:
            if name not in self.names:
                raise ValidationError("intent", f"unknown: {name}")
        if self.mode == "auto" and all(r is None for r in self.routings):
            raise ValidationError("intent", "no intent has a routing vector")

    def with_mode(self, mode, activation: str | None = None) -> Intents:
        out = Intents.from_state(self.state())
        out.mode, out.activation = mode, activation or self.activation
        out.check()
        return out

    def add(self, name: str, weights: Weights) -> Intents:
        """A copy with one more intent; an intent of that name is replaced as a whole."""
        have = {n: Weights(m, b, r) for n, m, b, r in zip(self.names, self.matrices, self.biases, self.routings, strict=True)}
        return Intents(have | {name: weights}, self.mode, self.activation)

    def remove(self, name: str) -> Intents:
        have = {n: Weights(m, b, r) for n, m, b, r in zip(self.names, self.matrices, self.biases, self.routings, strict=True) if n != name}
        return Intents(have, self.mode, self.activation)

    def routing(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Indices of the routed intents, and their weights for each row."""
        at = [i for i, r in enumerate(self.routings) if r is not None]
        score = unit_rows(x) @ unit_rows(np.stack([self.routings[i] for i in at])).T
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return at, score / score.sum(axis=1, keepdims=True)

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.mode == "auto":
            at, share = self.routing(x)
            out = np.zeros_like(x)
            for k, i in enumerate(at):
                out += share[:, k : k + 1] * (x @ self.matrices[i].T + self.biases[i])
        else:
            weights = self.mode if isinstance(self.mode, dict) else {self.mode: 1.0}
            matrix = sum(w * self.matrices[self.names.index(n)] for n, w in weights.items())
            bias = sum(w * self.biases[self.names.index(n)] for n, w in weights.items())
            out = x @ matrix.T + bias
        return activate(out, self.activation)


class LowRank(Step):
    """y = A (B x) + b + x, by named factors."""

    kind = "lora"

    def __init__(self, factors: dict[str, tuple], name: str = "default", activation: str | None = None):
        if name not in factors:
            raise ValidationError("intent", f"unknown: {name}")
        self.factors = {n: [_matrix(a), _matrix(b), np.asarray(c, dtype=np.float64)] for n, (a, b, c) in factors.items()}
        self.name, self.activation = name, activation
        a, b, c = self.factors[name]
        if a.shape[1] != b.shape[0] or a.shape[0] != b.shape[1] or len(c) != a.shape[0]:
            raise ValidationError("factors", "shapes do not agree")
        self.dim_in = self.dim_out = b.shape[1]

    def apply(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.factors[self.name]
        return activate((x @ b.T) @ a.T + c + x, self.activation)


class Projection(Step):
    """y = W x (+ b), rectangular, by version."""

    kind = "projection"

    def __init__(self, versions: dict[str, Weights], version: str = "default"):
        if version not in versions:
            raise ValidationError("version", f"unknown: {version}")
        self.versions = {n: [w.matrix, w.bias] for n, w in versions.items()}
        self.version = version
        self.dim_out, self.dim_in = self.versions[version][0].shape

    def apply(self, x: np.ndarray) -> np.ndarray:
        matrix, bias = self.versions[self.version]
        return x @ matrix.T + bias


class Alignment(Projection):
    """A projection between the spaces of two models; the version names the target space."""

    kind = "alignment"


class Mlp(Step):
    """Dense layers (matrix, bias, activation) in order."""

    kind = "mlp"

    def __init__(self, layers: list[tuple]):
        if not layers:
            raise ValidationError("layers", "at least one is needed")
        self.layers = [[_matrix(w), np.asarray(b, dtype=np.float64), act] for w, b, act in layers]
        for (w, b, _), following in zip(self.layers, [*self.layers[1:], None], strict=True):
            if len(b) != w.shape[0]:
                raise DimensionError(w.shape[0], len(b), "bias")
            if following and following[0].shape[1] != w.shape[0]:
                raise DimensionError(w.shape[0], following[0].shape[1], "layer")
        self.dim_in, self.dim_out = self.layers[0][0].shape[1], self.layers[-1][0].shape[0]

    def with_layer(self, index: int, layer: tuple) -> Mlp:
        layers = [tuple(x) for x in self.layers]
        layers[index] = layer
        return Mlp(layers)

    def apply(self, x: np.ndarray) -> np.ndarray:
        for w, b, act in self.layers:
            x = activate(x @ w.T + b, act)
        return x


class Experts(Step):
    """Top-1 mixture: the expert whose centroid has the largest cosine, the first of equals; without centroids the
    first expert; or the index that ``router`` (rows -> indices) gives."""

    kind = "experts"

    def __init__(self, experts: list[tuple[str, Weights]], centroids: list | None = None, router=None):
        if not experts:
            raise ValidationError("experts", "at least one is needed")
        self.names = [n for n, _ in experts]
        self.matrices, self.biases = [w.matrix for _, w in experts], [w.bias for _, w in experts]
        self.centroids = None if centroids is None else np.asarray(centroids, dtype=np.float64)
        self.router = router
        self.dim_out, self.dim_in = self.matrices[0].shape

    def route(self, x: np.ndarray) -> np.ndarray:
        if self.router is not None:
            return np.asarray(self.router(x))
        if self.centroids is None:
            return np.zeros(len(x), dtype=int)
        return np.round(unit_rows(x) @ unit_rows(self.centroids).T, 9).argmax(axis=1)

    def apply(self, x: np.ndarray) -> np.ndarray:
        chosen = self.route(x)
        out = np.empty((len(x), self.dim_out))
        for i in np.unique(chosen):
            rows = chosen == i
            out[rows] = x[rows] @ self.matrices[i].T + self.biases[i]
        return out


class Whitening(Step):
    """Subtract the mean, then remove each component in turn."""

    kind = "whitening"

    def __init__(self, mean, components):
        self.mean, self.components = np.asarray(mean, dtype=np.float64), np.asarray(components, dtype=np.float64)
        self.dim_in = self.dim_out = len(self.mean)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        for w in self.components:
            x = x - np.outer(x @ w, w)
        return x


class SoftWhitening(Step):
    """Subtract the mean, damp each component by 1 - exp(-tau eigenvalue), then normalise unless tiny."""

    kind = "soft_whitening"

    def __init__(self, mean, components, eigenvalues, tau: float = 1.0, unit: bool = True):
        self.mean, self.components = np.asarray(mean, dtype=np.float64), np.asarray(components, dtype=np.float64)
        self.eigenvalues, self.tau, self.unit = np.asarray(eigenvalues, dtype=np.float64), tau, unit
        self.dim_in = self.dim_out = len(self.mean)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        for w, value in zip(self.components, self.eigenvalues, strict=True):
            x = x - np.outer((1 - np.exp(-self.tau * value)) * (x @ w), w)
        if self.unit:
            square = (x * x).sum(axis=1, keepdims=True)
            x = np.where(square > 1e-12, x / np.sqrt(np.maximum(square, 1e-300)), x)
        return x


class AnomalyGuard(Step):
    """``strict`` raises on components that are not finite or larger than ``limit``; ``safe`` scales such rows down and
    raises on components that are not finite."""

    kind = "anomaly"

    def __init__(self, limit: float = 100.0, mode: str = "strict"):
        self.limit, self.mode = positive(limit, "limit"), mode
        if mode not in ("strict", "safe"):
            raise ValidationError("mode", "strict or safe")

    def apply(self, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(x).all():
            raise ValidationError("vector", "a component is not finite")
        top = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        if self.mode == "strict":
            if (top > self.limit).any():
                raise ValidationError("vector", f"a component exceeds {self.limit}")
            return x
        return np.where(top > self.limit, x * (self.limit / np.maximum(top, 1e-300)), x)


class Normalize(Step):
    kind = "normalize"

    def apply(self, x: np.ndarray) -> np.ndarray:
        return unit_rows(x)


class RankOne(Step):
    """I + s u u^T with bias: x + s u (u . x) + b."""

    kind = "rank_one"

    def __init__(self, direction, strength: float = 0.5, bias=None):
        self.direction, self.strength = np.asarray(direction, dtype=np.float64), float(strength)
        self.bias = np.zeros(len(self.direction)) if bias is None else np.asarray(bias, dtype=np.float64)
        self.dim_in = self.dim_out = len(self.direction)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x + self.strength * np.outer(x @ self.direction, self.direction) + self.bias

    def weights(self) -> Weights:
        n = len(self.direction)
        return Weights(np.eye(n) + self.strength * np.outer(self.direction, self.direction), self.bias)


def _rounded(x: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """127 x (over a scale for each row) to int8, halves upward; a few rows at a time, so that they stay in the cache."""
    out = np.empty(x.shape, dtype=np.int8)
    step = max(1, 32_768 // max(1, x.shape[1]))
    buffer = np.empty((step, x.shape[1]))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        b = buffer[: len(part)]
        np.multiply(part, 127.0 if scale is None else 127.0 / scale[lo : lo + step], out=b, dtype=np.float64)
        b += 0.5
        np.floor(b, out=b)
        np.clip(b, -128, 127, out=b)
        out[lo : lo + step] = b
    return out


def _int8(x: np.ndarray) -> pa.Array:
    return _lists(_rounded(x), pa.int8())


def _int8_dynamic(x: np.ndarray) -> pa.Array:
    top = np.maximum(x.max(axis=1, keepdims=True, initial=0.0), -x.min(axis=1, keepdims=True, initial=0.0)).astype(np.float64)
    scale = np.maximum(top, 1e-8)
    return pa.StructArray.from_arrays([_lists(_rounded(x, scale), pa.int8()), pa.array(scale[:, 0])], names=["q", "scale"])


def _binary(x: np.ndarray) -> pa.Array:
    if x.shape[1] % 8:
        raise ValidationError("dim", "binary encoding needs a dimension that 8 divides")
    return _lists(np.packbits(x > 0, axis=1).astype(np.int16), pa.int16())


#: Final stages by name: the SQL type of the result and a function of a block; ``register_encoding`` adds to them.
ENCODINGS = {"int8": ("array<tinyint>", _int8), "int8_dynamic": ("struct<q:array<tinyint>,scale:double>", _int8_dynamic), "binary": ("array<smallint>", _binary)}


def register_encoding(name: str, sql_type: str, arrays) -> None:
    """Make a final stage known: ``arrays`` turns a block (rows x dimension) into an Arrow array of ``sql_type``."""
    ENCODINGS[name] = (sql_type, arrays)


@dataclass
class Encoder:
    """Final stage: one of ``ENCODINGS``; ``clip`` first scales rows whose largest value exceeds it."""

    encoding: str
    clip: float | None = None
    kind: str = field(default="encoder", init=False)

    def __post_init__(self):
        if self.encoding not in ENCODINGS:
            raise ValidationError("encoding", f"unknown: {self.encoding}")
        self.sql_type, self._arrays = ENCODINGS[self.encoding]  # bound here, so that it travels to the executors
        if self.clip is not None:
            positive(self.clip, "clip")

    def arrays(self, x: np.ndarray) -> pa.Array:
        return self._arrays(x if self.clip is None else AnomalyGuard(self.clip, "safe").apply(x))


def _lists(x: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:  # noqa: B008
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d) if d else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1), kind))


def block_of(column: pa.Array, dim: int | None) -> np.ndarray:
    """Rows of a list column without nulls as a float64 matrix; lengths must agree."""
    if len(column) == 0:
        return np.empty((0, dim or 0))
    lengths = np.diff(column.offsets.to_numpy()) if not isinstance(column, pa.FixedSizeListArray) else np.full(len(column), column.type.list_size)
    if (lengths != (dim if dim is not None else lengths[0])).any():
        raise DimensionError(dim if dim is not None else int(lengths[0]), int(lengths[lengths != (dim if dim is not None else lengths[0])][0]), "vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(lengths[0]))


def block_of_bytes(column: pa.Array, dtype: str, dim: int | None) -> np.ndarray:
    """Rows of a binary column without nulls, each a packed vector, as a matrix of its type; lengths must agree."""
    if len(column) == 0:
        return np.empty((0, dim or 0))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    width = (dim or int(offsets[1] - offsets[0]) // size) * size
    lengths = np.diff(offsets)
    if (lengths != width).any():
        raise DimensionError(width // size, int(lengths[lengths != width][0]) // size, "vector")
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if width else np.empty(0, dtype=np.uint8)
    return flat.view(dtype).reshape(len(column), -1)


def packed_rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(x) + 1, dtype=np.int32)), pa.py_buffer(x)])


def map_vectors(df: DataFrame, steps: list[Step], column: str = "v", output: str = "v", encoder: Encoder | None = None, single: bool = False, packed: str | None = None) -> DataFrame:
    """``df`` with ``output`` set to the steps' result on ``column``; other columns pass. A null vector stays null.

    ``single`` rounds to single precision between steps. ``packed`` (``<f4`` or ``<f8``): vectors are binary columns of
    that type, in and out, and encoders give packed bytes; such columns cross to Python as they are, where an array's
    elements are copied one by one.
    """
    if not steps and encoder is None:
        return df if output == column else df.withColumn(output, df[column])
    dim = next((s.dim_in for s in steps if s.dim_in is not None), None) if steps and steps[0].dim_in is not None else None
    kind = encoder.sql_type if encoder else "array<double>"
    if packed:
        kind = re.sub(r"array<\w+>", "binary", kind)
    kept = [f for f in df.schema.fields if f.name != output]
    schema = T.StructType([*kept, T.StructField(output, T._parse_datatype_string(kind), True)])
    names = [f.name for f in kept]

    def pack(column: pa.Array) -> pa.Array:
        if pa.types.is_struct(column.type):
            return pa.StructArray.from_arrays([pack(column.field(i)) if pa.types.is_list(f.type) else column.field(i) for i, f in enumerate(column.type)], names=[f.name for f in column.type])
        flat = column.flatten().to_numpy(zero_copy_only=False)
        flat = flat.astype(np.uint8) if flat.dtype == np.int16 else flat  # bits
        return packed_rows(flat.reshape(len(column), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(column))
            valid = np.flatnonzero(~source.is_null().to_numpy(zero_copy_only=False)) if source.null_count else np.arange(len(source))
            present = source.drop_null() if len(valid) < len(source) else source
            x = block_of_bytes(present, packed, dim) if packed else block_of(present, dim)
            if len(valid):
                x = x.astype(np.float64, copy=False) if steps else x  # encoders take single precision as it is
                for step in steps:
                    x = step.apply(x)
                    if single:
                        x = x.astype(np.float32).astype(np.float64)
            if packed:
                out = pack(encoder.arrays(x)) if encoder else packed_rows(x.astype(packed))
            else:
                out = encoder.arrays(x) if encoder else _lists(x)
            if len(valid) < len(source):
                take = np.full(len(source), -1)
                take[valid] = np.arange(len(valid))
                out = out.take(pa.array(take, pa.int64(), mask=take < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), out], names=[*names, output])

    return df.mapInArrow(run, schema)


def pack_vectors(df: DataFrame, column: str = "v", dtype: str = "<f4") -> DataFrame:
    """``df`` with the array column as packed binary, once, for the packed form of later passes."""
    fields = [T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType, True) for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            own = batch.column(at)
            rows = [None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(dtype).tobytes() for v in own]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, T.StructType(fields))


def check_dims(steps: list[Step], dim: int | None) -> int | None:
    for i, step in enumerate(steps):
        if step.dim_in is not None and dim is not None and step.dim_in != dim:
            raise DimensionError(step.dim_in, dim, f"step {i} ({step.kind})")
        dim = step.dim_out if step.dim_out is not None else dim
    return dim


def positive_dim(dim: int) -> int:
    return positive_int(dim, "dim")
