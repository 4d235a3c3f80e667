"""Vector functions as column expressions over ``array<double>``; no Python runs on the executors.

A scalar that depends on the row (a norm, a coefficient) is bound once with ``let``: written into a lambda directly it
would be evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def same_dim(a: Column, b: Column, value: Column) -> Column:
    """``value`` where the arrays have equal length, else an error."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def inner_product(a: Column, b: Column) -> Column:
    return same_dim(a, b, dot(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))


def add_scaled(target: Column, source: Column, scale: Column | float = 1.0) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return let(s, lambda c: F.zip_with(target, source, lambda x, y: x + c * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return same_dim(a, b, let(scale, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)))


def slerp(a: Column, b: Column, t: float) -> Column:
    """Spherical interpolation of direction with linear interpolation of length. (Anti)parallel vectors are
    interpolated linearly; zero vectors raise."""
    na, nb = norm(a), norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb)))
    parts = F.struct(na.alias("na"), nb.alias("nb"), F.when((na == 0) | (nb == 0), F.raise_error(F.lit("slerp of a zero vector")).cast("double")).otherwise(cosine).alias("c"))

    def blend(p: Column) -> Column:
        angle = F.acos(p["c"])
        weights = F.struct(F.sin(angle).alias("s"), (F.try_divide(F.sin((1 - t) * angle), F.sin(angle)) / p["na"]).alias("wa"), (F.try_divide(F.sin(t * angle), F.sin(angle)) / p["nb"]).alias("wb"), (p["na"] + t * (p["nb"] - p["na"])).alias("m"))
        return let(weights, lambda w: F.zip_with(a, b, lambda x, y: F.when(w["s"] < 1e-6, x + t * (y - x)).otherwise((x * w["wa"] + y * w["wb"]) * w["m"])))

    return same_dim(a, b, let(parts, blend))


def reject(base: Column, away: Column) -> Column:
    """``base`` without its component along ``away``; a zero ``away`` changes nothing."""
    square = dot(away, away)
    scale = let(square, lambda q: F.when(q == 0, F.lit(0.0)).otherwise(dot(base, away) / q))
    return same_dim(base, away, let(scale, lambda c: F.zip_with(base, away, lambda x, y: x - c * y)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two byte arrays (array<smallint>, 0 to 255)."""
    return same_dim(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x))


def int8_dot(a: Column, b: Column, scale_a: Column | None = None, scale_b: Column | None = None) -> Column:
    """Integer inner product; with scales (largest absolute value before encoding), that of the decoded vectors."""
    plain = same_dim(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))
    return plain if scale_a is None or scale_b is None else plain * (scale_a / 127) * (scale_b / 127)


def int8_cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt((int8_dot(a, a) * int8_dot(b, b)).cast("double"))
    return let(scale, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(int8_dot(a, b) / n))


def vector_score(a: Column, b: Column, encoding: str = "float") -> Column:
    """Similarity of two vectors of one encoding: float and int8 by cosine, binary by 1 - 2 h / bits."""
    if encoding == "float":
        return cosine_similarity(a, b)
    if encoding == "int8":
        return int8_cosine(a, b)
    if encoding == "binary":
        return 1 - 2 * hamming(a, b) / (8 * F.size(a))
    raise ValueError(f"unknown encoding {encoding}")


def assert_dimension(v: Column, dim: int, context: str = "vector") -> Column:
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.lit(f"{context}: expected dimension {dim}")))


def assert_finite(v: Column, context: str = "vector") -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"{context}: a component is not finite"))).otherwise(v)


def affine(matrix: Column, v: Column, bias: Column | None = None) -> Column:
    """Row-major matrix times vector, plus bias."""
    if bias is None:
        return F.transform(matrix, lambda row: dot(row, v))
    return F.transform(matrix, lambda row, i: F.aggregate(F.zip_with(row, v, lambda x, y: x * y), F.get(bias, i), lambda s, x: s + x))


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
}


def activate(v: Column, name: str | None = None) -> Column:
    if not name or name == "linear":
        return v
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name}")
    return F.transform(v, ACTIVATIONS[name])


def softmax(v: Column) -> Column:
    """Shifted by the maximum; empty stays empty."""
    raised = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


# encoders


def quantize_int8(v: Column) -> Column:
    """round(127 x) to [-128, 127], halves upward."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.floor(x * 127.0 + 0.5).cast("double"))).cast("tinyint"))


def max_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def quantize_int8_dynamic(v: Column) -> Column:
    """struct(q, scale): scaled so that the largest absolute value, at least 1e-8, becomes 127; scale keeps it."""
    top = F.greatest(max_abs(v), F.lit(1e-8))
    return let(top, lambda m: F.struct(F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.floor(x * (127.0 / m) + 0.5).cast("double"))).cast("tinyint")).alias("q"), m.alias("scale")))


def quantize_binary(v: Column) -> Column:
    """Signs (x > 0) packed into bytes, lowest index in the highest bit; the dimension must be a multiple of 8."""
    packed = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 8).cast("int") - 1), lambda k: F.aggregate(F.slice(v, (k * 8 + 1).cast("int"), F.lit(8)), F.lit(0), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)).cast("smallint"))
    return F.when(F.size(v) % 8 != 0, F.raise_error(F.lit("binary encoding needs a dimension that 8 divides"))).otherwise(packed)


def scale_down(v: Column, limit: float) -> Column:
    """Uniformly scaled so that no absolute value exceeds ``limit``; non-finite components raise."""
    return let(max_abs(assert_finite(v)), lambda m: F.when(m > limit, F.transform(v, lambda x: x * (F.lit(float(limit)) / m))).otherwise(v))


def decode_int8(q: Column, scale: Column | None = None) -> Column:
    if scale is None:
        return F.transform(q, lambda x: x.cast("double") / 127)
    return let(scale, lambda s: F.transform(q, lambda x: x.cast("double") / 127 * s))


def decode_binary(packed: Column) -> Column:
    """+1 and -1 by bit."""
    return F.flatten(F.transform(packed, lambda b: F.transform(F.array(*(F.lit(k) for k in range(7, -1, -1))), lambda k: F.when(F.getbit(b.cast("int"), k) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)))))


# vector-symbolic algebra


def bind(a: Column, b: Column, unit: bool = True) -> Column:
    out = same_dim(a, b, F.zip_with(a, b, lambda x, y: x * y))
    return normalize(out) if unit else out


def unbind(bound: Column, key: Column, unit: bool = True) -> Column:
    """Element-wise division; keys closer to zero than 1e-5 count as 1e-5 with their sign, that of -0.0 included."""
    safe = F.transform(key, lambda k: F.when(F.abs(k) >= 1e-5, k).when((k < 0) | k.cast("string").startswith("-"), F.lit(-1e-5)).otherwise(F.lit(1e-5)))
    out = same_dim(bound, key, F.zip_with(bound, safe, lambda x, y: x / y))
    return normalize(out) if unit else out


def bind_bytes(a: Column, b: Column) -> Column:
    """XOR of byte arrays; its own inverse."""
    return same_dim(a, b, F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y).cast("smallint")))
