"""Vector-database formats, evaluation files, and query-side warping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.errors import ValidationError, positive_int
from vectorloom.functions import vectors as V
from vectorloom.operators.blocks import Step, map_vectors


def pgvector(v: Column) -> Column:
    """``[a, b, ...]``; components must be finite."""
    return F.concat(F.lit("["), F.array_join(F.transform(V.assert_finite(v, "pgvector"), lambda x: x.cast("string")), ", "), F.lit("]"))


def pgvector_bits(packed: Column) -> Column:
    """Packed bytes as a bit string, eight characters a byte."""
    return F.array_join(F.transform(packed, lambda b: F.lpad(F.bin(b.cast("long")), 8, "0")), "")


def pinecone_query(v: Column, k: int = 10, filter_json: Column | None = None) -> Column:
    """JSON of {vector, topK, filter?}."""
    fields = [V.assert_finite(v, "pinecone").alias("vector"), F.lit(positive_int(k, "k")).alias("topK")]
    if filter_json is not None:
        fields.append(F.parse_json(filter_json).alias("filter"))
    return F.to_json(F.struct(*fields))


def vectorize_query(v: Column, k: int = 10, return_values: bool = False, return_metadata: str = "none", filter_json: Column | None = None) -> Column:
    fields = [V.assert_finite(v, "vectorize").alias("vector"), F.lit(positive_int(k, "k")).alias("topK"), F.lit(return_values).alias("returnValues"), F.lit(return_metadata).alias("returnMetadata")]
    if filter_json is not None:
        fields.append(F.parse_json(filter_json).alias("filter"))
    return F.to_json(F.struct(*fields))


def vectorize_record(id_: Column, v: Column, metadata: Column | None = None) -> Column:
    fields = [id_.cast("string").alias("id"), V.assert_finite(v, "vectorize").alias("values")]
    if metadata is not None:
        fields.append(metadata.alias("metadata"))
    return F.to_json(F.struct(*fields))


def redis_blob(v: Column, kind: str = "float") -> Column:
    """Little-endian bytes: single precision, or one byte a component for int8 and packed vectors.

    Bits of a float come from its exponent and fraction, since Spark SQL has no cast from float to bytes.
    """
    if kind in ("int8", "binary"):
        return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(255))), 2, "0")), ""))
    if kind != "float":
        raise ValidationError("kind", f"unknown: {kind}")
    return F.unhex(F.array_join(F.transform(V.assert_finite(v, "redis"), _float_hex), ""))


def _float_hex(x: Column) -> Column:
    """Eight hex digits of a value as a little-endian single."""
    single = x.cast("float").cast("double")
    size = F.abs(single)
    power = F.greatest(F.lit(-126), F.floor(F.log2(F.when(size == 0, F.lit(1.0)).otherwise(size))).cast("int"))
    # log2 may round up across a power of two
    power = F.when(F.pow(F.lit(2.0), power) > size, F.greatest(F.lit(-126), power - 1)).when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power)
    fraction = size / F.pow(F.lit(2.0), power)
    normal = fraction >= 1
    mantissa = F.round(F.when(normal, fraction - 1).otherwise(fraction) * 8388608).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise(F.when(normal, (power + 127).cast("long") * 8388608).otherwise(F.lit(0).cast("long")) + mantissa)
    negative = (single < 0) | single.cast("string").startswith("-")
    code = F.lpad(F.hex(bits + F.when(negative, F.lit(2147483648)).otherwise(F.lit(0).cast("long"))), 8, "0")
    return F.concat(F.substring(code, 7, 2), F.substring(code, 5, 2), F.substring(code, 3, 2), F.substring(code, 1, 2))


#: Row formats by name; ``register_format`` adds to them.
FORMATS = {"pgvector": lambda v, **_: pgvector(v), "pinecone": lambda v, k=10, filter_json=None, **_: pinecone_query(v, k, filter_json), "redis": lambda v, **_: redis_blob(v), "vectorize": lambda v, k=10, filter_json=None, **_: vectorize_query(v, k, filter_json=filter_json)}


def register_format(name: str, build) -> None:
    FORMATS[name] = build


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) from .json (an array or lines), .jsonl or .csv (vector as a JSON array in a quoted cell) with the fields
    id and vector."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id string, vector string").csv(path)
        return rows.select("id", F.from_json("vector", "array<double>").alias("v"))
    rows = spark.read.option("multiLine", path.endswith(".json")).schema("id string, vector array<double>").json(path)
    return rows.select("id", F.col("vector").alias("v"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(q, v, expected) from the same formats with the fields queryVector and expectedDocIds (in csv: expectedIds,
    separated by semicolons). q is the position for files of one partition, else a unique number."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("queryVector string, expectedIds string").csv(path)
        rows = rows.select(F.from_json("queryVector", "array<double>").alias("v"), F.split("expectedIds", ";").alias("expected"))
    else:
        rows = spark.read.option("multiLine", path.endswith(".json")).schema("queryVector array<double>, expectedDocIds array<string>").json(path)
        rows = rows.select(F.col("queryVector").alias("v"), F.col("expectedDocIds").alias("expected"))
    return rows.withColumn("expected", F.transform("expected", F.trim)).withColumn("q", F.monotonically_increasing_id()).select("q", "v", "expected")


class WarpedEmbeddings:
    """An embedding provider's two sides: documents pass, queries are transformed."""

    def __init__(self, steps: list[Step]):
        if not steps:
            raise ValidationError("steps", "an intent is needed")
        self.steps = steps

    def embed_documents(self, df: DataFrame, column: str = "v") -> DataFrame:
        return df

    def embed_query(self, df: DataFrame, column: str = "v") -> DataFrame:
        return map_vectors(df, self.steps, column, column)


VECTOR = T.ArrayType(T.DoubleType())
