import math

import pytest
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def ints(kind, *xs):
    return F.array(*(F.lit(x).cast(kind) for x in xs))


def near(got, want, tol=1e-5):
    assert got == pytest.approx(list(want) if isinstance(want, (list, tuple)) else want, abs=tol)


def test_normalize(spark):
    near(one(spark, V.normalize(vec(3, 4))), [0.6, 0.8])
    near(one(spark, V.normalize(vec(0, 0, 0))), [0, 0, 0])


def test_slerp(spark):
    c = math.cos(math.pi / 4)
    near(one(spark, V.slerp(vec(1, 0, 0), vec(0, 1, 0), 0.5)), [c, c, 0])
    near(one(spark, V.slerp(vec(1, 0), vec(3, 0), 0.5)), [2, 0])
    near(one(spark, V.slerp(vec(1, 0), vec(-1, 0), 0.25)), [0.5, 0])
    with pytest.raises(Exception, match="zero vector"):
        one(spark, V.slerp(vec(0, 0), vec(1, 0), 0.5))


def test_products(spark):
    assert one(spark, V.inner_product(vec(1, 0, 0), vec(2, 0, 0))) == 2
    assert one(spark, V.cosine_similarity(vec(1, 0, 0), vec(2, 0, 0))) == 1
    assert one(spark, V.cosine_similarity(vec(0, 0), vec(2, 0))) == 0
    near(one(spark, V.reject(vec(1, 1, 0), vec(1, 0, 0))), [0, 1, 0])
    near(one(spark, V.reject(vec(1, 1), vec(0, 0))), [1, 1])
    near(one(spark, V.add_scaled(vec(1, 1), vec(2, 3), 0.5)), [2, 2.5])
    with pytest.raises(Exception, match="dimension"):
        one(spark, V.inner_product(vec(1), vec(1, 2)))


def test_integer_scores(spark):
    assert one(spark, V.hamming(ints("smallint", 165), ints("smallint", 240))) == 4
    assert one(spark, V.int8_dot(ints("tinyint", 10, -5, 2), ints("tinyint", 3, 4, -1))) == 8
    assert one(spark, V.int8_dot(ints("tinyint", 127), ints("tinyint", 127), F.lit(2.0), F.lit(0.5))) == pytest.approx(1.0)
    assert one(spark, V.int8_cosine(ints("tinyint", 0, 0), ints("tinyint", 1, 2))) == 0
    assert one(spark, V.vector_score(ints("smallint", 165), ints("smallint", 240), "binary")) == 0


def test_activations_and_softmax(spark):
    assert one(spark, V.activate(vec(-1, 0, 1), "relu")) == [0, 0, 1]
    assert one(spark, V.activate(vec(0), "sigmoid")) == [0.5]
    assert one(spark, V.activate(vec(400), "tanh")) == [1.0]
    near(one(spark, V.softmax(vec(1, 2, 3))), [0.09003057, 0.24472847, 0.66524096])
    assert one(spark, V.softmax(F.array().cast("array<double>"))) in ([], None)
    with pytest.raises(ValueError):
        V.activate(vec(1), "cube")


def test_affine(spark):
    m = F.array(vec(0.5, -0.2, 0.1), vec(0.1, 0.8, -0.3), vec(-0.4, 0.5, 0.9))
    near(one(spark, V.affine(m, vec(1, 2, 3), vec(0.1, 0.2, -0.1))), [0.5, 1, 3.2])


def test_encoders(spark):
    assert one(spark, V.quantize_int8(vec(1, -1, 0.5, -0.1))) == [127, -127, 64, -13]
    assert one(spark, V.quantize_int8(vec(2, -3))) == [127, -128]
    assert one(spark, V.quantize_int8(vec(-0.5))) == [-63]  # halves go upward
    assert one(spark, V.quantize_binary(vec(1, -1, 0.5, -0.1, 0, 2, -3, 0.1))) == [165]
    with pytest.raises(Exception, match="8 divides"):
        one(spark, V.quantize_binary(vec(*range(10))))
    assert one(spark, V.quantize_int8(V.scale_down(vec(0.1, 2, -3), 1.0))) == [4, 85, -127]
    got = one(spark, V.quantize_int8_dynamic(vec(0.5, -2)))
    assert (got.q, got.scale) == ([32, -127], 2.0)
    assert one(spark, V.decode_binary(ints("smallint", 165))) == [1, -1, 1, -1, -1, 1, -1, 1]
    with pytest.raises(Exception, match="finite"):
        one(spark, V.scale_down(vec(float("nan")), 1.0))


def test_symbolic_algebra(spark):
    assert one(spark, V.bind(vec(2, 3, 4), vec(0.5, 2, 0), unit=False)) == [1, 6, 0]
    near(one(spark, V.unbind(vec(1, 1, 1), vec(0, 1, 0), unit=False)), [1e5, 1, 1e5])
    near(one(spark, V.unbind(vec(1, 1, 1), vec(-0.0, 1, -1e-6), unit=False)), [-1e5, 1, -1e5])
    assert one(spark, V.bind_bytes(ints("smallint", 170, 255, 0), ints("smallint", 204, 15, 240))) == [102, 240, 240]


def test_formats(spark):
    assert one(spark, formats.pgvector(vec(0.1, 0.2, 0.3))) == "[0.1, 0.2, 0.3]"
    assert one(spark, formats.pgvector_bits(ints("smallint", 165, 1))) == "1010010100000001"
    assert one(spark, formats.pinecone_query(vec(0.1, 0.2), 5)) == '{"vector":[0.1,0.2],"topK":5}'
    import struct

    values = [1.0, -2.5, 0.1, 0.0, -0.0, 3.4e38, 1e-40, 0.9999999, 2.0000002, 123456.789, -1e-30]
    assert bytes(one(spark, formats.redis_blob(vec(*values)))) == struct.pack(f"<{len(values)}f", *values)
    assert bytes(one(spark, formats.redis_blob(ints("tinyint", -1, 127), "int8"))) == b"\xff\x7f"
    with pytest.raises(Exception, match="finite"):
        one(spark, formats.pgvector(vec(float("inf"))))
