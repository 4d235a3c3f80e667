"""The registered queries of the vector operators and their DuckDB SQL.

Rules on both sides: no arrays in results, doubles rounded to six digits with zero made positive, ids and counts BIGINT,
every ranking by score rounded to nine digits, then id. Query sets are the rows whose id 20 divides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import blocks as B
from vectorloom.operators import feedback as K
from vectorloom.operators import learn as J
from vectorloom.operators import metrics as M
from vectorloom.operators import rerank as R
from vectorloom.operators import search as S
from vectorloom.operators import weights as W
from vectorloom.plans.pipeline import Pipeline
from vectorloom.session import shared_folder
from vectorloom.sources import formats
from vectorloom.streaming.streams import run_stream, to_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIM = 64


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- shared pieces --------------------------------------------------------------------------------------------------

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
Q = "q AS (SELECT vec_id AS q, label AS q_label, v AS a FROM e WHERE vec_id % 20 = 0)"
CENTROIDS = "c AS (SELECT label, list(m ORDER BY p) AS u FROM (SELECT label, i AS p, CAST(sum(CAST(v[i] AS DECIMAL(20,9))) AS DOUBLE) / count(*) AS m FROM e, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"
UNIT = "CASE WHEN list_inner_product({x}, {x}) = 0 THEN {x} ELSE list_transform({x}, lambda z: z / sqrt(list_inner_product({x}, {x}))) END"


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def query_set(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "v")


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


def spread(df: DataFrame, *ids: str, column: str = "v") -> DataFrame:
    out = df.select(*ids, F.posexplode(column).alias("pos", "x"))
    return out.select(*ids, F.col("pos").cast("long").alias("pos"), r6(F.col("x").cast("double")).alias("value"))


def spread_sql(select: str, dim: int = DIM, ids: str = "vec_id") -> str:
    return f"SELECT {ids}, CAST(t.i - 1 AS BIGINT) AS pos, round(CAST(x[t.i] AS DOUBLE), 6) + 0.0 AS value FROM ({select}) s, range(1, {dim + 1}) t(i)"


def matrix(rows: int, cols: int, shift: int = 0, scale: float = 0.01) -> np.ndarray:
    i, j = np.indices((rows, cols))
    return ((i * 7 + j * 3 + shift) % 11 - 5) * scale


def vector(size: int, shift: int = 0) -> np.ndarray:
    return ((np.arange(size) + shift) % 5 - 2) * 0.1


def matrix_sql(rows: int, cols: int, shift: int = 0, scale: str = "0.01") -> str:
    return f"list_transform(range({rows}), lambda i: list_transform(range({cols}), lambda j: CAST((i * 7 + j * 3 + {shift}) % 11 - 5 AS DOUBLE) * {scale}))"


def affine_sql(m: str, v: str, shift: int = 0) -> str:
    return f"list_transform({m}, lambda row, i: list_inner_product(row, {v}) + CAST((i - 1 + {shift}) % 5 - 2 AS DOUBLE) * 0.1)"


def act_sql(x: str, name: str) -> str:
    body = {"relu": "greatest(z, 0.0)", "sigmoid": "1 / (1 + exp(-z))", "tanh": "tanh(z)"}[name]
    return f"list_transform({x}, lambda z: {body})"


def intent(shift: int) -> B.Weights:
    return B.Weights(matrix(DIM, DIM, shift), vector(DIM, shift))


def axes(k: int = 2) -> np.ndarray:
    raw = np.stack([((np.arange(DIM) * 5 + c * 3) % 7 - 3).astype(float) for c in range(k)])
    return B.unit_rows(raw)


AXES = ", ".join(f"(SELECT {UNIT.format(x='w')} FROM (SELECT list_transform(range(64), lambda i: CAST((i * 5 + {c} * 3) % 7 - 3 AS DOUBLE)) AS w)) AS w{c}" for c in range(2))


def unit_centroid(e: DataFrame, label: int = 0) -> np.ndarray:
    row = S.centroids(e.where(F.col("label") == label), "label").first()
    return B.unit_rows(np.array([row["v"]]))[0] if row else np.zeros(DIM)


# --- A: functions ---------------------------------------------------------------------------------------------------


@query(f"WITH {E} " + spread_sql(f"SELECT vec_id, {UNIT.format(x='w')} AS x FROM (SELECT vec_id, list_transform(v, lambda z: z * (1 + vec_id % 3)) AS w FROM e)"))
def normalize(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("w", F.transform("v", lambda z: z * (1 + F.col("vec_id") % 3)))
    return spread(e.select("vec_id", V.normalize(F.col("w")).alias("v")), "vec_id")


_SLERP = """SELECT vec_id, list_transform(range(1, 65), lambda i: (a[i] / na * sin(0.7 * th) / sin(th) + b[i] / nb * sin(0.3 * th) / sin(th)) * (na + 0.3 * (nb - na))) AS x
FROM (SELECT *, acos(greatest(-1.0, least(1.0, list_inner_product(a, b) / (na * nb)))) AS th FROM
(SELECT a.vec_id, a.v AS a, b.v AS b, sqrt(list_inner_product(a.v, a.v)) AS na, sqrt(list_inner_product(b.v, b.v)) AS nb FROM e a JOIN (SELECT vec_id, list_transform(v, lambda z: z * 2) AS v FROM e) b ON b.vec_id = a.vec_id + 1))"""


@query(f"WITH {E} " + spread_sql(_SLERP))
def slerp(spark, sf_dir):
    e = emb(spark, sf_dir)
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("v", lambda z: z * 2).alias("b"))
    return spread(e.join(following, "vec_id").select("vec_id", V.slerp(F.col("v"), F.col("b"), 0.3).alias("v")), "vec_id")


@query(f"WITH {E}, {Q} SELECT q, vec_id AS id, round(list_inner_product(a, v) / sqrt(list_inner_product(a, a) * 1.0) / sqrt(list_inner_product(v, v)), 6) + 0.0 AS score, round(list_inner_product(a, v), 6) + 0.0 AS product FROM q, e")
def cosine_pairs(spark, sf_dir):
    e = emb(spark, sf_dir)
    pairs = S.all_scores(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), product=True)
    return pairs.select("q", "id", r6(F.col("score")).alias("score"), r6(F.col("product")).alias("product"))


@query(f"WITH {E}, {CENTROIDS} " + spread_sql("SELECT vec_id, list_transform(range(1, 65), lambda i: v[i] - list_inner_product(v, u) / list_inner_product(u, u) * u[i]) AS x FROM e, c WHERE c.label = (e.label + 1) % 10"))
def reject(spark, sf_dir):
    e = emb(spark, sf_dir)
    c = S.centroids(e, "label").select(F.col("label").alias("other"), F.col("v").alias("u"))
    rows = e.withColumn("other", (F.col("label") + 1) % 10).join(c, "other")
    return spread(rows.select("vec_id", V.reject(F.col("v"), F.col("u")).alias("v")), "vec_id")


@query(f"WITH {E}, {Q} SELECT q, vec_id AS id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS bits, round(1 - 2 * list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END)) / 64.0, 6) + 0.0 AS score FROM q, e")
def hamming_pairs(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", V.quantize_binary(F.col("v")).alias("v"))
    pairs = S.with_queries(e, query_set(e).withColumnRenamed("v", "a"))
    return pairs.select("q", F.col("vec_id").alias("id"), V.hamming(F.col("a"), F.col("v")).cast("long").alias("bits"), r6(V.vector_score(F.col("a"), F.col("v"), "binary")).alias("score"))


_INT8 = "list_transform({v}, lambda x: CAST(greatest(-128, least(127, floor(x * 127.0 + 0.5))) AS DOUBLE))"


@query(f"WITH {E}, k AS (SELECT vec_id, {_INT8.format(v='v')} AS v FROM e), q AS (SELECT vec_id AS q, v AS a FROM k WHERE vec_id % 20 = 0) SELECT q, vec_id AS id, CAST(list_inner_product(a, v) AS BIGINT) AS product, round(list_inner_product(a, v) / sqrt(list_inner_product(a, a) * list_inner_product(v, v)), 6) + 0.0 AS score FROM q, k")
def int8_dot(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", V.quantize_int8(F.col("v")).alias("v"))
    pairs = S.all_scores(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), "int8", product=True)
    return pairs.select("q", "id", F.col("product").cast("long").alias("product"), r6(F.col("score")).alias("score"))


_ROUTE = f"s AS (SELECT vec_id, label AS expert, v, u, list_inner_product(v, u) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(u, u)) AS score FROM (SELECT vec_id, v FROM e), (SELECT label, u FROM c))"


@query(f"WITH {E}, {CENTROIDS}, {_ROUTE} SELECT vec_id, CAST(expert AS BIGINT) AS expert, round(exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w), 6) + 0.0 AS share FROM s WINDOW w AS (PARTITION BY vec_id)")
def softmax_routing(spark, sf_dir):
    e = emb(spark, sf_dir)
    c = S.centroids(e, "label").agg(F.array_sort(F.collect_list(F.struct("label", "v"))).alias("c"))
    rows = e.select("vec_id", "v").crossJoin(F.broadcast(c))
    shares = rows.select("vec_id", "c", V.softmax(F.transform("c", lambda r: V.cosine_similarity(F.col("v"), r["v"]))).alias("p"))
    out = shares.select("vec_id", F.posexplode("p").alias("k", "x"), "c")
    return out.select("vec_id", F.col("c")[F.col("k")]["label"].cast("long").alias("expert"), r6(F.col("x")).alias("share"))


@query(f"WITH {E} SELECT vec_id, act, CAST(t.i - 1 AS BIGINT) AS pos, round(CASE act WHEN 'relu' THEN greatest(v[t.i], 0) WHEN 'sigmoid' THEN 1 / (1 + exp(-v[t.i])) WHEN 'tanh' THEN tanh(v[t.i]) ELSE v[t.i] END, 6) + 0.0 AS value FROM e, range(1, 65) t(i), (VALUES ('linear'), ('relu'), ('sigmoid'), ('tanh')) a(act)")
def activations(spark, sf_dir):
    e = emb(spark, sf_dir)
    parts = e.select("vec_id", F.explode(F.array(*(F.struct(F.lit(n).alias("act"), V.activate(F.col("v"), n).alias("v")) for n in V.ACTIVATIONS))).alias("s")).select("vec_id", "s.*")
    return spread(parts, "vec_id", "act")


@query(f"WITH {E} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(sum(round(sqrt(list_inner_product(v, v)), 6)), 4) + 0.0 AS norms FROM e GROUP BY label")
def dimension_check(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("v", V.assert_finite(V.assert_dimension(F.col("v"), DIM)))
    return e.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), (F.round(F.sum(F.round(V.norm(F.col("v")), 6)), 4) + 0.0).alias("norms"))


# --- B: transforms --------------------------------------------------------------------------------------------------


@query(f"WITH {E}, m AS (SELECT {matrix_sql(64, 64)} AS w) " + spread_sql(f"SELECT vec_id, {act_sql(affine_sql('w', 'v'), 'relu')} AS x FROM e, m"))
def intent_affine(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Intents({"a": intent(0)}, "a", "relu")]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(64, 64)} AS w) " + spread_sql(f"SELECT vec_id, {affine_sql('w', 'v')} AS x FROM e, m"))
def intent_affine_expr(spark, sf_dir):
    """The same map as expressions over a one-row weights table."""
    m = spark.range(1).select(F.expr("transform(sequence(0, 63), i -> transform(sequence(0, 63), j -> ((i * 7 + j * 3) % 11 - 5) * 0.01D))").alias("w"), F.expr("transform(sequence(0, 63), i -> (i % 5 - 2) * 0.1D)").alias("b"))
    rows = emb(spark, sf_dir).crossJoin(F.broadcast(m))
    return spread(rows.select("vec_id", V.affine(F.col("w"), F.col("v"), F.col("b")).alias("v")), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(64, 64)} AS w0, {matrix_sql(64, 64, 4)} AS w1) " + spread_sql(f"SELECT vec_id, list_transform(range(1, 65), lambda i: 0.6 * a[i] + 0.3 * b[i]) AS x FROM (SELECT vec_id, {affine_sql('w0', 'v')} AS a, {affine_sql('w1', 'v', 4)} AS b FROM e, m)"))
def intent_blended(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Intents({"a": intent(0), "b": intent(4)}, {"a": 0.6, "b": 0.3})]), "vec_id")


@query(
    f"WITH {E}, {CENTROIDS}, m AS (SELECT {matrix_sql(64, 64)} AS w0, {matrix_sql(64, 64, 4)} AS w1), r AS (SELECT vec_id, v, exp(s0) / (exp(s0) + exp(s1)) AS p0, exp(s1) / (exp(s0) + exp(s1)) AS p1 FROM (SELECT vec_id, v, list_inner_product(v, c0.u) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(c0.u, c0.u)) AS s0, list_inner_product(v, c1.u) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(c1.u, c1.u)) AS s1 FROM e, c c0, c c1 WHERE c0.label = 0 AND c1.label = 1)) "
    + spread_sql(f"SELECT vec_id, {act_sql('list_transform(range(1, 65), lambda i: p0 * a[i] + p1 * b[i])', 'tanh')} AS x FROM (SELECT vec_id, p0, p1, {affine_sql('w0', 'v')} AS a, {affine_sql('w1', 'v', 4)} AS b FROM r, m)")
)
def intent_auto_blended(spark, sf_dir):
    e = emb(spark, sf_dir)
    c = {r["label"]: r["v"] for r in S.centroids(e.where("label < 2"), "label").collect()}
    a, b = intent(0), intent(4)
    a.routing, b.routing = np.array(c[0]), np.array(c[1])
    return spread(B.map_vectors(e, [B.Intents({"a": a, "b": b}, "auto", "tanh")]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(64, 4)} AS a, {matrix_sql(4, 64, 2)} AS b) " + spread_sql(f"SELECT vec_id, list_transform(range(1, 65), lambda i: y[i] + v[i]) AS x FROM (SELECT vec_id, v, {affine_sql('a', 'list_transform(b, lambda row: list_inner_product(row, v))')} AS y FROM e, m)"))
def lora_affine(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.LowRank({"a": (matrix(64, 4), matrix(4, 64, 2), vector(64))}, "a")]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(16, 64)} AS w) " + spread_sql(f"SELECT vec_id, {affine_sql('w', 'v')} AS x FROM e, m", 16))
def projection(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Projection({"default": B.Weights(matrix(16, 64), vector(16))})]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(32, 64, 5)} AS w) " + spread_sql("SELECT vec_id, list_transform(w, lambda row: list_inner_product(row, v)) AS x FROM e, m", 32))
def alignment(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Alignment({"target": B.Weights(matrix(32, 64, 5), None)}, "target")]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(32, 64, 0, '0.1')} AS w0, {matrix_sql(8, 32, 3, '0.1')} AS w1), h AS (SELECT vec_id, {act_sql(affine_sql('w0', 'v'), 'relu')} AS h, w1 FROM e, m) " + spread_sql(f"SELECT vec_id, {act_sql(affine_sql('w1', 'h', 1), 'sigmoid')} AS x FROM h", 8))
def mlp_forward(spark, sf_dir):
    layers = [(matrix(32, 64, 0, 0.1), vector(32), "relu"), (matrix(8, 32, 3, 0.1), vector(8, 1), "sigmoid")]
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Mlp(layers)]), "vec_id")


_BEST = f"{_ROUTE}, b AS (SELECT vec_id, expert, score, v, u FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, expert) = 1)"


@query(f"WITH {E}, {CENTROIDS}, {_BEST} SELECT vec_id, CAST(expert AS BIGINT) AS expert, round(score, 6) + 0.0 AS score FROM b")
def moe_route(spark, sf_dir):
    """Routing by expressions: the ten centroids are one broadcast row."""
    e = emb(spark, sf_dir)
    c = S.centroids(e, "label").agg(F.collect_list(F.struct(F.col("label"), F.col("v").alias("u"))).alias("c"))
    scored = e.select("vec_id", "v").crossJoin(F.broadcast(c)).select("vec_id", F.array_sort(F.transform("c", lambda r: F.struct((-F.round(V.cosine_similarity(F.col("v"), r["u"]), 9)).alias("k"), r["label"].alias("expert"), V.cosine_similarity(F.col("v"), r["u"]).alias("score"))))[0].alias("b"))
    return scored.select("vec_id", F.col("b.expert").cast("long").alias("expert"), r6(F.col("b.score")).alias("score"))


@query(f"WITH {E}, {CENTROIDS}, {_BEST} " + spread_sql("SELECT vec_id, list_transform(v, lambda z, i: z * (1 + expert) + CAST((i - 1 + expert) % 5 - 2 AS DOUBLE) * 0.1) AS x FROM b"))
def moe_apply(spark, sf_dir):
    e = emb(spark, sf_dir)
    c = sorted(S.centroids(e, "label").collect(), key=lambda r: r["label"])
    experts = [(str(r["label"]), B.Weights(np.eye(DIM) * (1 + r["label"]), vector(DIM, r["label"]))) for r in c]
    return spread(B.map_vectors(e, [B.Experts(experts, [r["v"] for r in c])]), "vec_id")


_WHITE = f"z0 AS (SELECT vec_id, list_transform(v, lambda x, i: x - CAST((i - 1) % 5 - 2 AS DOUBLE) * 0.1) AS z, {AXES} FROM e)"


@query(f"WITH {E}, {_WHITE}, z1 AS (SELECT *, list_transform(z, lambda x, i: x - list_inner_product(z, w0) * w0[i]) AS y FROM z0) " + spread_sql("SELECT vec_id, list_transform(y, lambda x, i: x - list_inner_product(y, w1) * w1[i]) AS x FROM z1"))
def whitening_apply(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Whitening(vector(DIM), axes())]), "vec_id")


@query(f"WITH {E}, {_WHITE}, z1 AS (SELECT *, list_transform(z, lambda x, i: x - (1 - exp(-1.0 * 0.5)) * list_inner_product(z, w0) * w0[i]) AS y FROM z0), z2 AS (SELECT vec_id, list_transform(y, lambda x, i: x - (1 - exp(-1.0 * 0.2)) * list_inner_product(y, w1) * w1[i]) AS w FROM z1) " + spread_sql(f"SELECT vec_id, {UNIT.format(x='w')} AS x FROM z2"))
def soft_whitening_apply(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.SoftWhitening(vector(DIM), axes(), [0.5, 0.2], 1.0)]), "vec_id")


_TOP = "list_max(list_transform({v}, lambda x: abs(x)))"


@query(f"WITH {E}, t AS (SELECT vec_id, v, {_TOP.format(v='v')} AS top FROM e) " + spread_sql("SELECT vec_id, list_transform(v, lambda z: CASE WHEN top > 0.25 THEN z * (0.25 / top) ELSE z END) AS x FROM t"))
def anomaly_guard(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [B.AnomalyGuard(0.25, "safe")]), "vec_id")


@query(f"WITH {E}, {CENTROIDS}, u AS (SELECT {UNIT.format(x='u')} AS u FROM c WHERE label = 0) " + spread_sql("SELECT vec_id, list_transform(range(1, 65), lambda i: v[i] + 0.5 * list_inner_product(v, u) * u[i] + 0.05 * u[i]) AS x FROM e, u"))
def rank_one_intent(spark, sf_dir):
    e = emb(spark, sf_dir)
    u = unit_centroid(e)
    return spread(B.map_vectors(e, [B.RankOne(u, 0.5, 0.05 * u)]), "vec_id")


@query(f"WITH {E}, m AS (SELECT {matrix_sql(64, 64)} AS w, {matrix_sql(16, 64, 1)} AS p) " + spread_sql("SELECT vec_id, " + _INT8.format(v=affine_sql("p", affine_sql("w", "v"), 1)) + " AS x FROM e, m", 16))
def pipeline_run(spark, sf_dir):
    """Intent, projection and int8 encoding in one pass."""
    p = Pipeline(DIM).intents({"a": intent(0)}, "a").projection({"default": B.Weights(matrix(16, 64, 1), vector(16, 1))}).encode("int8")
    return spread(p.run(emb(spark, sf_dir)), "vec_id")


# --- C: encoders ----------------------------------------------------------------------------------------------------


@query(f"WITH {E} " + spread_sql(f"SELECT vec_id, {_INT8.format(v='v')} AS x FROM e"))
def quantize_int8(spark, sf_dir):
    return spread(emb(spark, sf_dir).select("vec_id", V.quantize_int8(F.col("v")).alias("v")), "vec_id")


@query(f"WITH {E}, t AS (SELECT vec_id, v, greatest({_TOP.format(v='v')}, 1e-8) AS top FROM e) SELECT vec_id, CAST(t2.i - 1 AS BIGINT) AS pos, CAST(greatest(-128, least(127, floor(v[t2.i] * (127.0 / top) + 0.5))) AS BIGINT) AS value, round(top, 6) + 0.0 AS scale, round(greatest(-128, least(127, floor(v[t2.i] * (127.0 / top) + 0.5))) / 127.0 * top, 6) + 0.0 AS decoded FROM t, range(1, 65) t2(i)")
def quantize_int8_dynamic(spark, sf_dir):
    s = emb(spark, sf_dir).select("vec_id", V.quantize_int8_dynamic(F.col("v")).alias("s")).select("vec_id", "s.*")
    rows = s.select("vec_id", "scale", F.posexplode(F.arrays_zip("q", V.decode_int8(F.col("q"), F.col("scale")).alias("d"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x.q").cast("long").alias("value"), r6(F.col("scale")).alias("scale"), r6(F.col("x.d")).alias("decoded"))


_PACK = "list_transform(range(8), lambda k: CAST(list_sum(list_transform(range(8), lambda b: CASE WHEN v[8 * k + b + 1] > 0 THEN 1 << (7 - b) ELSE 0 END)) AS BIGINT))"


@query(f"WITH {E} " + spread_sql(f"SELECT vec_id, {_PACK} AS x FROM e", 8))
def quantize_binary(spark, sf_dir):
    return spread(B.map_vectors(emb(spark, sf_dir), [], encoder=B.Encoder("binary")), "vec_id")


@query(f"WITH {E}, t AS (SELECT vec_id, list_transform(v, lambda z: z * 9) AS v FROM e), u AS (SELECT vec_id, v, {_TOP.format(v='v')} AS top FROM t) " + spread_sql("SELECT vec_id, " + _INT8.format(v="list_transform(v, lambda z: CASE WHEN top > 1.0 THEN z * (1.0 / top) ELSE z END)") + " AS x FROM u"))
def safe_quantize(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("v", F.transform("v", lambda z: z * 9))
    return spread(B.map_vectors(e, [], encoder=B.Encoder("int8", clip=1.0)), "vec_id")


@query(f"WITH {E} " + spread_sql("SELECT vec_id, list_transform(v, lambda z: CASE WHEN z > 0 THEN 1.0 ELSE -1.0 END) AS x FROM e"))
def decode_binary(spark, sf_dir):
    return spread(emb(spark, sf_dir).select("vec_id", V.decode_binary(V.quantize_binary(F.col("v"))).alias("v")), "vec_id")


# --- D: vector-symbolic algebra -------------------------------------------------------------------------------------


@query(f"WITH {E}, {CENTROIDS}, b AS (SELECT label, list(m ORDER BY p) AS w FROM (SELECT label, i AS p, CAST(sum(CAST(v[i] AS DECIMAL(20,9))) AS DOUBLE) AS m FROM e, range(1, 65) t(i) GROUP BY label, i) GROUP BY label) " + spread_sql(f"SELECT CAST(label AS BIGINT) AS label, {UNIT.format(x='w')} AS x FROM b", ids="label"))
def vsa_bundle(spark, sf_dir):
    return spread(S.bundle(emb(spark, sf_dir).withColumn("label", F.col("label").cast("long")), "label"), "label")


_NEXT = "n AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {E}, {_NEXT}, w AS (SELECT vec_id, list_transform(range(1, 65), lambda i: a[i] * b[i]) AS w FROM n) " + spread_sql(f"SELECT vec_id, {UNIT.format(x='w')} AS x FROM w"))
def vsa_bind(spark, sf_dir):
    e = emb(spark, sf_dir)
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")
    return spread(rows.select("vec_id", V.bind(F.col("v"), F.col("b")).alias("v")), "vec_id")


@query(f"WITH {E}, {_NEXT} " + spread_sql("SELECT vec_id, list_transform(range(1, 65), lambda i: a[i] / CASE WHEN abs(b[i]) >= 1e-5 THEN b[i] WHEN b[i] < 0 THEN -1e-5 ELSE 1e-5 END) AS x FROM n"))
def vsa_unbind(spark, sf_dir):
    e = emb(spark, sf_dir)
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")
    return spread(rows.select("vec_id", V.unbind(F.col("v"), F.col("b"), unit=False).alias("v")), "vec_id")


@query(f"WITH {E}, p AS (SELECT vec_id, {_PACK} AS y FROM e) " + spread_sql("SELECT a.vec_id, list_transform(range(1, 9), lambda i: xor(a.y[i], b.y[i])) AS x FROM p a JOIN p b ON b.vec_id = a.vec_id + 1", 8))
def vsa_bind_binary(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", V.quantize_binary(F.col("v")).alias("y"))
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("y").alias("z")), "vec_id")
    return spread(rows.select("vec_id", V.bind_bytes(F.col("y"), F.col("z")).alias("v")), "vec_id")


@query(f"WITH {E}, bits AS (SELECT label, i, CASE WHEN sum(CASE WHEN v[i] > 0 THEN 1 ELSE 0 END) * 2 >= count(*) THEN 1 ELSE 0 END AS b FROM e, range(1, 65) t(i) GROUP BY label, i) SELECT CAST(label AS BIGINT) AS label, CAST((i - 1) // 8 AS BIGINT) AS pos, round(CAST(sum(b << CAST(7 - (i - 1) % 8 AS INTEGER)) AS DOUBLE), 6) + 0.0 AS value FROM bits GROUP BY label, (i - 1) // 8")
def vsa_bundle_binary(spark, sf_dir):
    e = emb(spark, sf_dir).select(F.col("label").cast("long").alias("label"), V.quantize_binary(F.col("v")).alias("v"))
    return spread(S.bundle_bytes(e, "label"), "label")


# --- E: weight algebra ----------------------------------------------------------------------------------------------

_TASKS = "t AS (SELECT vec_id AS i, CAST(j AS BIGINT) AS j, label AS task, 0.1 * (1 + label) AS scale, v[j + 1] AS w FROM e, range(64) r(j))"


@query(f"WITH {E}, {_TASKS} SELECT i % 64 AS i, j, round(CASE WHEN i % 64 = j THEN 1.0 ELSE 0.0 END + sum(scale * (w - CASE WHEN i % 64 = j THEN 1.0 ELSE 0.0 END)), 6) + 0.0 AS w FROM t GROUP BY i % 64, j")
def task_merge(spark, sf_dir):
    """Rows of the embeddings as rows of task matrices: row vec_id % 64, task label, scale 0.1 (1 + label)."""
    e = emb(spark, sf_dir).select((F.col("vec_id") % 64).alias("i"), F.col("label").alias("task"), (0.1 * (1 + F.col("label"))).alias("scale"), F.posexplode("v").alias("j", "w")).withColumn("j", F.col("j").cast("long"))
    return W.task_merge(e).select("i", "j", r6(F.col("w")).alias("w"))


@query(f"WITH {E}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), m AS (SELECT label, i - 1 AS j, CAST(sum(CAST(v[i] AS DECIMAL(20,9))) AS DOUBLE) / count(*) AS w FROM e, range(1, 65) t(i) GROUP BY label, i) SELECT CAST(j AS BIGINT) AS j, round(sum(n * w) / sum(n), 6) + 0.0 AS w FROM m JOIN n USING (label) GROUP BY j")
def federated_average(spark, sf_dir):
    """Clients are labels, their update the centroid, their interactions the rows."""
    e = emb(spark, sf_dir)
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    rows = S.centroids(e, "label").join(n, "label").select("n", F.lit(0).alias("i"), F.posexplode("v").alias("j", "w"))
    return W.federated_average(rows).select(F.col("j").cast("long").alias("j"), r6(F.col("w")).alias("w"))


@query("SELECT 'a' AS name, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(0.6 * (CAST((i * 7 + j * 3) % 11 - 5 AS DOUBLE) * 0.01) + 0.3 * (CAST((i * 7 + j * 3 + 4) % 11 - 5 AS DOUBLE) * 0.01), 6) + 0.0 AS w FROM range(64) r(i), range(64) s(j)")
def blend_weights(spark, sf_dir):
    cells = spark.range(64).withColumnRenamed("id", "i").crossJoin(spark.range(64).withColumnRenamed("id", "j"))
    one = lambda n, s: cells.select(F.lit(n).alias("name"), "i", "j", (((F.col("i") * 7 + F.col("j") * 3 + s) % 11 - 5) * 0.01).alias("w"))
    return W.blend_rows(one("a", 0).unionAll(one("b", 4)), {"a": 0.6, "b": 0.3}).select(F.lit("a").alias("name"), "i", "j", r6(F.col("w")).alias("w"))


# --- F: retrieval ---------------------------------------------------------------------------------------------------

_SCORES = "SELECT q, vec_id AS id, list_inner_product(a, v) / sqrt(list_inner_product(a, a)) / sqrt(list_inner_product(v, v)) AS score, q_label, label FROM q, e"


def _ranked(scores: str, k: int | None = 10, where: str = "", by: str = "q") -> str:
    limit = f" QUALIFY row_number() OVER w <= {k}" if k else ""
    return f"SELECT *, row_number() OVER w AS rank FROM ({scores}){where} WINDOW w AS (PARTITION BY {by} ORDER BY round(score, 9) DESC, id){limit}"


@query(f"WITH {E}, {Q} SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) + 0.0 AS score FROM ({_ranked(_SCORES)})")
def search_topk(spark, sf_dir):
    e = emb(spark, sf_dir)
    return S.top_k(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 10).select("q", "id", "rank", r6(F.col("score")).alias("score"))


@query(f"WITH {E}, {Q} SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) + 0.0 AS score FROM ({_ranked(_SCORES)})")
def search_topk_expr(spark, sf_dir):
    e = emb(spark, sf_dir)
    return S.best_scores(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 10).select("q", "id", "rank", r6(F.col("score")).alias("score"))


def _sql_search(spark, sf_dir, operator):
    e = emb(spark, sf_dir)
    return S.search_by_vector(e, vector(DIM, 1).tolist(), "v", operator, 10, "label < 5", "vec_id").select("vec_id", r6(F.col("distance")).alias("distance"))


_PROBE = "p AS (SELECT list_transform(range(64), lambda i: CAST((i + 1) % 5 - 2 AS DOUBLE) * 0.1) AS p)"


def _sql_search_oracle(expression: str) -> str:
    return f"WITH {E}, {_PROBE} SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {expression} AS d FROM e, p WHERE label < 5) ORDER BY round(d, 9), vec_id LIMIT 10"


@query(_sql_search_oracle("sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - p[i]) * (v[i] - p[i]))))"))
def vector_sql_l2(spark, sf_dir):
    return _sql_search(spark, sf_dir, "<->")


@query(_sql_search_oracle("-list_inner_product(v, p)"))
def vector_sql_ip(spark, sf_dir):
    return _sql_search(spark, sf_dir, "<#>")


@query(_sql_search_oracle("1 - list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p)))"))
def vector_sql_cosine(spark, sf_dir):
    return _sql_search(spark, sf_dir, "<=>")


@query(f"WITH {E} SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM e")
def format_pgvector_bits(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", formats.pgvector_bits(V.quantize_binary(F.col("v"))).alias("bits"))


@query(f"WITH {E}, k AS (SELECT vec_id, list_transform(v, lambda x: CAST(greatest(-128, least(127, floor(x * 127.0 + 0.5))) AS BIGINT)) AS k FROM e) SELECT vec_id, '[' || array_to_string(list_transform(k, lambda x: CAST(x AS VARCHAR)), ', ') || ']' AS text, lower(array_to_string(list_transform(k, lambda x: lpad(hex((x + 256) % 256), 2, '0')), '')) AS blob FROM k")
def format_int8(spark, sf_dir):
    """Text and byte forms of int8 vectors."""
    e = emb(spark, sf_dir).select("vec_id", V.quantize_int8(F.col("v")).alias("k"))
    text = F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: x.cast("string")), ", "), F.lit("]"))
    return e.select("vec_id", text.alias("text"), F.lower(F.hex(formats.redis_blob(F.col("k"), "int8"))).alias("blob"))


@query(f"WITH {E}, {CENTROIDS}, u AS (SELECT {UNIT.format(x='u')} AS u FROM c WHERE label = 0), w AS (SELECT {UNIT.format(x='u')} AS w FROM c WHERE label = 1) SELECT vec_id, round(list_inner_product(v, u), 6) + 0.0 AS x, round(list_inner_product(v, w), 6) + 0.0 AS y FROM e, u, w")
def project_plane(spark, sf_dir):
    e = emb(spark, sf_dir)
    x, y = S.project_2d(F.col("v"), unit_centroid(e, 0).tolist(), unit_centroid(e, 1).tolist())
    return e.select("vec_id", r6(x).alias("x"), r6(y).alias("y"))


# --- G: fusion ------------------------------------------------------------------------------------------------------

_BITS = "SELECT q, vec_id AS id, 1 - 2 * list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END)) / 64.0 AS score FROM q, e"
_LISTS = f"l AS (SELECT 0 AS list_id, q, id, rank AS pos, score FROM ({_ranked(_SCORES, 20)}) UNION ALL SELECT 1 AS list_id, q, id, rank AS pos, score FROM ({_ranked(_BITS, 20)}))"


def _two_lists(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir)
    dense = S.top_k(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 20)
    packed = e.select("vec_id", V.quantize_binary(F.col("v")).alias("v"))
    bits = S.ranked(S.all_scores(query_set(packed), packed.select(F.col("vec_id").alias("id"), "v"), "binary"), 20)
    one = lambda d, k: d.select(F.lit(k).alias("list_id"), "q", "id", F.col("rank").alias("pos"), F.col("score").cast("double").alias("score"))
    return one(dense, 0).unionAll(one(bits, 1))


@query(f"WITH {E}, {Q}, {_LISTS}, f AS (SELECT q, id, sum(1.0 / (60 + pos)) AS score, min(list_id * 1000 + pos) AS first FROM l GROUP BY q, id) SELECT q, id, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first) AS BIGINT) AS rank FROM f")
def rrf(spark, sf_dir):
    return S.rrf(_two_lists(spark, sf_dir), by=["q"]).select("q", "id", r6(F.col("score")).alias("score"), "rank")


@query(f"WITH {E}, {Q}, {_LISTS}, n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM l WINDOW w AS (PARTITION BY q, list_id)) SELECT q, id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END * CASE WHEN list_id = 0 THEN 0.7 ELSE 0.3 END), 6) + 0.0 AS score FROM n GROUP BY q, id")
def rsf(spark, sf_dir):
    return S.rsf(_two_lists(spark, sf_dir), {0: 0.7, 1: 0.3}, by=["q"]).select("q", "id", r6(F.col("score")).alias("score"))


# --- H: re-ranking --------------------------------------------------------------------------------------------------


@query(f"WITH {E}, {Q}, t AS (SELECT q, vec_id AS id, i, max(list_inner_product(a[16 * i + 1 : 16 * i + 16], v[16 * j + 1 : 16 * j + 16])) AS m FROM q, e, range(4) x(i), range(4) y(j) GROUP BY q, vec_id, i) SELECT q, id, round(score, 6) + 0.0 AS score, CAST(rank AS BIGINT) AS rank FROM ({_ranked('SELECT q, id, sum(m) AS score FROM t GROUP BY q, id', None)})")
def maxsim_rank(spark, sf_dir):
    e = emb(spark, sf_dir)
    return R.max_sim_rank(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 16).select("q", "id", r6(F.col("score")).alias("score"), "rank")


@query(ORACLES["maxsim_rank"].replace(_ranked("SELECT q, id, sum(m) AS score FROM t GROUP BY q, id", None), _ranked("SELECT q, id, sum(m) AS score FROM t GROUP BY q, id", 10)))
def maxsim_topk(spark, sf_dir):
    """The ten best of each query; every batch of documents keeps ten."""
    e = emb(spark, sf_dir)
    return R.max_sim_rank(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 16, 10).select("q", "id", r6(F.col("score")).alias("score"), "rank")


def _candidates(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir)
    found = S.top_k(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 20)
    return found.join(e.select(F.col("vec_id").alias("id"), "v"), "id").select("q", F.col("id").alias("cand"), "v", F.col("score").alias("s0"))


_GRAPH = f"k AS ({_ranked(_SCORES, 20)}), n AS (SELECT k.q, k.id, k.score AS s0, {UNIT.format(x='e.v')} AS v FROM k JOIN e ON e.vec_id = k.id), g AS (SELECT a.q, a.id AS i, b.id AS j, greatest(0.0, list_inner_product(a.v, b.v) - 0.1) AS w FROM n a JOIN n b ON a.q = b.q AND a.id <> b.id)"


@query(f"WITH {E}, {Q}, {_GRAPH}, f AS (SELECT g.q, g.i, sum(g.w) AS d, sum(g.w * (a.s0 - b.s0)) AS flow FROM g JOIN n a ON a.q = g.q AND a.id = g.i JOIN n b ON b.q = g.q AND b.id = g.j GROUP BY g.q, g.i) SELECT n.q, n.id AS cand, round(greatest(0.0, n.s0 + CASE WHEN f.d > 0 THEN f.flow / f.d ELSE 0 END), 6) + 0.0 AS score FROM n JOIN f ON f.q = n.q AND f.i = n.id")
def time_reversal_rerank(spark, sf_dir):
    return R.TimeReversal(threshold=0.1).rerank(_candidates(spark, sf_dir)).select("q", "cand", r6(F.col("score")).alias("score"))


_DIFFUSE = "r{k} AS (SELECT z.q, z.id, 0.85 * coalesce(sum(CASE WHEN d.d > 0 THEN g.w / d.d * s.s ELSE 0 END), 0) + 0.85 * max(CASE WHEN own.d > 0 THEN 0 ELSE me.s END) + 0.15 * max(z.s) AS s FROM r0 z JOIN g ON g.q = z.q AND g.i = z.id JOIN deg d ON d.q = g.q AND d.j = g.j JOIN r{p} s ON s.q = g.q AND s.id = g.j JOIN deg own ON own.q = z.q AND own.j = z.id JOIN r{p} me ON me.q = z.q AND me.id = z.id GROUP BY z.q, z.id)"


@query(f"WITH {E}, {Q}, {_GRAPH}, deg AS (SELECT q, j, sum(w) AS d FROM g GROUP BY q, j), sh AS (SELECT q, id, s0 - least(0.0, min(s0) OVER (PARTITION BY q)) AS s FROM n), r0 AS (SELECT q, id, CASE WHEN sum(s) OVER (PARTITION BY q) > 0 THEN s / sum(s) OVER (PARTITION BY q) ELSE 1.0 / count(*) OVER (PARTITION BY q) END AS s FROM sh), {', '.join(_DIFFUSE.format(k=k, p=k - 1) for k in (1, 2, 3))} SELECT q, id AS cand, round(s, 6) + 0.0 AS score FROM r3")
def multipath_rerank(spark, sf_dir):
    return R.Multipath(threshold=0.1, max_iterations=3, tolerance=1e-15).rerank(_candidates(spark, sf_dir)).select("q", "cand", r6(F.col("score")).alias("score"))


# --- I: evaluation --------------------------------------------------------------------------------------------------

_OTHERS = "SELECT q, vec_id AS id, list_inner_product(a, {v}) / sqrt(list_inner_product(a, a)) / sqrt(list_inner_product({v}, {v})) AS score, q_label, label FROM q, {e} WHERE vec_id <> q"


def _labels(e: DataFrame) -> DataFrame:
    """Relevant: another vector of the same label."""
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label")
    return q.join(e.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> q").select("q", "id")


def _lists(e: DataFrame, depth: int) -> DataFrame:
    found = S.top_k(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), depth + 1)
    own = Window.partitionBy("q").orderBy("rank")
    return found.where("id <> q").withColumn("rank", F.row_number().over(own).cast("long")).where(F.col("rank") <= depth)


_METRICS = """SELECT q, round(coalesce(1.0 / min(rank) FILTER (label = q_label), 0), 6) + 0.0 AS mrr,
round(sum(CASE WHEN label = q_label AND rank <= 10 THEN 1 ELSE 0 END) / any_value(n), 6) + 0.0 AS recall_10,
round(sum(CASE WHEN label = q_label AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(10, any_value(n)) + 1), lambda r: 1 / log2(r + 1))), 6) + 0.0 AS ndcg_10
FROM ({ranked}) JOIN (SELECT a.vec_id AS q, count(*) AS n FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id) USING (q) GROUP BY q"""


@query(f"WITH {E}, {Q} " + _METRICS.format(ranked=_ranked(_OTHERS.format(v="v", e="e"), 50)))
def recall_mrr_ndcg(spark, sf_dir):
    e = emb(spark, sf_dir)
    m = M.query_metrics(_lists(e, 50), _labels(e), [10])
    return m.select("q", *(r6(F.col(c)).alias(c) for c in ("mrr", "recall_10", "ndcg_10")))


_WARPED = f"u AS (SELECT {UNIT.format(x='u')} AS u FROM c WHERE label = 0), x AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: v[i] + 0.5 * list_inner_product(v, u) * u[i]) AS v FROM e, u)"


@query(
    f"WITH {E}, {CENTROIDS}, {_WARPED}, q0 AS (SELECT vec_id AS q, label AS q_label, v AS a FROM e WHERE vec_id % 20 = 0), q1 AS (SELECT vec_id AS q, label AS q_label, v AS a FROM x WHERE vec_id % 20 = 0), "
    + "m0 AS (" + _METRICS.format(ranked=_ranked(_OTHERS.format(v="v", e="e").replace("FROM q,", "FROM q0,"), 10)) + "), m1 AS (" + _METRICS.format(ranked=_ranked(_OTHERS.format(v="v", e="x").replace("FROM q,", "FROM q1,"), 10)) + ") "
    + " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) AS queries, round(avg(mrr), 4) + 0.0 AS mrr, round(avg(recall_10), 4) + 0.0 AS recall_10, round(avg(ndcg_10), 4) + 0.0 AS ndcg_10 FROM {m}" for n, m in (("vanilla", "m0"), ("warped", "m1")))
)
def evaluate_vanilla_vs_warped(spark, sf_dir):
    """Search quality before and after a rank-one intent toward label 0, on both sides."""
    e = emb(spark, sf_dir)
    warped = B.map_vectors(e, [B.RankOne(unit_centroid(e), 0.5)])
    parts = []
    for name, d in (("vanilla", e), ("warped", warped)):
        m = M.query_metrics(_lists(d, 10), _labels(e), [10]).select("q", *(r6(F.col(c)).alias(c) for c in ("mrr", "recall_10", "ndcg_10")))
        s = M.summary(m)
        parts.append(s.select(F.lit(name).alias("variant"), "queries", *((F.round(c, 4) + 0.0).alias(c) for c in ("mrr", "recall_10", "ndcg_10"))))
    return parts[0].unionAll(parts[1])


@query(f"WITH {E}, {Q}, t AS ({_ranked(_SCORES, 10)}), k AS (SELECT vec_id, {_INT8.format(v='v')} AS v FROM e), qi AS (SELECT vec_id AS q, v AS a FROM k WHERE vec_id % 20 = 0), i8 AS ({_ranked('SELECT q, vec_id AS id, list_inner_product(a, v) / sqrt(list_inner_product(a, a) * list_inner_product(v, v)) AS score FROM qi, k', 10)}), b AS ({_ranked(_BITS, 10)}) SELECT t.q, round(count(i8.id) / 10.0, 6) + 0.0 AS int8, round(count(b.id) / 10.0, 6) + 0.0 AS bits FROM t LEFT JOIN i8 ON i8.q = t.q AND i8.id = t.id LEFT JOIN b ON b.q = t.q AND b.id = t.id GROUP BY t.q")
def quantization_recall(spark, sf_dir):
    e = emb(spark, sf_dir)
    truth = S.top_k(query_set(e), e.select(F.col("vec_id").alias("id"), "v"), 10)

    def of(column, encoding, name):
        k = e.select("vec_id", column.alias("v"))
        found = S.top_k(query_set(k), k.select(F.col("vec_id").alias("id"), "v"), 10, encoding)
        return M.overlap_recall(truth, found, 10).select("q", r6(F.col("recall")).alias(name))

    return of(V.quantize_int8(F.col("v")), "int8", "int8").join(of(V.quantize_binary(F.col("v")), "binary", "bits"), "q")


_TRIPLE = "x AS (SELECT a.vec_id AS ex, a.v AS a, b.v AS p, [c.v, d.v, f.v] AS n FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 JOIN e d ON d.vec_id = a.vec_id + 3 JOIN e f ON f.vec_id = a.vec_id + 4)"
_COS = "(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))"


def _examples(e: DataFrame) -> DataFrame:
    """Example i: query i, positive i + 1, negatives i + 2 to i + 4."""
    out = e.select(F.col("vec_id").alias("ex"), F.col("v").alias("query"))
    for k in (1, 2, 3, 4):
        out = out.join(e.select((F.col("vec_id") - k).alias("ex"), F.col("v").alias(f"v{k}")), "ex")
    return out.select("ex", "query", F.col("v1").alias("positive"), F.array("v2", "v3", "v4").alias("negatives"))


@query(f"WITH {E}, {_TRIPLE} SELECT ex, CAST(1 + len(list_filter(n, lambda z: {_COS.format(a='a', b='z')} > {_COS.format(a='a', b='p')})) AS BIGINT) AS rank FROM x")
def positive_rank(spark, sf_dir):
    return _examples(emb(spark, sf_dir)).select("ex", M.positive_rank(F.col("query"), F.col("positive"), F.col("negatives")).alias("rank"))


def _grid_sql() -> str:
    parts = []
    for i, (strength, floor) in enumerate([(s, f) for s in (0.0, 0.5, 1.0) for f in (0.0, 0.05)]):
        warp = lambda x, s=strength, f=floor: f"list_transform({x}, lambda z, i: z + ({s} * list_inner_product({x}, u) + {f}) * u[i])"
        inner = f"SELECT {warp('a')} AS a, {warp('p')} AS p, [{', '.join(warp(f'n[{k}]') for k in (1, 2, 3))}] AS n FROM x, u"
        rank = f"1 + len(list_filter(n, lambda z: {_COS.format(a='a', b='z')} > {_COS.format(a='a', b='p')}))"
        parts.append(f"SELECT CAST({i} AS BIGINT) AS setting, round(avg(1.0 / r), 6) + 0.0 AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS recall_1 FROM (SELECT {rank} AS r FROM ({inner}))")
    return f"WITH {E}, {CENTROIDS}, u AS (SELECT {UNIT.format(x='u')} AS u FROM c WHERE label = 0), {_TRIPLE} " + " UNION ALL ".join(parts)


@query(_grid_sql())
def grid_search(spark, sf_dir):
    e = emb(spark, sf_dir)
    u = unit_centroid(e)
    build = lambda s: lambda df, c: B.map_vectors(df, [B.RankOne(u, s["strength"], s["floor"] * u)], c, c)
    scores, _ = M.grid_search(_examples(e), {"strength": [0.0, 0.5, 1.0], "floor": [0.0, 0.05]}, build)
    return scores.select("setting", r6(F.col("mrr")).alias("mrr"), r6(F.col("recall_1")).alias("recall_1"))


@query(f"WITH {E}, {Q}, r AS ({_ranked(_OTHERS.format(v='v', e='e'), 20)}), g AS (SELECT q, sum(CASE WHEN label = q_label AND rank <= 10 THEN 2 / log2(rank + 1) ELSE 0 END) AS gain, min(rank) FILTER (label = q_label) AS first FROM r GROUP BY q), i AS (SELECT a.vec_id AS q, list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda r: 2 / log2(r + 1))) AS ideal FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id) SELECT q, round(gain / ideal, 6) + 0.0 AS ndcg, round(coalesce(1.0 / first, 0), 6) + 0.0 AS reciprocal_rank FROM g JOIN i USING (q)")
def graded_ndcg(spark, sf_dir):
    e = emb(spark, sf_dir)
    judged = _labels(e).withColumn("rel", F.lit(2.0))
    return M.graded_ndcg(_lists(e, 20), judged, 10).select("q", r6(F.col("ndcg")).alias("ndcg"), r6(F.col("reciprocal_rank")).alias("reciprocal_rank"))


# --- J: learning ----------------------------------------------------------------------------------------------------


@query(f"WITH {E}, {CENTROIDS} " + spread_sql("SELECT CAST(label AS BIGINT) AS label, u AS x FROM c", ids="label"))
def centroids(spark, sf_dir):
    return spread(S.centroids(emb(spark, sf_dir).withColumn("label", F.col("label").cast("long")), "label"), "label")


@query(f"WITH {E}, {_TRIPLE}, s AS (SELECT ex, [list_inner_product(a, p) / 0.1, list_inner_product(a, n[1]) / 0.1, list_inner_product(a, n[2]) / 0.1, list_inner_product(a, n[3]) / 0.1] AS s FROM x) SELECT ex, round(-ln(greatest(exp(s[1]) / list_sum(list_transform(s, lambda z: exp(z))), 1e-9)), 6) + 0.0 AS loss FROM s")
def infonce_loss(spark, sf_dir):
    """The loss of the identity map, as expressions."""
    x = _examples(emb(spark, sf_dir))
    scores = F.concat(F.array(V.inner_product(F.col("query"), F.col("positive")) / 0.1), F.transform("negatives", lambda n: V.dot(F.col("query"), n) / 0.1))
    return x.select("ex", r6(-F.log(F.greatest(V.softmax(scores)[0], F.lit(1e-9)))).alias("loss"))


@query(f"WITH {E}, {_TRIPLE} SELECT ex, round(greatest(0.0, 0.1 + list_inner_product(a, n[1]) - list_inner_product(a, p)), 6) + 0.0 AS loss FROM x")
def triplet_loss(spark, sf_dir):
    x = _examples(emb(spark, sf_dir))
    return x.select("ex", r6(F.greatest(F.lit(0.0), 0.1 + V.inner_product(F.col("query"), F.col("negatives")[0]) - V.inner_product(F.col("query"), F.col("positive")))).alias("loss"))


@query(f"WITH {E}, x AS (SELECT a.vec_id, a.v AS a, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(-0.01 * (a[i] - y[i]) / (abs(a[i] - y[i]) + 1e-8), 6) + 0.0 AS value FROM x, range(1, 65) t(i)")
def adam_one_step(spark, sf_dir):
    """The bias after one regression step from the identity, a model for each vector."""
    e = emb(spark, sf_dir)
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("target")), "vec_id").select("vec_id", F.lit(0).cast("long").alias("seq"), F.col("v").alias("input"), "target")

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # a block of models steps at once
                part = batch.slice(lo, 256)
                pairs = list(J.read_examples(part, ["input", "target"]))
                x, y = (np.stack([p[c] for p in pairs]) for c in ("input", "target"))
                model = J.Adam.many(len(x), DIM, DIM)
                model.t = 1
                model.step(x, x - y, 0.01, 0.001)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.bias.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])

    return spread(pairs.mapInArrow(run, "vec_id long, v array<double>"), "vec_id")


_FACTORY = """p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, row_number() OVER (ORDER BY label, vec_id) - 1 AS place, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next FROM e),
n AS (SELECT label, count(*) AS n, min(place) AS before, (SELECT count(*) FROM e) AS total FROM p GROUP BY label),
k AS (SELECT p.label, p.i, p.vec_id, coalesce(prev, next, p.vec_id) AS positive, k, CAST(floor(fmod(k * (CAST(total - n AS DOUBLE) / 7) + p.i, total - n)) AS BIGINT) AS at, n, before FROM p JOIN n USING (label), range(7) r(k))"""


@query(f"WITH {E}, {_FACTORY} SELECT CAST(k.label AS BIGINT) AS label, k.i AS seq, k.vec_id AS anchor, k.positive, CAST(k.k AS BIGINT) AS slot, o.vec_id AS negative FROM k JOIN p o ON o.place = CASE WHEN k.at >= k.before THEN k.at + k.n ELSE k.at END")
def factory_examples(spark, sf_dir):
    """Which vectors make the contrastive examples of each category (ids stand for vectors)."""
    e = emb(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "vec_id", F.col("vec_id").alias("v"))
    rows = J.factory_examples(e, "label", "vec_id").select("label", "seq", "anchor", "positive", F.posexplode("negatives").alias("slot", "negative"))
    return rows.select("label", "seq", "anchor", "positive", F.col("slot").cast("long").alias("slot"), "negative")


def _let(value: str, name: str, body: str) -> str:
    return f"(list_transform([{value}], lambda {name}: {body}))[1]"


def _adam(examples: str, out: int, inp: int, gradient: str, rate: str = "0.01", first: str = "0.001") -> str:
    """SQL of sequential Adam from the identity. ``examples`` ends with a table x (model, n from 1, x input, ...); ``gradient``
    of the output y is a list, or null for no step. The last state of each model is table z."""
    start = f"list_transform(range({out * inp}), lambda k: CASE WHEN k // {inp} = k % {inp} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    zeros = lambda n: f"list_transform(range({n}), lambda k: 0.0::DOUBLE)"
    value = lambda z, m, v: f"CASE WHEN g IS NULL THEN {z} ELSE list_transform({z}, lambda z, k: z - {rate} * ({m}[k] / (1 - pow(0.9, n))) / (sqrt({v}[k] / (1 - pow(0.999, n))) + 1e-8)) END"
    mean = lambda m, g: f"CASE WHEN g IS NULL THEN {m} ELSE list_transform({m}, lambda z, k: 0.9 * z + 0.1 * {g}[k]) END"
    square = lambda v, g: f"CASE WHEN g IS NULL THEN {v} ELSE list_transform({v}, lambda z, k: 0.999 * z + 0.001 * {g}[k] * {g}[k]) END"
    return f"""WITH RECURSIVE {examples},
r AS (SELECT model, CAST(0 AS BIGINT) AS n, {start} AS w, {zeros(out)} AS b, {zeros(out * inp)} AS mw, {zeros(out * inp)} AS vw, {zeros(out)} AS mb, {zeros(out)} AS vb FROM (SELECT DISTINCT model FROM x)
UNION ALL SELECT model, n, {value("w", "mw", "vw")}, {value("b", "mb", "vb")}, mw, vw, mb, vb FROM (
SELECT *  REPLACE ({mean("mw", "gw")} AS mw, {square("vw", "gw")} AS vw, {mean("mb", "g")} AS mb, {square("vb", "g")} AS vb) FROM (
SELECT *, list_transform(w, lambda z, k: g[(k - 1) // {inp} + 1] * x[(k - 1) % {inp} + 1] + {first} * z) AS gw FROM (
SELECT *, {gradient} AS g FROM (
SELECT x.*, w, b, mw, vw, mb, vb, list_transform(b, lambda z, i: list_inner_product(w[(i - 1) * {inp} + 1 : i * {inp}], x.x) + z) AS y FROM r JOIN x ON x.model = r.model AND x.n = r.n + 1))))),
z AS (SELECT model, n, w, b FROM r QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC) = 1)"""


def _weights_sql(out: int, inp: int, by: str) -> str:
    return f"SELECT model AS {by}, CAST((k - 1) // {inp} AS BIGINT) AS i, CAST((k - 1) % {inp} AS BIGINT) AS j, round(w[k], 6) + 0.0 AS w FROM z, range(1, {out * inp + 1}) t(k) UNION ALL SELECT model, CAST(k - 1 AS BIGINT), CAST(-1 AS BIGINT), round(b[k], 6) + 0.0 FROM z, range(1, {out + 1}) t(k)"


def _epochs(rows: str, times: int) -> str:
    """Table x from rows (model, seq, ...), ``times`` over."""
    return f"x AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch, seq) AS n FROM ({rows}), range({times}) u(epoch))"


_NEXT = "SELECT {model} AS model, a.vec_id AS seq, a.v AS x, b.v AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"
_OFF = "list_transform(y, lambda z, i: z - t[i])"
_HINGE = "CASE WHEN 0.1 + list_inner_product(y, ng) - list_inner_product(y, ps) > 0 THEN list_transform(y, lambda z, i: ng[i] - ps[i]) END"
_EX = "SELECT ex % 10 AS model, ex AS seq, a AS x, p AS ps, n[1] AS ng, list_concat(a, p) AS qd, list_inner_product(a, p) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(p, p))) AS score FROM x0"


def _trained(rows: DataFrame, by: str) -> DataFrame:
    return rows.select(by, F.col("i").cast("long").alias("i"), F.coalesce("j", F.lit(-1)).alias("j"), r6(F.col("w")).alias("w"))


@query(_adam(f"{E}, " + _epochs(_NEXT.format(model="a.label"), 2), DIM, DIM, _OFF) + _weights_sql(DIM, DIM, "label"))
def train_intent(spark, sf_dir):
    """A regression map for each label: vector to its successor."""
    e = emb(spark, sf_dir)
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("target")), "vec_id").select("label", F.col("vec_id").alias("seq"), F.col("v").alias("input"), "target")
    return _trained(J.train_models(rows, J.Regression(), J.Options(epochs=2), "label"), "label")


@query(_adam(f"{E}, {_TRIPLE.replace('x AS', 'x0 AS', 1)}, " + _epochs(_EX, 2), DIM, DIM, _HINGE, "0.005") + _weights_sql(DIM, DIM, "model"))
def train_triplet(spark, sf_dir):
    x = _examples(emb(spark, sf_dir)).select((F.col("ex") % 10).alias("model"), F.col("ex").alias("seq"), F.col("query").alias("anchor"), "positive", F.col("negatives")[0].alias("negative"))
    return _trained(J.train_models(x, J.Triplet(), J.Options(epochs=2, rate=0.005)), "model")


def _contrast(t: str) -> str:
    score = f"list_concat([list_inner_product(y, ps) / {t}], list_transform(ng, lambda c: list_inner_product(y, c) / {t}))"
    shares = _let(score, "s", _let("list_transform(s, lambda c: exp(c - list_max(s)))", "h", "list_transform(h, lambda c: c / list_sum(h))"))
    return _let(shares, "p", f"list_transform(y, lambda c, i: ((p[1] - 1) * ps[i] + list_sum(list_transform(ng, lambda d, k: p[k + 1] * d[i]))) / {t})")


@query(_adam(f"{E}, {_FACTORY}, c AS (SELECT k.label, k.i, k.vec_id, k.positive, list(o.vec_id ORDER BY k.k) AS others, list(v.v ORDER BY k.k) AS ng FROM k JOIN p o ON o.place = CASE WHEN k.at >= k.before THEN k.at + k.n ELSE k.at END JOIN e v ON v.vec_id = o.vec_id GROUP BY ALL), " + _epochs("SELECT c.label AS model, c.i AS seq, a.v AS x, b.v AS ps, ng FROM c JOIN e a ON a.vec_id = c.vec_id JOIN e b ON b.vec_id = c.positive", 2), DIM, DIM, _contrast("0.07")) + _weights_sql(DIM, DIM, "label"))
def train_infonce(spark, sf_dir):
    """An intent for each label from the factory's examples."""
    weights, _ = J.build_intents(emb(spark, sf_dir), "label", "vec_id", options=J.Options(epochs=2, temperature=0.07))
    return _trained(weights, "label")


@query(_adam(f"{E}, " + _epochs("SELECT label AS model, vec_id AS seq, v AS x, v[1:8] AS t FROM e", 2), 8, DIM, _OFF, "0.05") + _weights_sql(8, DIM, "label"))
def train_migration(spark, sf_dir):
    """A projection from 64 to 8 dimensions for each label."""
    rows = emb(spark, sf_dir).select("label", F.col("vec_id").alias("seq"), F.col("v").alias("source"), F.slice("v", 1, 8).alias("target"))
    return _trained(J.train_models(rows, J.Regression("source", "target"), J.Options(epochs=2, rate=0.05), "label"), "label")


@query(_adam(f"{E}, {_TRIPLE.replace('x AS', 'x0 AS', 1)}, " + _epochs(f"SELECT * REPLACE (qd AS x) FROM ({_EX})", 2), 1, 2 * DIM, "[y[1] - score]") + _weights_sql(1, 2 * DIM, "model"))
def train_cross_encoder(spark, sf_dir):
    x = _examples(emb(spark, sf_dir)).select((F.col("ex") % 10).alias("model"), F.col("ex").alias("seq"), "query", F.col("positive").alias("document"), V.cosine_similarity(F.col("query"), F.col("positive")).alias("score"))
    return _trained(J.train_models(x, J.CrossEncoder(), J.Options(epochs=2)), "model")


@query(_adam(f"{E}, " + _epochs("SELECT * FROM (" + _NEXT.format(model="f.rate") + ", (SELECT unnest([0.1, 0.05, 0.01, 0.005, 0.001])::DOUBLE AS rate) f)", 1), DIM, DIM, _OFF, "model") + ", d AS (SELECT z.model, list_sum(list_transform(z.b, lambda c, i: pow(list_inner_product(z.w[(i - 1) * 64 + 1 : i * 64], x.x) + c - x.t[i], 2))) AS loss FROM z JOIN x ON x.model = z.model) SELECT model AS rate, round(sum(loss), 6) + 0.0 AS loss FROM d GROUP BY model")
def learning_rates(spark, sf_dir):
    e = emb(spark, sf_dir)
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("target")), "vec_id").select(F.col("vec_id").alias("seq"), F.col("v").alias("input"), "target")
    return J.rate_losses(rows, J.Regression(), J.Options(epochs=1)).select("rate", r6(F.col("loss")).alias("loss"))


_WHITEN = f"""WITH RECURSIVE {E}, x AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e),
r AS (SELECT label, CAST(0 AS BIGINT) AS n, list_transform(range(64), lambda k: 0.0::DOUBLE) AS mean, list_transform(range(64), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w, 1e-6::DOUBLE AS first FROM (SELECT DISTINCT label FROM x)
UNION ALL SELECT label, n, mean, list_transform(u, lambda c: c / sqrt(list_inner_product(u, u))), 0.95 * first + 0.05 * y * y FROM (
SELECT *, list_transform(w, lambda c, i: c + 0.05 * (y * rest[i] - y * y * c)) AS u FROM (
SELECT *, list_inner_product(w, rest) AS y FROM (
SELECT *, list_transform(v, lambda c, i: c - mean[i]) AS rest FROM (
SELECT x.label, x.n, x.v, w, first, CASE WHEN x.n = 1 THEN x.v ELSE list_transform(mean, lambda c, i: 0.95 * c + 0.05 * x.v[i]) END AS mean FROM r JOIN x ON x.label = r.label AND x.n = r.n + 1)))))
SELECT label, n, CAST(i - 1 AS BIGINT) AS pos, round(mean[i], 6) + 0.0 AS mean, round(w[i], 6) + 0.0 AS first_axis, round(first, 6) + 0.0 AS first_value FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC) = 1), range(1, 65) t(i)"""


@query(_WHITEN)
def whitening_fit(spark, sf_dir):
    rows = emb(spark, sf_dir).select("label", F.col("vec_id").alias("seq"), "v")
    fit = J.fit_whitening(rows, DIM, 2, 0.05, "label")
    return fit.select("label", "n", F.posexplode("mean").alias("pos", "x"), "components", "eigenvalues").select("label", "n", F.col("pos").cast("long").alias("pos"), r6(F.col("x")).alias("mean"), r6(F.col("components")[0][F.col("pos")]).alias("first_axis"), r6(F.col("eigenvalues")[0]).alias("first_value"))


_EWMA = "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events), r AS (SELECT user_id, n, value AS m, total FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, r.m * 0.9 + o.value * 0.1, r.total FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)"


@query(_EWMA + " SELECT user_id, round(m, 6) + 0.0 AS ewma FROM r WHERE n = total")
def ewma_fold(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return J.ewma(events, "user_id", "event_id", "value", 0.1).select("user_id", r6(F.col("ewma")).alias("ewma"))


# --- K: feedback ----------------------------------------------------------------------------------------------------

_SIGNALS = "s AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(event_id % 5 AS BIGINT) AS idx, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'dwell' ELSE 'skip' END AS type, value * 20 AS value, event_id FROM events WHERE event_type IN ('click', 'view', 'error'))"
_MARKS = "m AS (SELECT user_id, day, idx, max(CASE WHEN type = 'click' OR type = 'dwell' AND value >= 3000 THEN 1 ELSE 0 END) AS pos, max(CASE WHEN type = 'skip' OR type = 'dwell' AND (value IS NULL OR value < 3000) THEN 1 ELSE 0 END) AS neg FROM s GROUP BY user_id, day, idx), a AS (SELECT i.user_id, i.day, CAST(r.k AS BIGINT) AS idx, coalesce(pos, 0) = 1 AS pos, coalesce(neg, 0) = 1 AS neg FROM (SELECT DISTINCT user_id, day FROM m) i CROSS JOIN range(5) r(k) LEFT JOIN m ON m.user_id = i.user_id AND m.day = i.day AND m.idx = r.k), f AS (SELECT user_id, day, idx, pos, NOT pos AND (neg OR bool_or(pos) OVER (PARTITION BY user_id, day)) AS neg FROM a)"


def _feedback(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An impression is a user's day with five results; click, view (dwell) and error (skip) events are signals on the
    result event_id % 5. Vectors are the result numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("click", "view", "error"))
    rows = events.select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("imp_id"), "user_id", F.to_date("ts").alias("day"), "ts", (F.col("event_id") % 5).cast("int").alias("idx"), F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "dwell").otherwise("skip").alias("type"), (F.col("value") * 20).alias("value"))
    imps = rows.groupBy("imp_id", "user_id", "day").agg(F.max("ts").alias("ts")).select("imp_id", "user_id", "day", "ts", F.array(F.lit(0.0)).alias("query"), F.array(*(F.array(F.lit(float(k))) for k in range(5))).alias("results"))
    return imps, rows


@query(f"WITH {_SIGNALS}, {_MARKS} SELECT user_id, CAST(day AS VARCHAR) AS day, idx, pos AS positive, neg AS negative FROM f")
def feedback_classes(spark, sf_dir):
    imps, signals = _feedback(spark, sf_dir)
    rows = K.classify_results(imps, signals).join(imps.select("imp_id", "user_id", "day"), "imp_id")
    return rows.select("user_id", F.col("day").cast("string").alias("day"), F.col("idx").cast("long").alias("idx"), "positive", "negative")


@query(f"WITH {_SIGNALS}, {_MARKS} SELECT p.user_id, CAST(p.day AS VARCHAR) AS day, p.idx AS pos_idx, n.idx AS neg_idx FROM f p JOIN f n ON n.user_id = p.user_id AND n.day = p.day WHERE p.pos AND n.neg")
def feedback_triplets(spark, sf_dir):
    imps, signals = _feedback(spark, sf_dir)
    rows = K.triplets(imps, signals).join(imps.select("imp_id", "user_id", "day"), "imp_id")
    return rows.select("user_id", F.col("day").cast("string").alias("day"), F.col("pos_idx").cast("long").alias("pos_idx"), F.col("neg_idx").cast("long").alias("neg_idx"))


@query(f"WITH {_SIGNALS}, {_MARKS} SELECT p.user_id, CAST(p.day AS VARCHAR) AS day, p.idx AS pos_idx, string_agg(CAST(n.idx AS VARCHAR), ',' ORDER BY n.idx) AS negatives FROM f p JOIN f n ON n.user_id = p.user_id AND n.day = p.day WHERE p.pos AND n.neg GROUP BY ALL")
def feedback_infonce(spark, sf_dir):
    imps, signals = _feedback(spark, sf_dir)
    rows = K.infonce_examples(imps, signals).join(imps.select("imp_id", "user_id", "day"), "imp_id")
    return rows.select("user_id", F.col("day").cast("string").alias("day"), F.col("pos_idx").cast("long").alias("pos_idx"), F.array_join(F.transform("negatives", lambda v: v[0].cast("int").cast("string")), ",").alias("negatives"))


@query(f"WITH {_SIGNALS}, {_MARKS} SELECT count(*) AS pending, CAST(sum(CASE WHEN p AND n THEN 1 ELSE 0 END) AS BIGINT) AS actionable FROM (SELECT bool_or(pos) AS p, bool_or(neg) AS n FROM f GROUP BY user_id, day)")
def feedback_counters(spark, sf_dir):
    return K.counters(*_feedback(spark, sf_dir))


@query(f"WITH {_SIGNALS}, i AS (SELECT user_id, CAST(day AS VARCHAR) AS day, max(event_id) AS last FROM (SELECT user_id, day, event_id FROM s) GROUP BY user_id, day) SELECT user_id, day FROM i QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 3")
def feedback_eviction(spark, sf_dir):
    """The three latest impressions of each user (a top-k)."""
    imps, _ = _feedback(spark, sf_dir)
    return K.keep_latest(imps, 3, ["user_id"]).select("user_id", F.col("day").cast("string").alias("day"))


@query("SELECT user_id, event_id, CAST(n AS BIGINT) AS step, CAST(n // 5 AS BIGINT) AS chunk, round(greatest(0.0001, 0.01 / (1 + 0.05 * n)), 6) + 0.0 AS rate FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)")
def scheduler_lr(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return K.schedule(events, "user_id", "event_id", decay=0.05).select("user_id", "event_id", "step", "chunk", r6(F.col("rate")).alias("rate"))


_ONLINE = f"""WITH RECURSIVE {_SIGNALS}, {_MARKS}, x AS (SELECT p.idx AS ps, n.idx AS ng, row_number() OVER (ORDER BY concat(p.user_id, '/', p.day), p.idx, n.idx) AS n FROM f p JOIN f n ON n.user_id = p.user_id AND n.day = p.day WHERE p.pos AND n.neg),
r AS (SELECT CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS b, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v UNION ALL
SELECT n, CASE WHEN g IS NULL THEN b ELSE b - greatest(0.0001, 0.01 / (1 + 0.01 * (n - 1))) * (m / (1 - pow(0.9, n))) / (sqrt(v / (1 - pow(0.999, n))) + 1e-8) END, m, v FROM (
SELECT n, g, b, CASE WHEN g IS NULL THEN m ELSE 0.9 * m + 0.1 * g END AS m, CASE WHEN g IS NULL THEN v ELSE 0.999 * v + 0.001 * g * g END AS v FROM (
SELECT x.n, b, m, v, CASE WHEN 0.1 + b * ng - b * ps > 0 THEN CAST(ng - ps AS DOUBLE) END AS g FROM r JOIN x ON x.n = r.n + 1 WHERE x.n <= (SELECT count(*) // 5 * 5 FROM x))))
SELECT n AS steps, round(b, 6) + 0.0 AS bias FROM r ORDER BY n DESC LIMIT 1"""


@query(_ONLINE)
def online_scheduler(spark, sf_dir):
    """The adaptive schedule over all triplets of one bias, in the order of users and days: weights after the last."""
    imps, signals = _feedback(spark, sf_dir)
    s = K.Scheduler(J.OnlineTrainer(J.Triplet()), decay=0.01)
    out = J.train_online(K.triplets(imps, signals), s, J.initial(1, 1), ["imp_id", "pos_idx", "neg_idx"])
    return out.where("j is null").select("steps", r6(F.col("w")).alias("bias"))


@query(f"WITH {E}, m AS (SELECT {matrix_sql(16, 64)} AS w) " + spread_sql(f"SELECT vec_id, {affine_sql('w', 'v')} AS x FROM e, m", 16))
def stream_pipeline(spark, sf_dir):
    """The projection as a stream over the same files, written once and read back."""
    root = shared_folder(spark, "stream")
    batch = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    files = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    # a stream reads folders; a table that is one file is found by its name in the folder that holds it
    single = len(batch.inputFiles()) == 1 and batch.inputFiles()[0].rstrip("/").endswith("embeddings.parquet")
    stream = files.option("pathGlobFilter", "embeddings.parquet").load(sf_dir) if single else files.load(f"{sf_dir}/embeddings.parquet")
    rows = stream.select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    p = Pipeline(DIM).projection({"default": B.Weights(matrix(16, 64), vector(16))})
    to_table(run_stream(rows, p), f"{root}/out", f"{root}/state").awaitTermination()
    return spread(spark.read.schema("vec_id long, v array<double>").parquet(f"{root}/out"), "vec_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_vanilla_vs_warped(spark, sf_dir)
