"""Registered queries over stored models, formats, files and settings, with their DuckDB SQL; the rules of ``queries`` hold."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from vectorloom import queries as C
from vectorloom.errors import ValidationError
from vectorloom.functions import vectors as V
from vectorloom.operators import blocks as B
from vectorloom.operators import feedback as K
from vectorloom.operators import learn as J
from vectorloom.operators import metrics as M
from vectorloom.operators import rerank as R
from vectorloom.operators import weights as W
from vectorloom.plans.pipeline import Metrics, Pipeline
from vectorloom.queries import DIM, E, Q, emb, query, r6, spread, spread_sql
from vectorloom.session import shared_folder
from vectorloom.sources import formats

MAP = "SELECT vec_id, {value} AS x FROM e, m"


def _affine(shift: int) -> str:
    return f"WITH {E}, m AS (SELECT {C.matrix_sql(64, 64, shift)} AS w) " + spread_sql(MAP.format(value=C.affine_sql("w", "v", shift)))


def _cells(spark, weights: B.Weights):
    """A model as rows (i, j, w), the bias with j -1."""
    rows, cols = weights.matrix.shape
    data = [(i, j, float(weights.matrix[i, j])) for i in range(rows) for j in range(cols)] + [(i, -1, float(weights.bias[i])) for i in range(rows)]
    return spark.createDataFrame(data, "i long, j long, w double").select("i", "j", r6(F.col("w")).alias("w"))


# --- functions ------------------------------------------------------------------------------------------------------


@query(f"WITH {E} " + spread_sql("SELECT a.vec_id, list_transform(a.v, lambda z, i: z + 0.5 * b.v[i]) AS x FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"))
def add_scaled(spark, sf_dir):
    e = emb(spark, sf_dir)
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return spread(e.join(following, "vec_id").select("vec_id", V.add_scaled(F.col("v"), F.col("b"), 0.5).alias("v")), "vec_id")


_DYNAMIC = "s AS (SELECT vec_id, greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-8) AS top, v FROM e), k AS (SELECT vec_id, top, list_transform(v, lambda x: CAST(greatest(-128, least(127, floor(x * (127.0 / top) + 0.5))) AS BIGINT)) AS k FROM s)"


@query(f"WITH {E}, {_DYNAMIC} SELECT a.vec_id, CAST(list_sum(list_transform(a.k, lambda x, i: x * b.k[i])) AS BIGINT) AS plain, round(list_sum(list_transform(a.k, lambda x, i: x * b.k[i])) * (a.top / 127) * (b.top / 127), 6) + 0.0 AS scaled FROM k a JOIN k b ON b.vec_id = a.vec_id + 1")
def int8_scaled_dot(spark, sf_dir):
    """Inner products of vectors encoded with a scale of their own, plain and decoded."""
    e = emb(spark, sf_dir).select("vec_id", V.quantize_int8_dynamic(F.col("v")).alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", V.int8_dot(F.col("a.q"), F.col("b.q")).alias("plain"), r6(V.int8_dot(F.col("a.q"), F.col("b.q"), F.col("a.scale"), F.col("b.scale"))).alias("scaled"))


# --- models ---------------------------------------------------------------------------------------------------------

_MODEL = "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round({cell}, 6) + 0.0 AS w FROM range(64) r(i), range(64) s(j) UNION ALL SELECT CAST(i AS BIGINT), CAST(-1 AS BIGINT), round({bias}, 6) + 0.0 FROM range(64) r(i)"
_CELL, _BIAS = "CAST((i * 7 + j * 3 + {s}) % 11 - 5 AS DOUBLE) * 0.01", "CAST((i + {s}) % 5 - 2 AS DOUBLE) * 0.1"


@query(_MODEL.format(cell=_CELL.format(s=2), bias=_BIAS.format(s=2)))
def flat_matrix(spark, sf_dir):
    """A matrix given flat, with its bias, and taken apart again."""
    weights = C.intent(2)
    return _cells(spark, B.Weights(B._matrix(weights.matrix.reshape(-1).tolist(), DIM, DIM), weights.bias))


@query(_affine(5))
def intents_changed(spark, sf_dir):
    """Intents added, replaced and removed before a run."""
    step = B.Intents({"a": C.intent(0)}, "a").add("b", C.intent(3)).add("a", C.intent(5)).remove("b")
    if step.names != ["a"]:
        raise ValidationError("intents", "a removed one is left")
    return spread(B.map_vectors(emb(spark, sf_dir), [step]), "vec_id")


@query(_MODEL.format(cell=f"CAST(CAST({_CELL.format(s=4)} AS FLOAT) AS DOUBLE)", bias=f"CAST(CAST({_BIAS.format(s=4)} AS FLOAT) AS DOUBLE)"))
def intent_bytes(spark, sf_dir):
    """An intent through its binary form, which holds single precision."""
    data = W.to_bytes(B.Weights(C.matrix(DIM, DIM, 4), C.vector(DIM, 4), C.vector(DIM)))
    if len(data) != 8 + 4 * (DIM * DIM + 2 * DIM):
        raise ValidationError("data", "has another length")
    return _cells(spark, W.from_bytes(data))


_STORED = Pipeline(DIM).intents({"a": C.intent(0)}, "a").projection({"default": B.Weights(C.matrix(16, DIM, 1), C.vector(16, 1))})


@query(C.ORACLES["pipeline_run"])
def pipeline_stored(spark, sf_dir):
    """A pipeline with its encoder through its stored state."""
    p = Pipeline.from_json(_STORED.to_json()).encode("int8")
    return spread(Pipeline.from_json(p.to_json()).run(emb(spark, sf_dir)), "vec_id")


@query(C.ORACLES["pipeline_run"])
def pipeline_stored_as_array(spark, sf_dir):
    """The older stored form: an array of steps, their states as strings."""
    steps = [{"kind": s.kind, "state": json.dumps(s.state())} for s in _STORED.steps]
    return spread(Pipeline.from_json(json.dumps(steps)).encode("int8").run(emb(spark, sf_dir)), "vec_id")


@query(f"WITH {E}, m AS (SELECT {C.matrix_sql(32, 64, 0, '0.1')} AS w0, {C.matrix_sql(16, 32, 7, '0.1')} AS w1), h AS (SELECT vec_id, {C.act_sql(C.affine_sql('w0', 'v'), 'relu')} AS h, w1 FROM e, m) " + spread_sql(f"SELECT vec_id, {C.act_sql(C.affine_sql('w1', 'h', 2), 'tanh')} AS x FROM h", 16))
def mlp_replaced(spark, sf_dir):
    """A network whose second layer is replaced by one of another width."""
    mlp = B.Mlp([(C.matrix(32, DIM, 0, 0.1), C.vector(32), "relu"), (C.matrix(8, 32, 3, 0.1), C.vector(8, 1), "sigmoid")])
    return spread(B.map_vectors(emb(spark, sf_dir), [mlp.with_layer(1, (C.matrix(16, 32, 7, 0.1), C.vector(16, 2), "tanh"))]), "vec_id")


@query(f"WITH {E} " + spread_sql("SELECT vec_id, list_transform(v, lambda z, i: CASE WHEN v[1] > 0 THEN z * 2 + CAST(i % 5 - 2 AS DOUBLE) * 0.1 ELSE z + CAST((i - 1) % 5 - 2 AS DOUBLE) * 0.1 END) AS x FROM e"))
def moe_custom_router(spark, sf_dir):
    """Experts chosen by a function: the sign of the first component."""
    experts = [("low", B.Weights(np.eye(DIM), C.vector(DIM))), ("high", B.Weights(2 * np.eye(DIM), C.vector(DIM, 1)))]
    return spread(B.map_vectors(emb(spark, sf_dir), [B.Experts(experts, router=lambda x: (x[:, 0] > 0).astype(int))]), "vec_id")


@query(f"WITH {E} " + spread_sql("SELECT vec_id, v AS x FROM e"))
def anomaly_strict(spark, sf_dir):
    """The strict guard lets vectors within the limit pass as they are."""
    return spread(B.map_vectors(emb(spark, sf_dir), [B.AnomalyGuard(100.0, "strict")]), "vec_id")


_BASE = "CAST((i + j) % 3 AS DOUBLE) * 0.1"


@query(f"WITH {E}, t AS (SELECT vec_id % 64 AS i, CAST(j AS BIGINT) AS j, 0.1 * (1 + label) AS scale, v[j + 1] AS w FROM e, range(64) r(j)) SELECT i, j, round({_BASE} + sum(scale * (w - {_BASE})), 6) + 0.0 AS w FROM t GROUP BY i, j")
def task_merge_base(spark, sf_dir):
    """Tasks merged over a stated base."""
    tasks = emb(spark, sf_dir).select((F.col("vec_id") % 64).alias("i"), F.col("label").alias("task"), (0.1 * (1 + F.col("label"))).alias("scale"), F.posexplode("v").alias("j", "w")).withColumn("j", F.col("j").cast("long"))
    base = spark.range(DIM).withColumnRenamed("id", "i").crossJoin(spark.range(DIM).withColumnRenamed("id", "j")).withColumn("w", ((F.col("i") + F.col("j")) % 3) * 0.1)
    return W.task_merge(tasks, base).select("i", "j", r6(F.col("w")).alias("w"))


@query("SELECT CAST(2 AS BIGINT) AS clients, CAST(0 AS BIGINT) AS after_reset, * FROM (" + _MODEL.format(cell=f"0.25 * ({_CELL.format(s=1)}) + 0.75 * ({_CELL.format(s=6)})", bias=f"0.25 * ({_BIAS.format(s=1)}) + 0.75 * ({_BIAS.format(s=6)})") + ")")
def federated_round(spark, sf_dir):
    """Two clients' updates averaged by their interactions, and the count after a reset."""
    round_ = W.FederatedAggregator(B.Weights(np.eye(DIM), np.zeros(DIM)))
    round_.submit(C.intent(1), 5)
    round_.submit(C.intent(6), 15)
    clients, out = round_.client_count, round_.aggregate()
    round_.reset(out)
    return _cells(spark, out).select(F.lit(clients).cast("long").alias("clients"), F.lit(round_.client_count).cast("long").alias("after_reset"), "i", "j", "w")


# --- formats and files ----------------------------------------------------------------------------------------------

#: Quarters have one short text on every engine.
_QUARTERS = "k AS (SELECT vec_id, label, list_transform(v, lambda x: round(x * 8) / 4 + 0.0) AS v FROM e)"


def _quarters(spark, sf_dir):
    return emb(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.round(x * 8) / 4 + 0.0))


_TEXT = "array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), '{sep}')"


@query(f"""WITH {E}, {_QUARTERS} SELECT vec_id, '[' || {_TEXT.format(sep=', ')} || ']' AS pgvector,
'{{"vector":[' || {_TEXT.format(sep=',')} || '],"topK":7}}' AS pinecone,
'{{"vector":[' || {_TEXT.format(sep=',')} || '],"topK":10,"filter":{{"label":' || label || '}}}}' AS filtered,
'{{"vector":[' || {_TEXT.format(sep=',')} || '],"topK":5,"returnValues":true,"returnMetadata":"all"}}' AS vectorize,
'{{"id":"' || vec_id || '","values":[' || {_TEXT.format(sep=',')} || '],"metadata":{{"label":' || label || '}}}}' AS record FROM k""")
def format_float(spark, sf_dir):
    """The text forms of float vectors: one database literal, and queries and records as JSON."""
    k, v = _quarters(spark, sf_dir), F.col("v")
    where = F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}"))
    return k.select("vec_id", formats.pgvector(v).alias("pgvector"), formats.pinecone_query(v, 7).alias("pinecone"), formats.pinecone_query(v, 10, where).alias("filtered"), formats.vectorize_query(v, 5, True, "all").alias("vectorize"), formats.vectorize_record(F.col("vec_id"), v, F.struct("label")).alias("record"))


_SINGLE = " ".join(f"WHEN {k} THEN '{struct.pack('<f', k / 4).hex()}'" for k in range(-40, 41))


@query(f"WITH {E}, {_QUARTERS} SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE CAST(x * 4 AS BIGINT) {_SINGLE} END), '') AS blob FROM k")
def format_float_bytes(spark, sf_dir):
    """Little-endian single precision."""
    return _quarters(spark, sf_dir).select("vec_id", F.lower(F.hex(formats.redis_blob(F.col("v")))).alias("blob"))


@query(f"WITH {E}, m AS (SELECT {C.matrix_sql(16, 64)} AS w), k AS (SELECT vec_id, {C._INT8.format(v=C.affine_sql('w', 'v'))} AS k FROM e, m) SELECT vec_id, '[' || array_to_string(list_transform(k, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ', ') || ']' AS formatted FROM k")
def formatted_run(spark, sf_dir):
    """A pipeline's result in a database's text form, in one run."""
    p = Pipeline(DIM).projection({"default": B.Weights(C.matrix(16, DIM), C.vector(16))}).encode("int8")
    return p.run_and_format(emb(spark, sf_dir), "pgvector").select("vec_id", "formatted")


@query(f"WITH {E}, {_QUARTERS} SELECT f.file, CAST(vec_id AS VARCHAR) AS id, CAST(t.i - 1 AS BIGINT) AS pos, round(v[t.i], 6) + 0.0 AS value FROM k, range(1, 65) t(i), (VALUES ('csv'), ('jsonl')) f(file)")
def corpus_files(spark, sf_dir):
    """A corpus written as JSON lines and as CSV, and read back."""
    root, k = shared_folder(spark, "files"), _quarters(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.col("v").alias("vector"))
    k.write.json(f"{root}/corpus.jsonl")
    k.select("id", F.to_json("vector").alias("vector")).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/corpus.csv")
    parts = [formats.read_corpus(spark, f"{root}/corpus.{kind}").withColumn("file", F.lit(kind)) for kind in ("jsonl", "csv")]
    return spread(parts[0].unionAll(parts[1]), "file", "id")


@query(f"WITH {E} SELECT f.file, round(sum(a.v[1]), 4) + 0.0 AS first_sum, count(*) AS queries, CAST(sum(CASE WHEN a.vec_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS expected FROM (SELECT vec_id, list_transform(v, lambda x: round(x * 8) / 4 + 0.0) AS v FROM e) a, (VALUES ('csv'), ('jsonl')) f(file) GROUP BY f.file")
def dataset_files(spark, sf_dir):
    """Evaluation sets written as JSON lines and as CSV, and read back: queries and the documents they expect."""
    root = shared_folder(spark, "files")
    one = F.col("vec_id").cast("string")
    k = _quarters(spark, sf_dir).select(F.col("v").alias("queryVector"), F.when(F.col("vec_id") % 2 == 0, F.array(one, F.lit("x"))).otherwise(F.array(one)).alias("expectedDocIds"))
    k.write.json(f"{root}/set.jsonl")
    k.select(F.to_json("queryVector").alias("queryVector"), F.array_join("expectedDocIds", ";").alias("expectedIds")).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/set.csv")
    parts = [formats.read_dataset(spark, f"{root}/set.{kind}").withColumn("file", F.lit(kind)) for kind in ("jsonl", "csv")]
    return parts[0].unionAll(parts[1]).groupBy("file").agg((F.round(F.sum(F.col("v")[0]), 4) + 0.0).alias("first_sum"), F.count("*").alias("queries"), F.sum(F.size("expected")).cast("long").alias("expected"))


# --- re-ranking, evaluation, learning -------------------------------------------------------------------------------


@query(C.ORACLES["time_reversal_rerank"])
def rerank_assume_unit(spark, sf_dir):
    """Vectors of unit length go into the graph as they are."""
    rows = C._candidates(spark, sf_dir).withColumn("v", V.normalize(F.col("v")))
    return R.TimeReversal(threshold=0.1).rerank(rows, assume_unit=True).select("q", "cand", r6(F.col("score")).alias("score"))


@query(f"WITH {E}, {Q} " + C._METRICS.format(ranked=C._ranked(C._OTHERS.format(v="v", e="e"), 3)).replace("<= 10", "<= 3").replace("least(10,", "least(3,").replace("recall_10", "recall_3").replace("ndcg_10", "ndcg_3"))
def category_metrics(spark, sf_dir):
    """The first three results, relevant if of the query's category."""
    e = emb(spark, sf_dir)
    return M.query_metrics(C._lists(e, 3), C._labels(e), [3]).select("q", *(r6(F.col(c)).alias(c) for c in ("mrr", "recall_3", "ndcg_3")))


@query(C._adam(f"{E}, " + C._epochs(C._NEXT.format(model="a.label"), 1), DIM, DIM, C._OFF, "0.02", "0.0") + C._weights_sql(DIM, DIM, "label"))
def train_stream(spark, sf_dir):
    """One epoch over sorted batches, of which none is held, without regularisation."""
    e = emb(spark, sf_dir)
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("target")), "vec_id").select("label", F.col("vec_id").alias("seq"), F.col("v").alias("input"), "target")
    return C._trained(J.train_models(rows, J.Regression(), J.Options(rate=0.02, epochs=1, regularization=0.0), "label"), "label")


@query("SELECT * FROM (VALUES ('defaults', true), ('rate 0', false), ('rate nan', false), ('temperature -1', false), ('regularization -1', false), ('regularization 0', true), ('margin -0.1', false), ('epochs 0', false), ('patience 0', false), ('patience 1', true)) t(setting, accepted)")
def option_checks(spark, sf_dir):
    """Which training settings are accepted."""
    cases = {"defaults": {}, "rate 0": {"rate": 0.0}, "rate nan": {"rate": float("nan")}, "temperature -1": {"temperature": -1.0}, "regularization -1": {"regularization": -1.0}, "regularization 0": {"regularization": 0.0}, "margin -0.1": {"margin": -0.1}, "epochs 0": {"epochs": 0}, "patience 0": {"patience": 0}, "patience 1": {"patience": 1}}

    def accepted(options: dict) -> bool:
        try:
            J.Options(**options).check()
        except ValidationError:
            return False
        return True

    return spark.createDataFrame([(name, accepted(options)) for name, options in cases.items()], "setting string, accepted boolean")


@query("SELECT CAST(n AS BIGINT) AS steps, round(greatest(0.002, 0.05 / (1 + 0.1 * n)), 6) + 0.0 AS rate FROM range(0, 300, 7) t(n)")
def scheduler_state(spark, sf_dir):
    """The rate of schedulers rebuilt from their stored state."""
    rows = []
    for n in range(0, 300, 7):
        s = K.Scheduler(J.OnlineTrainer(J.Triplet()), 0.05, 0.002, 0.1)
        s.steps = n
        again = K.Scheduler.import_state(J.OnlineTrainer(J.Triplet()), s.export_state())
        rows.append((again.steps, again.rate))
    return spark.createDataFrame(rows, "steps long, rate double").select("steps", r6(F.col("rate")).alias("rate"))


# --- pipelines ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES (0, 'input: 64'), (1, '1. intent -> 64'), (2, '2. projection -> 16'), (3, 'encode: int8')) t(line, text)")
def pipeline_inspected(spark, sf_dir):
    p = Pipeline.from_json(_STORED.to_json()).encode("int8")
    return spark.createDataFrame(list(enumerate(p.inspect().split("\n"))), "line int, text string")


@query(f"WITH {E}, m AS (SELECT {C.matrix_sql(64, 64)} AS w, {C.matrix_sql(16, 64, 1)} AS p), o AS (SELECT {C.affine_sql('w', 'v')} AS h, p FROM e, m WHERE vec_id = (SELECT min(vec_id) FROM e)) SELECT 'intent' AS step, CAST(i - 1 AS BIGINT) AS pos, round(h[i], 6) + 0.0 AS value FROM o, range(1, 65) t(i) UNION ALL SELECT 'projection', CAST(i - 1 AS BIGINT), round(y[i], 6) + 0.0 FROM (SELECT {C.affine_sql('p', 'h', 1)} AS y FROM o), range(1, 17) t(i)")
def pipeline_dry_run(spark, sf_dir):
    """Each step's output for one vector."""
    first = emb(spark, sf_dir).orderBy("vec_id").first()["v"]
    rows = [(s["step"], k, float(x)) for s in _STORED.dry_run(first) for k, x in enumerate(s["output"])]
    return spark.createDataFrame(rows, "step string, pos long, value double").select("step", "pos", r6(F.col("value")).alias("value"))


@query(f"WITH {E} SELECT CAST(2 AS BIGINT) AS runs, CAST(count(*) + sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS vectors, true AS timed FROM e")
def pipeline_metrics(spark, sf_dir):
    """Runs, vectors and step times that two runs report on their own."""
    metrics = Metrics()
    metrics.enable()
    p = Pipeline.from_json(_STORED.to_json()).measured(metrics)
    e = emb(spark, sf_dir)
    for rows in (e, e.where("label = 0")):
        p.run(rows).write.format("noop").mode("overwrite").save()
    got = metrics.get()
    timed = all(s["blocks"] > 0 and s["mean_ms"] > 0 for s in got["steps"].values()) and set(got["steps"]) == {"intent", "projection"}
    return spark.createDataFrame([(got["runs"], got["vectors"], timed)], "runs long, vectors long, timed boolean")


@query(f"WITH {E} " + spread_sql("SELECT vec_id, list_transform(v, lambda z: CASE WHEN z > 0.1 THEN 1.0 WHEN z < -0.1 THEN -1.0 ELSE 0.0 END) AS x FROM e"))
def custom_encoding(spark, sf_dir):
    """A final stage of one's own: three levels."""
    B.register_encoding("ternary", "array<tinyint>", lambda x: B._lists(np.where(np.abs(x) > 0.1, np.sign(x), 0).astype(np.int8), B.pa.int8()))
    return spread(Pipeline(DIM).encode("ternary").run(emb(spark, sf_dir)), "vec_id")


@query(C.ORACLES["pipeline_run"])
def packed_vectors(spark, sf_dir):
    """The intent, projection and int8 encoding on packed vectors: binary in, one byte a component out."""
    e = B.pack_vectors(emb(spark, sf_dir), dtype="<f8")
    out = B.map_vectors(e, _STORED.steps, encoder=B.Encoder("int8"), packed="<f8")
    byte = lambda i: F.conv(F.substring(F.hex("v"), i * 2 + 1, 2), 16, 10).cast("int")
    signed = F.array(*(F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i)).cast("double") for i in range(16)))
    return spread(out.select("vec_id", signed.alias("v")), "vec_id")
