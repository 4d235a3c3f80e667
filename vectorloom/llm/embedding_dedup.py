"""Operator 1: near-duplicate vectors by random-hyperplane sign hashing, exact cosines and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch, connected_components, local_forest

#: Vectors in one chunk of a large bucket; a block holds two chunks at most.
CHUNK = 1024
#: Labels of chunks whose vectors have one key in the first table carry it above this bit.
PURE = 1 << 24
BASE = "id long, h1 long, h2 long, dim int, vec binary, keys array<int>"


def plan_tables(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about 8 rows, and as many tables as find a pair at the threshold with ``recall``.

    At an angle a, one bit agrees with probability 1 - a/pi, so a table of k bits meets a pair with (1 - a/pi)^k.
    """
    bits = min(30, max(8, round(math.log2(max(rows, 2) / 8))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def _hash(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
        for batch in batches:
            ids, h1, h2, dims, vecs, keys = [], [], [], [], [], []
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        by_dim.setdefault(len(x), []).append((i, x))
                        continue
                ids.append(i), h1.append(None), h2.append(None), dims.append(None), vecs.append(None), keys.append(None)
            for dim, rows in by_dim.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                x = np.stack([r[1] for r in rows]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                sign = (x @ planes[dim] > 0).reshape(len(rows), tables, bits)
                k = (sign @ weights).astype(np.int64).astype(np.int32)
                for (i, v), key in zip(rows, k.tolist(), strict=True):
                    raw = (v + v.dtype.type(0)).tobytes()  # -0.0 and 0.0 are one
                    ids.append(i), dims.append(dim), vecs.append(raw), keys.append(key)
                    h1.append(xxhash.xxh64_intdigest(raw, seed=1) - (1 << 63)), h2.append(xxhash.xxh64_intdigest(raw, seed=2) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], names=["id", "h1", "h2", "dim", "vec", "keys"])

    return run


def _links(threshold: float, dtype: str):
    """Rows sorted by block: links found, as a forest (kind 0: node, node) and as counts (kind 1: node, vectors linked)."""

    def block(table: int, i: int, j: int, node: np.ndarray, copies: np.ndarray, chunk: np.ndarray, vec: bytes, keys: np.ndarray) -> tuple | None:
        x = np.frombuffer(vec, dtype=dtype).reshape(len(node), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        if i == j:
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk != i)
            a, b = np.nonzero(x[one] @ x[two].T >= threshold)
            a, b = one[a], two[b]
        if table and len(a):  # a pair counts in the first table in which it meets
            keys = keys.reshape(len(node), -1)[:, :table]
            fresh = np.ones(len(a), dtype=bool)
            for lo in range(0, len(a), 100_000):
                fresh[lo : lo + 100_000] = ~(keys[a[lo : lo + 100_000]] == keys[b[lo : lo + 100_000]]).any(axis=1)
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        n = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        src, dst = local_forest([(node[a], node[b])])
        hit = n > 0
        return np.concatenate([np.zeros(len(src), np.int8), np.ones(int(hit.sum()), np.int8)]), np.concatenate([src, node[hit]]), np.concatenate([dst, n[hit].astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def close() -> None:
            if sum(len(h[0]) for h in held) > 1:
                node, copies, chunk, vec, keys = zip(*held, strict=True)
                if out := block(key[0], key[2], key[3], np.concatenate(node), np.concatenate(copies), np.concatenate(chunk), b"".join(vec), np.concatenate(keys)):
                    done.append(out)
            held.clear()

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], names=["kind", "a", "b"])
            done.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("t", "key", "i", "j")])
            node, copies, chunk = (batch.column(c).to_numpy() for c in ("rep", "copies", "chunk"))
            vec, keys = batch.column("vec"), batch.column("keys")
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(vec).to_numpy(zero_copy_only=False))))
            data = memoryview(vec.buffers()[2])[np.frombuffer(vec.buffers()[1], dtype=np.int32)[vec.offset] :]
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            tables = len(flat) // batch.num_rows
            at = np.flatnonzero(np.concatenate(([True], (where[:, 1:] != where[:, :-1]).any(axis=0))))
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows], strict=True):
                own = tuple(where[:, lo].tolist())
                if own != key:
                    close()
                    key = own
                held.append((node[lo:hi], copies[lo:hi], chunk[lo:hi], bytes(data[ends[lo] : ends[hi]]), flat[lo * tables : hi * tables]))
            if len(done) > 500:
                yield found()
        close()
        if done:
            yield found()

    return run


def _dealt(places: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, key, rep, chunk, i, j): the blocks in which the vectors of each bucket meet.

    A bucket of up to ``CHUNK`` vectors is one block. Others are cut, and every pair of chunks is a block. In all tables
    but the first, vectors that agree in the first table fill chunks of their own as far as they can, and two such chunks
    of one key do not meet again: their pairs have been counted.
    """
    # written, so that the joins deal both sides anew and AQE can split a large bucket
    sizes = scratch.keep(places.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    cold = places.join(sizes.where(F.col("n") <= CHUNK).select("t", "key"), ["t", "key"]).select("t", "key", "rep", *(F.lit(0).cast("long").alias(c) for c in ("chunk", "i", "j")))
    hot = scratch.keep(places.join(sizes.where(F.col("n") > CHUNK).select("t", "key"), ["t", "key"]))
    groups = hot.groupBy("t", "key", "key0").agg(F.count("*").alias("m")).withColumn("pure", (F.col("t") > 0) & (F.col("m") >= CHUNK // 2))
    mixed = groups.where("not pure").groupBy("t", "key").agg(F.sum("m").alias("m"))
    parts = F.ceil(F.col("m") / CHUNK).cast("long")
    pure = scratch.keep(groups.where("pure").select("t", "key", "key0", parts.alias("parts")))
    rest = scratch.keep(mixed.select("t", "key", parts.alias("rest")))
    label = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: (F.col("key0").cast("long") + 1) * PURE + k)
    labels = pure.select("t", "key", label.alias("labels")).unionAll(rest.select("t", "key", F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)))
    labels = scratch.keep(labels.groupBy("t", "key").agg(F.flatten(F.collect_list("labels")).alias("labels")))  # one for CHUNK / 2 vectors
    own = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("rep"), F.col("rest"))).otherwise((F.col("key0").cast("long") + 1) * PURE + F.pmod(F.xxhash64("rep"), F.col("parts")))
    spots = hot.join(pure, ["t", "key", "key0"], "left").join(rest, ["t", "key"], "left").select("t", "key", "rep", own.alias("chunk"))
    met = spots.join(labels, ["t", "key"]).select("t", "key", "rep", "chunk", F.explode("labels").alias("o"))
    met = met.where((F.col("chunk") < PURE) | (F.shiftright("chunk", 24) != F.shiftright("o", 24)))
    return cold.unionAll(met.select("t", "key", "rep", "chunk", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j")))


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """Vectors linked by cosine >= threshold, compared in double precision, whatever their other columns.

    Candidate pairs share the sign pattern of ``bits`` random hyperplanes in at least one of several tables (see
    ``plan_tables``); every candidate pair is then measured exactly, so no link lies below the threshold, and a pair
    at the threshold is found with probability ``recall`` or more (closer pairs more surely). Equal vectors are one
    row to the search. A bucket of more than ``CHUNK`` vectors becomes blocks of two chunks, of which those that the
    first table has counted are left out; a pair counts only in the first table in which it meets, so links need no
    shuffle to be distinct.

    Returns (id_col, n_links long, component_id long, kept boolean). Vectors that are null, empty, zero or hold null
    or non-finite components, and vectors of different lengths, link with nothing. Rows without an id are left out; of
    rows that share an id one counts (the largest by hash). An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embed")
    dtype = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    kind = "array<float>" if dtype == "<f4" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null")
    bits, tables = plan_tables(rows.count(), threshold, recall)
    hashed = rows.mapInArrow(_hash(bits, tables, seed), BASE).groupBy("id").agg(F.max(F.struct("h1", "h2", "dim", "vec", "keys")).alias("s"))
    base = scratch.keep(hashed.select("id", "s.*"))
    classes = base.where("vec is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.keep(classes)
    reps = scratch.keep(base.join(classes, base.id == classes.rep, "inner").select("rep", "copies", "dim", "vec", "keys"))
    # vectors of other lengths have no cosine, so the length is a part of the key
    places = reps.select("rep", "dim", F.element_at("keys", 1).alias("key0"), F.posexplode("keys").alias("t", "k")).select("rep", "t", (F.col("dim").cast("long") * (1 << 32) + F.col("k")).alias("key"), "key0")
    blocks = _dealt(places, scratch).join(reps.drop("dim"), "rep").select("t", "key", "i", "j", "rep", "copies", "vec", "keys", "chunk")
    links = scratch.keep(blocks.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(_links(threshold, dtype), "kind byte, a long, b long"))
    comps = connected_components(links.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    counts = links.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    of_class = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def oracle(threshold: float = 0.95) -> str:
    """DuckDB SQL for the rows of ``embedding_near_dedup`` over ``embeddings``: all pairs and the closure of the links."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= {threshold}),
r AS (SELECT vec_id, vec_id AS far FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.far)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(far) AS component_id, vec_id = min(far) AS kept FROM r GROUP BY vec_id"""
