"""Late interaction and graph re-ranking of candidate sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import DimensionError, ValidationError, positive, positive_int
from vectorloom.functions import vectors as V
from vectorloom.operators.blocks import unit_rows
from vectorloom.operators.search import PAIRS, beside_blocks, in_query_blocks, meetings, top_rows

#: Scores that a task holds where every document is ranked.
CELLS = 8_000_000


def tokens(df, column: str, dim: int):
    """Flat token matrices (tokens x dim) as arrays of tokens; the length must be a multiple of ``dim``."""
    positive_int(dim, "dim")
    flat = F.col(column)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / dim).cast("int") - 1), lambda k: F.slice(flat, (k * dim + 1).cast("int"), F.lit(dim)))
    return F.when(F.size(flat) == 0, F.array().cast("array<array<double>>")).when(F.size(flat) % dim != 0, F.raise_error(F.lit("token matrix length is no multiple of the dimension"))).otherwise(cut)


def max_sim(query_tokens, doc_tokens):
    """Sum over query tokens of the largest inner product with a document token; 0 if either has none."""
    best = F.transform(query_tokens, lambda q: F.coalesce(F.array_max(F.transform(doc_tokens, lambda d: V.dot(q, d))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def max_sim_rank(queries: DataFrame, docs: DataFrame, dim: int, k: int | None = None) -> DataFrame:
    """(q, id, score, rank) of ``docs`` (id, v flat tokens) for the stated ``queries`` (q, v flat tokens), the k best of
    each query where given. An Arrow batch of documents meets a block of queries in one matrix product of their tokens.
    Without k, a task ranks its queries over all documents: it reads them, holds about ``CELLS`` scores, or those of one
    query if there are more documents, and nothing is shuffled but the queries."""
    positive_int(dim, "dim")

    def flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens below one another, and where each row's begin (one entry more)."""
        sizes = np.array([len(r) for r in rows])
        if (sizes % dim).any():
            raise ValidationError("tokens", "the length is no multiple of the dimension")
        return np.concatenate([np.asarray(r, dtype=np.float64) for r in rows] or [np.empty(0)]).reshape(-1, dim), np.concatenate(([0], np.cumsum(sizes // dim)))

    def scores(left: np.ndarray, starts: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        """Of each query with each row (id, v) of ``part``."""
        right, begins = flat([v.values.to_numpy(zero_copy_only=False) for v in part.column(1)])
        some, whole = np.flatnonzero(np.diff(begins)), np.flatnonzero(np.diff(starts))
        score = np.zeros((len(starts) - 1, part.num_rows))
        if len(some) and len(whole):
            best = np.maximum.reduceat(left @ right.T, begins[:-1][some], axis=1)  # a query token's best in each document
            score[np.ix_(whole, some)] = np.add.reduceat(best, starts[:-1][whole], axis=0)
        return score

    def over(block: list) -> DataFrame:
        names = np.array([r[0] for r in block], dtype=np.int64)
        left, starts = flat([r[1] for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    yield top_rows(scores(left, starts, part), part.column(0).to_numpy(zero_copy_only=False), names, k)

        return docs.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "q long, id long, score double")

    def rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tokens_of, held = {}, {}, {}
        for block, q, vectors, rows in meetings(batches):
            if block not in names:
                names[block], tokens_of[block], held[block] = q, flat([v.values.to_numpy(zero_copy_only=False) for v in vectors]), []
            rows = rows.filter(rows.column(1).is_valid())
            for lo in range(0, rows.num_rows, 1024):
                part = rows.slice(lo, 1024)
                held[block].append((part.column(0).to_numpy(zero_copy_only=False), scores(*tokens_of[block], part)))
        for block, parts in held.items():
            if not parts:
                continue
            ids, found = np.concatenate([p[0] for p in parts]), [p[1] for p in parts]
            for i, q in enumerate(names[block].tolist()):
                score = np.concatenate([s[i] for s in found])
                order = np.lexsort((ids, -np.round(score, 9)))
                for lo in range(0, len(order), PAIRS):
                    some = order[lo : lo + PAIRS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q)), pa.array(ids[some]), pa.array(score[some]), pa.array(np.arange(lo + 1, lo + len(some) + 1))], names=["q", "id", "score", "rank"])

    if k is None:
        rows = max(1, CELLS // max(1, docs.count()))
        return beside_blocks(docs.coalesce(1), queries.where("v is not null"), rows).mapInArrow(rank_all, "q long, id long, score double, rank long")
    return in_query_blocks(queries, docs, over, k)


class GraphReranker:
    """Scores a candidate set on its similarity graph: weights max(0, cosine - threshold), no self loops."""

    def __init__(self, threshold: float = 0.0):
        self.threshold = float(threshold)

    def graph(self, x: np.ndarray) -> np.ndarray:
        w = np.maximum(0.0, x @ x.T - self.threshold)
        np.fill_diagonal(w, 0.0)
        return w

    def prepare(self, s0: np.ndarray) -> np.ndarray:
        return s0

    def iterate(self, w: np.ndarray, s0: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score(self, query: np.ndarray | None, candidates: np.ndarray, s0: np.ndarray | None = None, assume_unit: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(scores, initial scores). Initial scores default to cosines with the query; one candidate keeps its own."""
        x = np.asarray(candidates, dtype=np.float64)
        if query is not None and len(x) and len(query) != x.shape[1]:
            raise DimensionError(x.shape[1], len(query), "query")
        x = x if assume_unit else unit_rows(x)
        if s0 is None:
            if query is None:
                raise ValidationError("query", "a query or initial scores are needed")
            s0 = x @ unit_rows(np.asarray(query, dtype=np.float64)[None])[0]
        s0 = np.asarray(s0, dtype=np.float64)
        if len(x) <= 1:
            return s0.copy(), s0
        return self.iterate(self.graph(x), self.prepare(s0)), s0

    def rerank(self, candidates: DataFrame, by: str = "q", assume_unit: bool = False) -> DataFrame:
        """(by, cand, score, initial_score, rank) of ``candidates`` (by, cand, v, s0): one candidate set is one task, so
        it is meant to be the top of a search, not a corpus. ``assume_unit``: the vectors have unit length already."""
        model = self

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cand", kind="stable")
            score, first = model.score(None, np.stack(pdf["v"].to_list()), pdf["s0"].to_numpy(), assume_unit)
            return pd.DataFrame({by: pdf[by].to_numpy(), "cand": pdf["cand"].to_numpy(), "score": score, "initial_score": first})

        kind = candidates.schema[by].dataType.simpleString()
        out = candidates.select(by, F.col("cand").cast("long").alias("cand"), "v", F.col("s0").cast("double").alias("s0")).groupBy(by).applyInPandas(one, f"{by} {kind}, cand long, score double, initial_score double")
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round("score", 9).desc(), "cand"))
        return out.withColumn("rank", rank.cast("long"))


class Multipath(GraphReranker):
    """Diffusion with restart on the column-stochastic graph: S = a P S + (1 - a) S0; an isolated candidate keeps its
    share. Initial scores are shifted to be non-negative and sum to one (uniform if all are zero)."""

    def __init__(self, alpha: float = 0.85, threshold: float = 0.0, max_iterations: int = 20, tolerance: float = 1e-6):
        super().__init__(threshold)
        if not 0 <= alpha < 1:
            raise ValidationError("alpha", "must lie in [0, 1)")
        self.alpha, self.max_iterations, self.tolerance = alpha, positive_int(max_iterations, "max_iterations"), positive(tolerance, "tolerance")

    def prepare(self, s0: np.ndarray) -> np.ndarray:
        s = s0 - min(0.0, s0.min())
        return s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))

    def iterate(self, w: np.ndarray, s0: np.ndarray) -> np.ndarray:
        degree = w.sum(axis=0)
        p = np.where(degree > 0, w / np.where(degree > 0, degree, 1.0), np.eye(len(w)))
        s = s0
        for _ in range(self.max_iterations):
            after = self.alpha * (p @ s) + (1 - self.alpha) * s0
            moved = np.abs(after - s).max()
            s = after
            if moved < self.tolerance:
                break
        return s


class TimeReversal(GraphReranker):
    """Anti-diffusion: S_i grows by tau times the (degree-normalised) sum of w_ij (S_i - S_j), floored at zero."""

    def __init__(self, tau: float = 1.0, threshold: float = 0.0, normalize: bool = True, iterations: int = 1):
        super().__init__(threshold)
        self.tau, self.normalize, self.iterations = float(tau), normalize, positive_int(iterations, "iterations")

    def iterate(self, w: np.ndarray, s0: np.ndarray) -> np.ndarray:
        degree = w.sum(axis=1)
        s = s0.copy()
        for _ in range(self.iterations):
            flow = degree * s - w @ s
            if self.normalize:
                flow = np.divide(flow, degree, out=np.zeros_like(flow), where=degree > 0)
            s = np.maximum(0.0, s + self.tau * flow)
        return s

