"""Retrieval quality and model selection."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import ValidationError
from vectorloom.functions import vectors as V
from vectorloom.operators.search import top_k


def ideal_gain(k: int) -> list[float]:
    """Ideal DCG of 0..k relevant documents."""
    out = [0.0]
    for r in range(1, k + 1):
        out.append(out[-1] + 1 / math.log2(r + 1))
    return out


def query_metrics(ranked: DataFrame, expected: DataFrame, ks: list[int]) -> DataFrame:
    """Per query of ``expected`` (q, id): recall and NDCG at each k and the reciprocal rank of the first hit in the
    full list of ``ranked`` (q, id, rank). A query without expected documents has no row; one without hits has zeros."""
    want = expected.select("q", "id").distinct()
    sizes = want.groupBy("q").agg(F.count("*").alias("wanted"))
    hits = ranked.join(want, ["q", "id"]).select("q", "rank")
    aggs = [F.min("rank").alias("first")]
    for k in ks:
        aggs.append(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}"))
        aggs.append(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"gain_{k}"))
    rows = sizes.join(hits.groupBy("q").agg(*aggs), "q", "left")
    out = [F.col("q"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        ideal = F.array(*(F.lit(x) for x in ideal_gain(k)))[F.least(F.col("wanted"), F.lit(k)).cast("int")]
        out.append((F.coalesce(f"hits_{k}", F.lit(0)) / F.col("wanted")).alias(f"recall_{k}"))
        out.append(F.coalesce(F.col(f"gain_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"))
    return rows.select(*out)


def summary(per_query: DataFrame) -> DataFrame:
    """Averages over queries of every metric column."""
    return per_query.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in per_query.columns if c != "q"))


def evaluate(queries: DataFrame, corpus: DataFrame, expected: DataFrame, ks: list[int] = (1, 3, 5, 10), warp: Callable[[DataFrame], DataFrame] | None = None, depth: int | None = None) -> DataFrame:
    """One row a variant: vanilla, and warped if ``warp`` (a DataFrame function on column v) is given; both the corpus
    and the queries are warped. ``depth`` is the length of the ranked lists (default: the largest k)."""
    depth = depth or max(ks)
    out = summary(query_metrics(top_k(queries, corpus, depth), expected, list(ks))).withColumn("variant", F.lit("vanilla"))
    if warp:
        found = top_k(warp(queries), warp(corpus), depth)
        out = out.unionByName(summary(query_metrics(found, expected, list(ks))).withColumn("variant", F.lit("warped")))
    return out


def report(results: DataFrame) -> str:
    """A text table of ``evaluate``'s rows (a handful)."""
    rows = results.orderBy("variant").collect()
    names = [c for c in results.columns if c != "variant"]
    lines = [" | ".join(["metric".ljust(12), *(r["variant"].rjust(10) for r in rows)])]
    for name in names:
        lines.append(" | ".join([name.ljust(12), *(f"{r[name]:10.4f}" if isinstance(r[name], float) else str(r[name]).rjust(10) for r in rows)]))
    return "\n".join(lines)


def positive_rank(query, positive, negatives):
    """1 + the number of negatives that score strictly better than the positive (cosine)."""
    return V.let(V.cosine_similarity(query, positive), lambda p: 1 + F.size(F.filter(negatives, lambda n: V.cosine_similarity(query, n) > p))).cast("long")


def ranking_metrics(examples: DataFrame, ks: list[int] = (1, 5, 10)) -> DataFrame:
    """MRR and recall at k over (query, positive, negatives) rows, one positive each."""
    ranks = examples.select(positive_rank(F.col("query"), F.col("positive"), F.col("negatives")).alias("r"))
    return ranks.agg(F.avg(1.0 / F.col("r")).alias("mrr"), *(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks))


def graded_ndcg(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(q, ndcg, reciprocal_rank) with gains rel / log2(rank + 1) of ``judged`` (q, id, rel); the ideal order
    is that of all judged documents."""
    best = judged.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("rel").desc(), "id"))).where(F.col("r") <= k)
    gain = lambda rel, r: rel / F.log2(r + 1.0)
    ideal = best.groupBy("q").agg(F.sum(gain(F.col("rel"), F.col("r"))).alias("ideal"))
    got = ranked.join(judged, ["q", "id"]).groupBy("q").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("gain"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"))
    return ideal.join(got, "q", "left").select("q", F.when(F.col("ideal") > 0, F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def overlap_recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q, recall): share of the true top k (q, id, rank) that the found top k holds."""
    a = truth.where(F.col("rank") <= k).select("q", "id")
    b = found.where(F.col("rank") <= k).select("q", "id", F.lit(1).alias("hit"))
    return a.join(b, ["q", "id"], "left").groupBy("q").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def grid(space: dict[str, list]) -> list[dict]:
    """Every combination, the first key slowest."""
    if not space or any(not v for v in space.values()):
        raise ValidationError("search space", "needs values for every parameter")
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def grid_search(examples: DataFrame, space: dict[str, list], build: Callable[[dict], Callable[[DataFrame, str], DataFrame]], metric: str = "mrr") -> tuple[DataFrame, dict]:
    """(scores, best parameters): ``build`` makes a transformation (DataFrame, column) for a parameter set; queries,
    positives and negatives are transformed and ranked. All settings are one plan; the first best wins."""
    if metric != "mrr" and not metric.startswith("recall_"):
        raise ValidationError("metric", f"unknown: {metric}")
    settings = grid(space)
    ks = [1, 5, 10]
    parts = []
    base = examples.select("ex", F.posexplode(F.concat(F.array("query", "positive"), F.col("negatives"))).alias("slot", "v"))
    for i, setting in enumerate(settings):
        moved = build(setting)(base, "v")
        sets = moved.groupBy("ex").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda r: r["v"]).alias("all"))
        cut = sets.select(F.col("all")[0].alias("query"), F.col("all")[1].alias("positive"), F.slice("all", F.lit(3), F.size("all")).alias("negatives"))
        parts.append(ranking_metrics(cut, ks).withColumn("setting", F.lit(i).cast("long")))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    found = scores.orderBy(F.round(metric, 12).desc(), "setting").first()
    return scores, settings[found["setting"]]
