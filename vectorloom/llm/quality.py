"""Operator 9: hierarchical empirical-Bayes quality classifier.

A logistic document classifier on whole-text statistics gives each document's evidence. Sites give priors: the mean
evidence of a host is shrunk toward the global mean, and the mean evidence of a path below a host toward the host's,
by Beta priors whose strength is estimated from the spread between sites (method of moments). All of it is grouped
aggregation with partial sums, so a site may hold any share of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch, sample_share, text_slices

FEATURES = ("log_words", "upper", "symbols", "digits", "bars", "exclaims", "distinct", "top_word", "repeats", "line_copies", "word_length", "line_words", "long_words", "sentence_ends", "letters")
_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or non-ASCII, 3 digit, 4 white, 5 symbol, 6 bar, 7 exclamation, 0 other
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"]] = 5
_KIND[ord("|")], _KIND[ord("!")] = 6, 7


def features(text: str | None) -> list[float]:
    """Statistics of one whole text; a null, empty or blank text has zeros everywhere."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=8).astype(float)
    n, size = len(words), float(len(raw))
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    lines = [s for s in raw.split(b"\n") if s.strip()]
    letters = kinds[1] + kinds[2]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = sum(s.rstrip()[-1:] in b".?:;\"'" for s in lines) / len(lines)
    return [
        np.log1p(n), kinds[1] / max(letters, 1), kinds[5] / size, kinds[3] / size, kinds[6] / n, kinds[7] / n, len(counts) / n**0.8, max(counts.values()) / n, repeats,
        1 - len(set(lines)) / len(lines), lengths.mean() / 10, np.log1p(n / len(lines)), float((lengths > 15).mean()), ends, letters / size,
    ]


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.schema.get_field_index("text")
        for start, stop in text_slices(batch, "text"):
            part = batch.slice(start, stop - start)
            rows = [features(t) for t in part.column(text).to_pylist()]
            kept = [part.column(i) for i in range(part.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.float64()))], names=["id", "host", "path", "features"])


class Evidence:
    """Standardised logistic regression."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, base: float):
        self.mean, self.scale, self.weights, self.bias, self.base = mean, scale, weights, bias, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weights + self.bias


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.concatenate([z, z * z / 4], axis=1)


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Evidence:
    """Ridge logistic regression by Newton's method. With labels of one kind only, or none, every document gets the
    (smoothed) share of good labels."""
    width = len(FEATURES)
    base = (float(y.sum()) + 1.0) / (len(y) + 2.0)
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(width), np.ones(width), np.zeros(2 * width), float(np.log(base / (1 - base))), base)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = _expand((x - mean) / scale)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]), base)


def _map_score(model: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.schema.get_field_index("features"))
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(model.logits(x), -12, 12)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p)], names=["id", "host", "path", "p"])

    return run


def strength(groups: DataFrame, parent: str) -> float:
    """Prior strength of sites below ``parent`` (a column with the parent's mean), by the method of moments.

    ``groups`` has n, s (sum of evidence) and q (sum of squares) for each site. The spread of site means beyond what
    the spread within sites explains gives the strength; without such spread the prior is strong. Between 1 and 1000.
    """
    row = groups.where("n >= 2").select("n", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("v"), F.col(parent).alias("g"))
    got = row.agg(F.sum("n"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2), F.sum("v"), F.sum(F.col("n") * F.col("v")), F.count("*")).first()
    if not got[0]:
        return 10.0
    between, within, noise = got[1] / got[0], got[3] / got[0], got[2] / got[0]
    return float(min(1000.0, max(1.0, within / max(between - noise, 1e-9))))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, cut: float = 0.35, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", scratch: Scratch | None = None) -> DataFrame:
    """Posterior quality of every document: classifier evidence with the prior odds of its site.

    The classifier learns from about ``train_rows`` labelled documents at most (a share of them by the hash of the id).
    The site levels are ``host_col`` and, below it, ``path_col``; a null is a site of its own. A document's site
    prior leaves its own evidence out. posterior logit = classifier logit - logit(global) + logit(site prior).

    Returns (id_col, evidence double, host_prior double, site_prior double, score double, rejected boolean), a row for
    each row of ``docs``; rejected means score < ``cut``. Null, empty and blank texts have all statistics zero. Labels
    that are null or of unknown documents are ignored, and with several labels the largest counts. Without usable
    labels the evidence is one half and nothing is rejected. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    rows = docs.select(F.col(id_col).alias("id"), as_text(host_col).alias("host"), as_text(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    known = scratch.keep(rows.mapInArrow(_map_features, f"id {kind}, host string, path string, features array<double>"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    marks = scratch.keep(marks)
    share = sample_share(marks.count(), train_rows)
    sample = known.join(marks.where(share("id")), "id").select("features", "y").collect()
    x = np.array([r[0] for r in sample], dtype=float).reshape(len(sample), len(FEATURES))
    model = fit_evidence(x, np.array([float(r[1] > 0) for r in sample]))
    scored = scratch.keep(known.mapInArrow(_map_score(model), f"id {kind}, host string, path string, p double"))
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    site = scratch.keep(scored.groupBy("host", "path").agg(*sums))
    host = site.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq"))
    total = host.agg(F.sum("n"), F.sum("s")).first()
    share = float(total[1] / total[0]) if total[0] else model.base
    m1 = strength(host.withColumn("g", F.lit(share)), "g")
    host_mean = host.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + m1 * share) / (F.col("n") + m1)).alias("hm"))
    m2 = strength(site.join(host_mean, "host"), "hm")
    priors = site.join(host_mean, "host").select("host", "path", "n", "s", "hn", "hs")
    own = scored.join(priors, ["host", "path"])
    host_prior = (F.col("hs") - F.col("p") + m1 * share) / (F.col("hn") - 1 + m1)
    own = own.withColumn("host_prior", F.least(F.greatest(host_prior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    site_prior = (F.col("s") - F.col("p") + m2 * F.col("host_prior")) / (F.col("n") - 1 + m2)
    own = own.withColumn("site_prior", F.least(F.greatest(site_prior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = lambda c: F.log(c / (1 - c))
    logit = odds(F.col("p")) - F.lit(float(np.log(share / (1 - share)) if 0 < share < 1 else 0.0)) + odds(F.col("site_prior"))
    score = 1 / (1 + F.exp(-logit))
    rejected = (score < cut) if sample else F.lit(False)
    return own.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_prior", "site_prior", score.alias("score"), rejected.alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.35, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` does not reject, with all their columns. A repeated id goes only
    if every row of it is rejected; rows without an id, whose score cannot be met again, stay. Null and empty texts are
    judged by their site alone; an empty table gives an empty one."""
    scores = quality_scores(docs, labels, cut=cut, id_col=id_col, **options)
    good = scores.where(~F.col("rejected")).select(id_col).distinct()
    return docs.join(good.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns).unionAll(docs.where(F.col(id_col).isNull()))
