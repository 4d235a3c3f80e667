"""Brute-force search and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.errors import DimensionError, ValidationError, positive_int
from vectorloom.functions import vectors as V
from vectorloom.operators.blocks import block_of, unit_rows
from vectorloom.session import shared_folder

#: Queries that go over the corpus in one pass.
QUERY_BLOCK = 4096
#: Queries and corpus rows that meet in one task where all pairs are asked for; pairs of an Arrow batch.
QUERY_ROWS, CORPUS_ROWS, PAIRS = 256, 4096, 200_000
#: Queries and corpus rows that meet in one task where pairs are made by expressions.
QUERY_ROWS, CORPUS_ROWS = 256, 4096
#: Parts of the corpus of which each sends its k best of a query; bytes of the vectors in a packed row, of which an Arrow
#: batch has 10 000 at most.
PARTS, PACKED = 4, 8192


def ranked(scores: DataFrame, k: int | None, by: str = "q", order: tuple[Column, ...] | None = None, rank: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each ``by``; only the first ``k`` where given (Spark prunes before the exchange)."""
    order = order or (F.round("score", 9).desc(), F.col("id").asc())
    out = scores.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return out if k is None else out.where(F.col(rank) <= k)


def with_queries(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of ``corpus`` beside every row of the stated query set ``queries`` (column q): a lazy plan that writes no
    pair. A set of up to ``QUERY_ROWS`` rows is broadcast; a larger one is a Cartesian product of partitions, whose tasks
    hold that many queries and read their share of the corpus again. What is shuffled is each table once, and a task makes
    about ``QUERY_ROWS * CORPUS_ROWS`` pairs, so that sorting them needs no disk either."""
    blocks, parts = -(-queries.count() // QUERY_ROWS), -(-corpus.count() // CORPUS_ROWS)
    corpus = corpus.repartition(parts) if parts > 1 else corpus
    if blocks <= 1:
        return corpus.crossJoin(F.broadcast(queries))
    return corpus.crossJoin(queries.repartition(blocks).hint("shuffle_replicate_nl"))


def beside_blocks(corpus: DataFrame, queries: DataFrame, rows: int) -> DataFrame:
    """(block, id, v, own): the rows (id, v) of ``corpus`` beside blocks of about ``rows`` rows (q, v) of ``queries``, as a
    Cartesian product of partitions, so that nothing is broadcast or written. ``own``, the block's rows, stands only beside
    the first row of each partition of the corpus (see ``meetings``)."""
    return _beside(_doubles(corpus, "id"), queries, rows)


def _doubles(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("long").alias(name), F.col("v").cast("array<double>").alias("v"))


def _beside(left: DataFrame, queries: DataFrame, rows: int) -> DataFrame:
    """(block, the columns of ``left``, own), as ``beside_blocks`` says."""
    queries = _doubles(queries, "q")
    blocks = max(1, -(-queries.count() // rows))
    packed = queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("q", "v")).alias("own")).repartitionByRange(blocks, "block")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # its lower bits number a partition's rows
    return left.withColumn("first", first).crossJoin(packed.hint("shuffle_replicate_nl")).select("block", *left.columns, F.when(F.col("first"), F.col("own")).alias("own"))


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.ListArray, pa.RecordBatch]]:
    """(block, q, their vectors, rows of the corpus) for the batches of ``beside_blocks``."""
    held: dict[int, tuple[np.ndarray, pa.ListArray]] = {}
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)).tolist():
            names, vectors = batch.column(batch.num_columns - 1).slice(k, 1).flatten().flatten()
            held[int(block[k])] = names.to_numpy(zero_copy_only=False), vectors
        rows = batch.select(range(1, batch.num_columns - 1))
        for b in np.unique(block).tolist():
            yield b, *held[b], rows if (block == b).all() else rows.filter(pa.array(block == b))


def _matrix(column: pa.ListArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column, zeros for null, and which are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    known = block_of(column.drop_null(), dim) if there.any() else np.zeros((0, dim or 0))
    out = np.zeros((len(column), known.shape[1]))
    out[there] = known
    return out, there


def all_scores(queries: DataFrame, corpus: DataFrame, encoding: str = "float", product: bool = False) -> DataFrame:
    """(q, id, score) of every pair of ``queries`` (q, v) and ``corpus`` (id, v), and their inner ``product`` where asked for.
    Blocks of ``QUERY_ROWS`` queries meet partitions of ``CORPUS_ROWS`` rows in matrix products; no pair is written or
    shuffled. ``encoding``: float and int8 by cosine, binary by 1 - 2 h / bits. A null vector has null scores, a zero vector
    cosine 0."""
    metric = {"float": "cosine"}.get(encoding, encoding)
    if metric not in METRICS:
        raise ValidationError("encoding", f"unknown: {encoding}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, vectors, rows in meetings(batches):
            a, known = _matrix(vectors, None)
            step = max(1, PAIRS // len(names))
            for lo in range(0, rows.num_rows, step):
                part = rows.slice(lo, step)
                b, there = _matrix(part.column(1), a.shape[1] if known.any() else None)
                if known.any() and there.any():
                    score = _scores(_ready(b, metric), _ready(a, metric), metric)
                    found = [score, b @ a.T] if product else [score]
                else:
                    found = [np.zeros((len(b), len(a)))] * (1 + product)
                none = None if known.all() and there.all() else ~np.outer(there, known).reshape(-1)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(ids))), pa.array(np.repeat(ids, len(names))), *(pa.array(x.reshape(-1), mask=none) for x in found)], names=["q", "id", "score", "product"][: 2 + len(found)])

    parts = -(-corpus.count() // CORPUS_ROWS)
    pairs = beside_blocks(corpus.repartition(parts) if parts > 1 else corpus, queries, QUERY_ROWS)
    return pairs.mapInArrow(run, "q long, id long, score double" + ", product double" * product)


def best_scores(queries: DataFrame, corpus: DataFrame, k: int, encoding: str = "float") -> DataFrame:
    """(q, id, score, rank): of the pairs of ``all_scores``, the ``k`` best of each query; ties go to the smaller id. NaN is
    the largest score, null the smallest, as in SQL.

    Each task meets a block of queries with one of at most ``PARTS`` parts of the corpus, keeps its k best of a query and
    sends nothing else, so what is shuffled grows with the tables and not with their pairs. The corpus crosses in packed
    rows: a Cartesian product copies the block beside each of its rows."""
    positive_int(k, "k")
    metric = {"float": "cosine"}.get(encoding, encoding)
    if metric not in ("cosine", "int8", "binary"):
        raise ValidationError("encoding", f"unknown: {encoding}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int, _Best]] = {}
        for block, names, vectors, rows in meetings(batches):
            if block not in held:
                x, known = _matrix(vectors, None)
                held[block] = _ready(x, metric) if known.any() else x, x.shape[1], _Best(names, known, k)
            a, dim, best = held[block]
            step = max(1, PAIRS // len(names))
            for ids, x in _unpacked(rows, dim if best.known.any() else None):
                for lo in range(0, len(ids), step):
                    some = ids[lo : lo + step]
                    best.add(some, np.full((len(some), len(names)), -np.inf) if x is None else _scores(_ready(x[lo : lo + step].astype(np.float64), metric), a, metric))
        for _, _, best in held.values():
            yield best.rows()

    parts = min(PARTS, -(-corpus.count() // CORPUS_ROWS))
    packed = _doubles(corpus, "id").mapInArrow(_pack, "ids binary, v binary, single binary")
    met = _beside(packed.repartition(parts) if parts > 1 else packed.coalesce(1), queries, QUERY_ROWS)
    return ranked(met.mapInArrow(run, "q long, id long, score double, key double"), k, order=(F.col("key").desc(), F.col("id").asc())).drop("key")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, v, single) of rows (id, v): numbers and vectors of several rows as bytes. Vectors stand in ``single`` where that
    keeps their values, else in ``v``; both are null for vectors that are null."""
    for batch in batches:
        there = batch.column(1).is_valid()
        ids, x = batch.column(0).filter(there).to_numpy(), block_of(batch.column(1).drop_null(), None)
        with np.errstate(over="ignore"):
            y = x.astype(np.float32)
        single = np.array_equal(x, y, equal_nan=True)
        none = batch.column(0).filter(batch.column(1).is_null()).to_numpy()
        step = max(1, PACKED // max(8, (4 if single else 8) * x.shape[1]))
        cuts = [(ids[lo : lo + step].tobytes(), (y if single else x)[lo : lo + step].tobytes()) for lo in range(0, len(ids), step)]
        cuts += [(none[lo : lo + PACKED // 8].tobytes(), None) for lo in range(0, len(none), PACKED // 8)]
        columns = [c[0] for c in cuts], [None if single else c[1] for c in cuts], [c[1] if single else None for c in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["ids", "v", "single"])


def _unpacked(rows: pa.RecordBatch, dim: int | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The numbers and the vectors in rows of ``_pack``; None for vectors that are null, or all of them without ``dim``."""
    kinds = [(rows.column(at).is_valid(), at, kind) for at, kind in ((1, np.float64), (2, np.float32))]
    for there, at, kind in [*kinds, (pc.invert(pc.or_(kinds[0][0], kinds[1][0])), 0, None)]:
        if (part := rows.filter(there)).num_rows:
            sizes, ids = _bytes(part.column(0))
            ids = ids.view(np.int64)
            if kind is None or dim is None:
                yield ids, None
                continue
            widths, x = _bytes(part.column(at))
            if (bad := widths * 8 != sizes * dim * np.dtype(kind).itemsize).any():
                raise DimensionError(dim, int(widths[bad][0] * 8 // (sizes[bad][0] * np.dtype(kind).itemsize)), "vector")
            yield ids, x.view(kind).reshape(len(ids), dim)


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The number of bytes of each row, and those of all rows."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        return np.diff(offsets), np.empty(0, dtype=np.uint8)
    return np.diff(offsets), np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]


class _Best:
    """The k best (id, score) of each query so far, by the score rounded to nine decimals and the id."""

    def __init__(self, names: np.ndarray, known: np.ndarray, k: int):
        self.names, self.known, self.k = names, known, k
        self.at, self.key, self.id, self.score = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(len(names), -np.inf)  # key and id of the k-th
        self.last = np.full(len(names), np.iinfo(np.int64).max)
        self.more: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows ``ids`` and their scores (rows x queries); -inf is null."""
        if not self.known.all():
            score[:, ~self.known] = -np.inf
        low = self.least - 2e-9
        if not len(self.at) and len(ids) > self.k:
            low = np.partition(np.where(np.isnan(score), np.inf, score), -self.k, axis=0)[-self.k] - 2e-9
        row, at = np.nonzero(~(score < low))
        found = score[row, at]
        key = np.where(np.isnan(found), np.inf, np.copysign(np.floor(np.abs(found) * 1e9 + 0.5), found) / 1e9)
        some = (key > self.least[at]) | (key == self.least[at]) & (ids[row] <= self.last[at])
        self.more.append((at[some], key[some], ids[row[some]], found[some]))
        if sum(len(m[0]) for m in self.more) >= self.k * len(self.names):
            self.merge()

    def merge(self) -> None:
        at, key, ids, score = (np.concatenate(x) for x in zip((self.at, self.key, self.id, self.score), *self.more, strict=True))
        order = np.lexsort((ids, -key, at))
        begins = np.searchsorted(at[order], np.arange(len(self.names) + 1))
        order = order[np.arange(len(order)) - begins[at[order]] < self.k]
        self.at, self.key, self.id, self.score, self.more = at[order], key[order], ids[order], score[order], []
        ends = np.searchsorted(self.at, np.arange(len(self.names)), side="right") - 1
        full = np.bincount(self.at, minlength=len(self.names)) == self.k
        self.least[full], self.last[full] = self.key[ends[full]], self.id[ends[full]]

    def rows(self) -> pa.RecordBatch:
        """(q, id, score, key)"""
        self.merge()
        none = self.key == -np.inf
        return pa.RecordBatch.from_arrays([pa.array(self.names[self.at]), pa.array(self.id), pa.array(self.score, mask=none), pa.array(self.key, mask=none)], names=["q", "id", "score", "key"])


METRICS = ("cosine", "ip", "l2", "int8", "binary")


def _ready(x: np.ndarray, metric: str) -> np.ndarray:
    """A block in the form that one matrix product compares."""
    if metric == "binary":  # bytes to signs
        bits = np.unpackbits(x.astype(np.uint8), axis=1)
        return bits * 2.0 - 1.0
    return unit_rows(x) if metric == "cosine" else x


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    product = a @ b.T
    if metric == "l2":
        return -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * product, 0))
    if metric == "int8":  # integers below 2^53 throughout, so the products are exact
        scale = np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
        return np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    return product / a.shape[1] if metric == "binary" else product


def top_rows(score: np.ndarray, ids: np.ndarray, names: np.ndarray, k: int | None) -> pa.RecordBatch:
    """(q, id, score) of the k best columns of each row."""
    if k is None:
        at, q = np.tile(np.arange(len(ids)), len(names)), np.repeat(np.arange(len(names)), len(ids))
    else:
        order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k] if len(ids) <= 4 * k else _best(score, ids, k)
        at, q = order.reshape(-1), np.repeat(np.arange(len(names)), order.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(score[q, at])], names=["q", "id", "score"])


def in_query_blocks(queries: DataFrame, corpus: DataFrame, over: Callable[[list], DataFrame], k: int | None) -> DataFrame:
    """The ranked union of ``over(block)`` for blocks of at most ``QUERY_BLOCK`` rows (q, v) of ``queries``.

    One block is a lazy plan. More of them are searched one after another, each result pruned to k rows a query and
    written to the shared folder, so that neither the driver nor the plan grows with the number of queries. A block of
    that size costs far more in products than in reading the corpus again."""
    rows = queries.where("v is not null").select("q", "v").toLocalIterator()
    folder, block = None, list(islice(rows, QUERY_BLOCK))
    first = over(block) if block else None
    while len(block) == QUERY_BLOCK:
        following = list(islice(rows, QUERY_BLOCK))
        if folder is None and not following:
            break
        folder = folder or shared_folder(corpus.sparkSession, "search")
        if block:
            ranked(over(block), k).drop("rank").write.mode("append").parquet(folder)
        block = following
    if folder:
        if block:
            ranked(over(block), k).drop("rank").write.mode("append").parquet(folder)
        return ranked(corpus.sparkSession.read.schema("q long, id long, score double").parquet(folder), k)
    return ranked(first if first is not None else corpus.select(F.lit(None).cast("long").alias("q"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score")).where("false"), k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(q, id, score, rank): the ``k`` best corpus rows (id, v) of each query (q, v); ties go to the smaller id.

    Queries go over the corpus in blocks of ``QUERY_BLOCK``. Each Arrow batch of the corpus keeps its own k best a
    query, so what is shuffled is k rows a query and batch, whatever the corpus. ``metric``: cosine, ip, l2 (score is
    then the negative distance), int8 (cosine of integer vectors) or binary (1 - 2 h / bits of packed bytes). Null
    vectors are left out; zero vectors have cosine 0.
    """
    positive_int(k, "k")
    if metric not in METRICS:
        raise ValidationError("metric", f"unknown: {metric}")

    def over(block: list) -> DataFrame:
        names = np.array([r[0] for r in block], dtype=np.int64)
        raw = np.array([list(r[1]) for r in block], dtype=np.float64)
        a = _ready(raw, metric)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if batch.num_rows:
                    b = _ready(block_of(batch.column(1), raw.shape[1]), metric)
                    yield top_rows(_scores(a, b, metric), batch.column(0).to_numpy(zero_copy_only=False), names, k)

        return corpus.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "q long, id long, score double")

    return in_query_blocks(queries, corpus, over, k)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best columns of each row, ties at the border by id."""
    rounded = np.round(score, 9)
    border = np.partition(rounded, -k, axis=1)[:, -k][:, None]
    out = np.empty((len(score), k), dtype=np.int64)
    for i, row in enumerate(rounded):
        near = np.flatnonzero(row >= border[i])
        out[i] = near[np.lexsort((ids[near], -row[near]))[:k]]
    return out


OPERATORS = {"<->": "l2", "<#>": "ip", "<=>": "cosine"}


def distance(v: Column, query: Column, operator: str = "<->") -> Column:
    """The distance of a vector-database operator: Euclidean, negative inner product, or 1 - cosine."""
    if operator not in OPERATORS:
        raise ValidationError("operator", f"unknown: {operator}")
    if operator == "<->":
        return F.sqrt(F.aggregate(F.zip_with(v, query, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return -V.inner_product(v, query) if operator == "<#>" else 1 - V.cosine_similarity(v, query)


def search_by_vector(table: DataFrame, query: list[float], column: str = "v", operator: str = "<->", k: int = 10, where: Column | str | None = None, tie: str | None = None) -> DataFrame:
    """Rows of ``table`` that pass ``where``, nearest first, with their ``distance``."""
    positive_int(k, "k")
    if column not in table.columns:
        raise ValidationError("column", f"unknown: {column}")
    rows = table if where is None else table.where(where)
    rows = rows.withColumn("distance", distance(F.col(column).cast("array<double>"), F.array(*(F.lit(float(x)) for x in query)), operator))
    order = [F.round("distance", 9).asc(), *([F.col(tie).asc()] if tie else [])]
    return rows.orderBy(*order).limit(k)


def rrf(lists: DataFrame, k: float = 60.0, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (list_id, id, pos, rank?, metadata?) rows, optionally for each ``by``.

    A row adds 1 / (k + rank), its rank or else its 1-based position. Metadata maps merge, later lists win. Ties of the
    score go to what appears first: lowest list, then position.
    """
    by = by or []
    place = F.coalesce(F.col("rank"), F.col("pos")) if "rank" in lists.columns else F.col("pos")
    aggs = [F.sum(1.0 / (F.lit(float(k)) + place)).alias("score"), F.min(F.struct("list_id", "pos")).alias("first")]
    if "metadata" in lists.columns:
        entries = F.array_sort(F.collect_list(F.struct("list_id", "pos", F.map_entries("metadata").alias("e"))))
        none = F.array().cast(f"array<struct<key:{_parts(lists)[0]},value:{_parts(lists)[1]}>>")
        aggs.append(F.flatten(F.transform(entries, lambda x: F.coalesce(x["e"], none))).alias("metadata"))
    out = lists.groupBy(*by, "id").agg(*aggs)
    if "metadata" in out.columns:
        every = F.col("metadata")
        last = F.transform(F.array_distinct(F.transform(every, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"].alias("value")))
        out = out.withColumn("metadata", F.map_from_entries(last))
    order = [F.round("score", 12).desc(), F.col("first").asc()]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).drop("first")


def _parts(lists: DataFrame) -> tuple[str, str]:
    kind = lists.schema["metadata"].dataType
    return kind.keyType.simpleString(), kind.valueType.simpleString()


def rsf(lists: DataFrame, weights: dict[int, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Relative score fusion of (list_id, id, pos, score) rows: scores of each list to [0, 1] (a list of equal scores:
    1), times the list's weight (1 if not named), summed. A missing score is 0."""
    by = by or []
    score = F.coalesce(F.col("score"), F.lit(0.0))
    own = Window.partitionBy(*by, "list_id")
    low, high = F.min(score).over(own), F.max(score).over(own)
    unit = F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))
    weight = F.lit(1.0) if not weights else F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("list_id")].cast("double"), F.lit(1.0))
    out = lists.withColumn("_unit", unit * weight).groupBy(*by, "id").agg(F.sum("_unit").alias("score"), F.min(F.struct("list_id", "pos")).alias("first"))
    order = [F.round("score", 12).desc(), F.col("first").asc()]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).drop("first")


def principal_plane(df: DataFrame, column: str = "v", rounds: int = 10, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, b1, b2): two leading directions by power iteration with deflation on the summed Gram matrix of the
    centred vectors. Partial sums come from the executors; the driver sees one matrix of the dimension squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            col = batch.column(0).drop_null()
            if len(col):
                x = block_of(col, None)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.reshape(-1).tolist()])], names=["n", "s", "g"])

    parts = df.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "n long, s array<double>, g array<double>")
    cells = parts.select("n", F.posexplode(F.concat("s", "g")).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    if not cells:
        raise ValidationError("vectors", "none")
    flat = np.array([r.x for r in sorted(cells, key=lambda r: r.k)])
    n = cells[0].n
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / n
    cov = flat[d:].reshape(d, d) - n * np.outer(mean, mean)
    rng, basis = np.random.default_rng(seed), []
    for _ in range(2):
        b = rng.standard_normal(d)
        for _ in range(rounds):
            b = cov @ b
            for done in basis:
                b -= done * (done @ b)
            b /= max(np.linalg.norm(b), 1e-300)
        basis.append(b)
    return mean, basis[0], basis[1]


def project_2d(v: Column, b1: list[float], b2: list[float]) -> tuple[Column, Column]:
    """Coordinates on two directions."""
    lit = lambda b: F.array(*(F.lit(float(x)) for x in b))
    return V.dot(v, lit(b1)), V.dot(v, lit(b2))


def bundle(df: DataFrame, by: str, column: str = "v", unit: bool = True) -> DataFrame:
    """(by, v): sum of each group's vectors, normalised by default. Sums are taken on values rounded to nine digits, so
    that the order in which partitions arrive does not show."""
    parts = df.select(by, F.posexplode(column).alias("p", "x")).groupBy(by, "p").agg(F.sum(F.col("x").cast("decimal(20,9)")).cast("double").alias("x"))
    out = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("v"))
    return out.withColumn("v", V.normalize(F.col("v"))) if unit else out


def centroids(df: DataFrame, by: str, column: str = "v") -> DataFrame:
    """(by, v): mean of each group's vectors."""
    parts = df.select(by, F.posexplode(column).alias("p", "x")).groupBy(by, "p").agg((F.sum(F.col("x").cast("decimal(20,9)")).cast("double") / F.count("*")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("v"))


def bundle_bytes(df: DataFrame, by: str, column: str = "v") -> DataFrame:
    """(by, v): majority of each bit over the group's byte arrays; ties are 1."""
    bits = df.select(by, F.posexplode(column).alias("p", "b")).select(by, "p", F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("k"), F.col("b").cast("int").alias("b"))
    votes = bits.groupBy(by, "p", "k").agg((F.sum(F.getbit("b", "k").cast("long")) * 2 >= F.count("*")).alias("on"))
    packed = votes.groupBy(by, "p").agg(F.sum(F.when(F.col("on"), F.pow(F.lit(2.0), F.col("k")).cast("int")).otherwise(0)).cast("smallint").alias("x"))
    return packed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("v"))
