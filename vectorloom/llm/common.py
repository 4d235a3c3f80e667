"""Helpers shared by the training-data operators: table access, lineage cutting, text streaming, hashing."""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables in the shared folder: a lineage cut that survives the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_folder(spark, label)
        self.count = 0
        atexit.register(self._delete, self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count:04d}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, read back."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already; leftovers are harmless
            pass


def sample_share(rows: int, wanted: int) -> Callable[..., Column]:
    """A filter on an id column that keeps about ``wanted`` of ``rows`` rows by the hash of the id: the same rows each
    time, without a sort and without more from a partition than its share. All rows if there are no more."""
    if rows <= wanted:
        return lambda *ids: F.lit(True)
    cut = int((1 << 40) * wanted / rows)
    return lambda *ids: F.pmod(F.xxhash64(*ids), F.lit(1 << 40)) < cut


#: The increment and multipliers of the splitmix64 finaliser.
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over a uint64 array (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    """The same for one Python integer."""
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


_BLOCK = 1 << 21
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_powers: list[np.ndarray] = [np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, 1 << 16, min(2 * len(_powers[0]), _BLOCK + (1 << 16)))  # a few texts on the driver need little
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None], drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words start (one entry more).

    A-Z are lower-cased; words are runs of bytes other than space and 0x09 to 0x0D. Each word's hash is a
    difference of running polynomial sums over the bytes, taken for a block of texts at once. A null text has no words.
    Bytes in ``drop`` are left out first.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    if drop:
        raw = [r.translate(None, drop) for r in raw]
    begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    joined = np.frombuffer(b"\n".join([*raw, b""]).lower(), dtype=np.uint8)
    del raw
    hashes, places, at = [], [], 0
    while at < len(joined):
        stop = min(len(joined), at + _BLOCK)
        if stop < len(joined):  # cut behind white space
            white = np.flatnonzero(_WHITE[joined[at:stop]])
            while not len(white):
                white = np.flatnonzero(_WHITE[joined[stop : stop + _BLOCK]]) + stop - at
                stop = min(len(joined), stop + _BLOCK)
            stop = at + int(white[-1]) + 1
        block = joined[at:stop]
        power, inverse = _power_tables(len(block) + 1)
        inside = ~_WHITE[block]
        step = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_LETTERS[block] * power[: len(block)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = stop
    flat = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    return flat, np.searchsorted(np.concatenate(places) if places else np.empty(0, dtype=np.int64), begin)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch whose texts hold about ``limit`` characters at most (one row at least)."""
    rows = batch.num_rows
    if not rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def local_forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over pairs of ids: (id, smallest id reachable) for every id that is not its own root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    return np.array(nodes, dtype=np.int64), np.array([find(x) for x in nodes], dtype=np.int64)


EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


#: Edges that a task contracts at once; its memory does not grow with the partition.
FOREST = 1 << 19


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def forest(held: list) -> pa.RecordBatch:
        src, dst = local_forest(held)
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], schema=EDGES)

    held: list = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= FOREST:
            yield forest(held)
            held = []
    yield forest(held)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long); component: the smallest node reachable.

    Each partition first contracts its edges to a forest, then as many of these forests together as have about ``FOREST``
    edges, so that few rounds are left. Then alternating large-star and small-star rounds, made of a partial minimum
    per node and a join that AQE can split, until the edge set no longer changes.
    Nothing is collected but two counters a round. Self loops and repeated edges are ignored; without edges the
    result is empty.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    now = scratch.keep(edges.mapInArrow(_contract, "src long, dst long"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    parts = -(-now.count() // FOREST)
    if parts:
        first, now = now, scratch.keep(now.coalesce(parts).mapInArrow(_contract, "src long, dst long"))
        scratch.drop(first)
    seen = mark(now)
    while seen[0]:
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # written, so that the join deals both sides anew and AQE can split a hub's edges
        least = scratch.keep(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        after = scratch.keep(small.select("e.*").where("src <> dst").distinct())
        scratch.drop(least)
        scratch.drop(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
