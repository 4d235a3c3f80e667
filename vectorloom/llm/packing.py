"""Operator 3: conflict-constrained best-fit packing of documents into token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch, text_slices

#: Pieces that are packed together in one task.
GROUP = 8_000
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class ResidualTree:
    """Bins ordered by the room left. A node knows the AND of the bitmaps below it, so the search for the next bin
    skips every subtree in which all bins conflict."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)  # -1: no bin below
        self.bins: list[dict[int, int]] = [{} for _ in range(capacity + 1)]

    def _up(self, room: int) -> None:
        held, value = self.bins[room], -1
        for bitmap in held.values():
            value &= bitmap
            if not value:
                break
        at = room + self.size
        self.common[at] = value
        at >>= 1
        while at:
            value = self.common[2 * at] & self.common[2 * at + 1]
            if self.common[at] == value:
                break
            self.common[at] = value
            at >>= 1

    def put(self, room: int, name: int, bitmap: int) -> None:
        self.bins[room][name] = bitmap
        self._up(room)

    def take(self, room: int, name: int) -> int:
        bitmap = self.bins[room].pop(name)
        self._up(room)
        return bitmap

    def tightest(self, need: int, bits: int) -> tuple[int, int] | None:
        """(room, name) of the bin with the least room >= need whose bitmap shares no bit with ``bits``; the oldest of
        several; the successor search goes on past bins that conflict."""
        at = need + self.size
        while True:
            if not self.common[at] & bits and self.common[at] != -1:
                if at < self.size:
                    at *= 2
                    continue
                room = at - self.size
                for name, bitmap in self.bins[room].items():
                    if not bitmap & bits:
                        return room, name
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece. Pieces go in the order given; each into the tightest bin that holds no piece of the same
    source or the same cluster, else into a new one. A null source or cluster conflicts with nothing."""
    counts: dict = {}
    for c in clusters:
        if c is not None:
            counts[c] = counts.get(c, 0) + 1
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    offset = len(source_bit)
    cluster_bit = {c: 1 << (offset + i) for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    tree, out = ResidualTree(capacity), []
    bins = 0
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        bits = source_bit.get(source, 0) | cluster_bit.get(cluster, 0)
        found = tree.tightest(length, bits)
        if found is None:
            name, room, bitmap = bins, capacity, 0
            bins += 1
        else:
            room, name = found
            bitmap = tree.take(room, name)
        out.append(name)
        tree.put(room - length, name, bitmap | bits)
    return out


MEASURED = pa.schema([("id", pa.int64()), ("source", pa.string()), ("words", pa.int64()), ("cluster", pa.int64())])


def _map_measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for start, stop in text_slices(batch, "text"):
            part = batch.slice(start, stop - start)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
            begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
            white = _WHITE[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
            first = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
            words = np.diff(np.searchsorted(first, begin))
            clusters = [xxhash.xxh3_64_intdigest(r) - (1 << 63) if r.strip() else None for r in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(clusters, pa.int64())], schema=MEASURED)


PACKED = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("first_word", pa.int64()), ("n_tokens", pa.int64()), ("bin", pa.int64()), ("start", pa.int64())])
PACKED_DDL = "id long, piece int, first_word long, n_tokens long, bin long, start long"


def _map_pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(group: int, rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
            bins = best_fit([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], capacity)
            used: dict[int, int] = {}
            out = []
            for (id_, piece, first, length, _, _), b in zip(rows, bins, strict=True):
                start = used.get(b, 0)
                used[b] = start + length
                out.append((id_, piece, first, length, (group << 24) | b, start))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PACKED, strict=True)], schema=PACKED)

        key, rows = None, []
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != key:
                    if rows:
                        yield pack(key, rows)
                    key, rows = group, []
                rows.append(tuple(row))
        if rows:
            yield pack(key, rows)

    return run


def best_fit_pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Pack every document of ``docs`` into sequences of ``capacity`` tokens.

    A document's tokens are its white-space words and an end token. Documents longer than the capacity are cut into
    pieces of the capacity and a rest. No sequence holds two pieces of one source or of one duplicate cluster
    (``cluster_col``, by default the exact text; null and blank texts and null sources conflict with nothing). Pieces
    are packed by best-fit decreasing in groups of about ``GROUP``, dealt by the hash of id and piece; a group knows no other, so
    every group's sequences are its own. Only ids, lengths and labels are shuffled.

    Returns (id_col, piece int, first_word long, n_tokens long, bin_id long, start long), a row for each piece. Rows
    that share an id are packed each; ids may be null; an empty table gives an empty result; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *([F.col(cluster_col).alias("own")] if cluster_col else []))
    if cluster_col:
        words = F.when(F.length(F.trim("text")) > 0, F.size(F.split(F.trim(F.regexp_replace("text", "[\\t\\n\\x0B\\f\\r ]+", " ")), " "))).otherwise(0)
        rows = base.select("id", "source", words.cast("long").alias("words"), F.when(F.col("own").isNotNull(), F.xxhash64("own")).alias("cluster"))
    else:
        rows = base.select("id", "source", "text").mapInArrow(_map_measure, "id long, source string, words long, cluster long")
    rows = scratch.keep(rows)
    total = rows.agg(F.sum(F.ceil((F.col("words") + 1) / capacity))).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP))
    count = F.ceil((F.col("words") + 1) / capacity).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("words") + 1 - first)
    dealt = pieces.select(F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("long").alias("grp"), "id", "piece", first.alias("first"), length.alias("length"), "source", "cluster")
    packed = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_map_pack(capacity), PACKED_DDL)
    return packed.select(F.col("id").alias(id_col), "piece", "first_word", "n_tokens", F.col("bin").alias("bin_id"), "start")
