"""Operator 10: exact n-gram Jaccard self-join over a prefix tree.

A document is its set of distinct word n-grams, hashed to 64 bits. One global order holds for all sets: n-grams that few
documents share come first (by class of document frequency, then by hash). The join has three parts, none of which
loses a link.

Sieve. Sets linked at num/den share at least ceil(size * num / den) n-grams with each other, so a set with more
n-grams of its own than the rest, found in no other set, links with nothing. A share of the hash space (``SLACK`` times
1 - num/den) suffices to show that for most documents: its n-grams are dealt by hash, those that meet no other set are
counted, and documents with too many of them are done. Equal sets go on as one class.

Order. All n-grams of the remaining classes are counted over those classes; n-grams of a single class cannot overlap
and leave the sets, but count in their sizes. The first size - ceil(size * num / den) + 1 n-grams in the global order
are a set's prefix; linked sets share one of them. Classes that share prefix n-grams form candidate components. A
component of up to ``CHUNK`` sets is one block. A larger one is cut by size and hash into chunks, and a set goes to the
block of its chunk with another only if it shares a prefix n-gram with a set of that chunk, so what is sent grows with
the candidates and not with the component; sets with rare n-grams only never meet through frequent ones.

Join. Inside a block the ordered sets form a trie (the frequent end of the global order first, where paths are shared).
It is traversed once for all queries of the block: the overlap of a path prefix is counted once for every document below
it, and a query leaves a subtree as soon as its overlap plus the smaller of what remains of the query and of the longest
path below cannot reach the required overlap, or when no size in the subtree can match.

Equal 64-bit hashes count as equal n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch, connected_components, local_forest, mix, mix_int, text_slices, word_hashes

#: Sets that a candidate component holds before it is cut; sets and elements in a chunk at most. Between them, chunks grow
#: with the square root of the component, so that both the blocks and the copies of a set stay few.
CHUNK, CHUNK_SETS, CHUNK_ELEMENTS = 64, 1000, 400_000
#: Share of the hash space that the sieve reads, over the share of a set that may differ.
SLACK = 1.6


class Threshold:
    """Exact integer forms of Jaccard >= num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must lie above 0 and not above 1")
        self.num, self.den = num, den

    def needed(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size):
        """How many elements of a set's global order are sure to hold one of every linked set's."""
        return size + self.num * size // -self.den + 1

    def size_classes(self) -> list[int]:
        """First sizes of classes up to 2^40, so that linked sets lie in the same or in adjacent ones."""
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, starts[-1] * self.den // self.num + 1))
        return starts

    def sieve_end(self) -> int:
        """The sieve reads hashes below this."""
        return min((1 << 64) - 1, int(SLACK * (1 + 1 / 32) * (self.den - self.num) / self.den * (1 << 64)) + (1 << 59))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of the word n-grams of each text.

    A-Z are lower-cased and words are runs of bytes other than space and 0x09 to 0x0D. A text of fewer than n words
    gives its whole sequence as one element; null, empty or blank texts give an empty set.
    """
    flat, starts = word_hashes(texts)
    with np.errstate(over="ignore"):
        step = np.uint64(0x2000002000367)
        acc = flat.copy()
        for j in range(1, n):
            acc[: len(flat) - j] = acc[: len(flat) - j] * step + flat[j:]
        acc = mix(acc + np.uint64(n))
        out = []
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if end - at >= n:
                own = np.sort(acc[at : end - n + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif end > at:
                h = mix_int(end - at)
                for w in flat[at:end].tolist():
                    h = mix_int(h ^ w)
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set; equal sets have equal marks."""
    with np.errstate(over="ignore"):
        return tuple(np.array([mix(s if k == 0 else ~s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64) for k in (0, 1))


#: info is null for an n-gram of one set of the slice, empty for one of several, else size, marks, and n-grams read and shared.
SIEVE = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("info", pa.binary())])
SIEVE_DDL = "key long, node long, info binary"
SEEN_DDL = "node long, shared long, size long, h1 long, h2 long, seen long"
SEEN = pa.schema([(name, pa.int64()) for name in ("node", "shared", "size", "h1", "h2", "seen")])


def _map_sieve(n: int, end: int):
    """The n-grams of each distinct set of a slice below ``end``, and a row of facts for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, "text"):
                ids = batch.column(0).slice(start, stop - start).to_numpy()
                sets = shingle_sets(batch.column(1).slice(start, stop - start).to_pylist(), n)
                h1, h2 = _marks(sets)
                facts = np.zeros((len(sets), 5), dtype=np.int64)
                facts[:, 0] = [len(s) for s in sets]
                facts[:, 1], facts[:, 2] = h1.view(np.int64), h2.view(np.int64)
                # equal sets of the slice go on once; -1 read n-grams tell that nothing was counted for the others
                first = {key: i for i, key in reversed(list(enumerate(zip(facts[:, 0].tolist(), h1.tolist(), h2.tolist(), strict=True))))}
                lead = np.array(sorted(first.values()), dtype=np.int64)
                read = [sets[i][: np.searchsorted(sets[i], np.uint64(end))] for i in lead]
                facts[:, 4] = -1
                facts[lead, 4] = [len(r) for r in read]
                flat = np.concatenate(read) if read else np.empty(0, dtype=np.uint64)
                owner = np.repeat(np.arange(len(lead)), facts[lead, 4])
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, dtype=np.int64)
                runs = np.diff(np.append(at, len(flat)))
                facts[lead, 3] = np.bincount(owner[np.repeat(runs > 1, runs)], minlength=len(lead))
                key = np.concatenate([flat[at], mix(ids.view(np.uint64))])
                node = np.concatenate([ids[lead][owner[at]] if len(at) else np.empty(0, dtype=np.int64), ids])
                info = [None] * len(at)
                for k in np.flatnonzero(runs > 1).tolist():
                    info[k] = b""
                info += [f.tobytes() for f in facts]
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(node), pa.array(info, type=pa.binary())], schema=SIEVE)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: for each document how many of its n-grams other sets hold too; facts pass."""

    def counted(nodes: np.ndarray) -> pa.RecordBatch:
        own, many = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(many), *(pa.nulls(len(own), pa.int64()) for _ in range(4))], schema=SEEN)

    last_key, last_node, last_many = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        kind = pc.fill_null(pc.binary_length(batch.column(2)), -1).to_numpy(zero_copy_only=False)
        if (told := kind > 0).any():
            facts = np.frombuffer(b"".join(batch.column(2).filter(pa.array(told)).to_pylist()), dtype=np.int64).reshape(-1, 5)
            size, h1, h2, shared, seen = (np.ascontiguousarray(facts[:, k]) for k in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[told], shared, size, h1, h2, seen)], schema=SEEN)
            key, node, kind = key[~told], node[~told], kind[~told]
        if not len(key):
            continue
        many = np.concatenate([last_many, kind == 0])  # such a row stands for several sets that are counted already
        key, node = np.concatenate([last_key, key]), np.concatenate([last_node, node])
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.append(at, len(key)))
        met = (runs > 1) | (np.add.reduceat(many, at, dtype=np.int64) > 0)
        # the last run may go on in the next batch; if it has met, its own rows are counted here
        last_key, last_node, last_many = key[-1:], node[-1:], met[-1:].copy()
        yield counted(node[np.repeat(met, runs) & ~many])


POSTINGS = pa.schema([("h", pa.int64()), ("rep", pa.int64())])


def _map_postings(n: int):
    """All n-grams of the remaining classes; a row whose set is not the class's (a repeated id) gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, "text"):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column("text").to_pylist(), n)
                h1, h2 = (m.view(np.int64) for m in _marks(sets))
                own = (h1 == part.column("h1").to_numpy()) & (h2 == part.column("h2").to_numpy())
                kept = [s if o else s[:0] for s, o in zip(sets, own, strict=True)]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(kept)), pa.array(np.repeat(part.column("rep").to_numpy(), [len(s) for s in kept]))], schema=POSTINGS)

    return run


ORDERED_DDL = "rep long, size long, copies long, path binary, ranks binary, tokens array<long>"
ORDERED = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("copies", pa.int64()), ("path", pa.binary()), ("ranks", pa.binary()), ("tokens", pa.list_(pa.int64()))])


def _order(num: int, den: int):
    """Rows sorted by class: sets in the global order with the n-grams of their prefix; classes without a link stay out.

    Input (rep, rank, h): rank -2 tells the number of copies, -1 the size, others the frequency class of n-gram h.
    """
    limit = Threshold(num, den)

    def ordered(rep: np.ndarray, rank: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((h, rank, rep))
        rep, rank, h = rep[order], rank[order], h[order]
        fresh = np.concatenate(([True], (rep[1:] != rep[:-1]) | (rank[1:] != rank[:-1]) | (h[1:] != h[:-1])))
        rep, rank, h = rep[fresh], rank[fresh], h[fresh]
        at = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1])))
        out = []
        for lo, hi in zip(at.tolist(), np.append(at[1:], len(rep)).tolist(), strict=True):
            copies, size, path = int(h[lo].view(np.int64)), int(h[lo + 1].view(np.int64)), h[lo + 2 : hi]
            reach = limit.prefix(size) - (size - len(path))
            if reach > 0 and len(path):
                out.append((int(rep[lo]), size, copies, path.astype("<u8").tobytes(), rank[lo + 2 : hi].astype(np.uint8).tobytes(), path[:reach].view(np.int64).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), ORDERED, strict=True)] if out else [pa.array([], type=f.type) for f in ORDERED], schema=ORDERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if held and cols[0][-1] == held[0][0][0]:
                held.append(cols)
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held.append(tuple(c[:cut] for c in cols))
            if sum(len(c[0]) for c in held):
                yield ordered(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield ordered(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def trie_join(sets: list[np.ndarray], limit: Threshold, left: np.ndarray | None = None, sizes: np.ndarray | None = None, ranks: list[np.ndarray] | None = None, budget: int = 24_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of ``sets`` that reach the threshold; with ``left`` (booleans), only pairs of one left and
    one other set. ``sizes``: the sizes to judge by, where sets lack elements that no other set holds; ``ranks``: the
    frequency class of each element, for the global order. Empty sets match nothing."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    sizes = lengths if sizes is None else sizes
    found_q: list[np.ndarray] = []
    found_s: list[np.ndarray] = []
    if len(sets) < 2 or not lengths.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    values, where, inverse, counts = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    # elements of one set only cannot overlap; the others keep the global order, the frequent ones first
    order = np.lexsort((values, -(np.concatenate(ranks)[where].astype(np.int64)) if ranks else np.zeros(len(values)), counts < 2))
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    shared = int((counts >= 2).sum())
    paths, at = [], 0
    for size in lengths:
        r = rank[inverse[at : at + size]]
        paths.append(np.sort(r[r < shared]))
        at += size
    del values, where, inverse, counts, order, rank
    lengths, filled = np.array([len(p) for p in paths], dtype=np.int64), lengths
    docs = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
    docs = [i for i in docs if filled[i]]
    if not docs or not shared:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    # common prefix of neighbours: with it, the sorted list is the trie
    lcp = np.zeros(len(docs) + 1, dtype=np.int64)
    for k in range(1, len(docs)):
        a, b = paths[docs[k - 1]], paths[docs[k]]
        w = min(len(a), len(b))
        differ = np.flatnonzero(a[:w] != b[:w])
        lcp[k] = differ[0] if len(differ) else w
    doc_at, doc_size, doc_len = np.array(docs), sizes[docs], lengths[docs]
    queries = np.array([i for i in docs if left is None or left[i]], dtype=np.int64)
    width = max(16, budget // shared)
    for lo in range(0, len(queries), width):
        q = queries[lo : lo + width]
        has = np.zeros((shared, len(q)), dtype=np.uint8)
        for k, i in enumerate(q):
            has[paths[i], k] = 1
        q_size, q_len = sizes[q], lengths[q]
        stack = [(0, len(docs), 0, np.arange(len(q)), np.zeros(len(q), dtype=np.int32))]
        while stack:
            a, b, depth, active, overlap = stack.pop()
            end = int(lcp[a + 1 : b].min()) if b - a > 1 else int(doc_len[a])
            s_low, s_high, longest = doc_size[a:b].min(), doc_size[a:b].max(), int(doc_len[a:b].max())
            path = paths[docs[a]]
            size_q = q_size[active]
            fits = (s_high * limit.den >= limit.num * size_q) & (s_low * limit.num <= limit.den * size_q)
            need = limit.needed(size_q, np.maximum(s_low, -(-limit.num * size_q // limit.den)))
            while True:
                fits &= overlap + np.minimum(longest - depth, q_len[active] - overlap) >= need
                if not fits.all():
                    active, overlap, need = active[fits], overlap[fits], need[fits]
                    fits = np.ones(len(active), dtype=bool)
                if depth >= end or not len(active):
                    break
                step = path[depth : min(end, depth + 64)]
                block = has[step] if len(active) == len(q) else has[np.ix_(step, active)]
                overlap = overlap + block.sum(axis=0, dtype=np.int32)
                depth += len(step)
            if not len(active):
                continue
            k = a
            while k < b and doc_len[k] == end:  # sets that end here
                i, s = docs[k], doc_size[k]
                hit = overlap >= limit.needed(q_size[active], s)
                other = q[active[hit]]
                if left is not None:
                    other = other[:0] if left[i] else other
                else:
                    other = other[other < i]
                if len(other):
                    found_q.append(other)
                    found_s.append(np.full(len(other), i, dtype=np.int64))
                k += 1
            while k < b:  # children
                inside = np.flatnonzero(lcp[k + 1 : b] <= end)
                stop = k + 1 + int(inside[0]) if len(inside) else b
                stack.append((k, stop, end, active, overlap))
                k = stop
    del doc_at
    if not found_q:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    one, two = np.concatenate(found_q), np.concatenate(found_s)
    return np.minimum(one, two), np.maximum(one, two)


LINKS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])


def _join_blocks(num: int, den: int):
    """Rows sorted by block: links found, as a forest (kind 0: node, node) and as counts (kind 1: node, documents linked)."""
    limit = Threshold(num, den)

    def block(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch | None:
        nodes, sizes, copies, chunk = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        sets = [np.frombuffer(r[4], dtype="<u8") for r in rows]
        x, y = trie_join(sets, limit, None if i == j else chunk == i, sizes, [np.frombuffer(r[5], dtype=np.uint8) for r in rows])
        if not len(x):
            return None
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        src, dst = local_forest([(nodes[x], nodes[y])])
        hit = links > 0
        kind = np.concatenate([np.zeros(len(src), dtype=np.int8), np.ones(int(hit.sum()), dtype=np.int8)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([src, nodes[hit]])), pa.array(np.concatenate([dst, links[hit]]))], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("component", "i", "j", "rep", "size", "copies", "chunk", "path", "ranks")]
            for component, i, j, *row in zip(*cols, strict=True):
                if (component, i, j) != key:
                    if key and (out := block(key[1], key[2], rows)):
                        yield out
                    key, rows = (component, i, j), []
                rows.append(tuple(row))
        if key and (out := block(key[1], key[2], rows)):
            yield out

    return run


def _candidate_blocks(active: DataFrame, limit: Threshold, scratch: Scratch) -> DataFrame:
    """(rep, component, chunk, i, j): the blocks in which each set meets every other that shares a prefix n-gram."""
    tokens = active.select("rep", F.explode("tokens").alias("token"))
    # written, so that the join deals both sides anew and AQE can split a frequent n-gram
    lead = scratch.keep(tokens.groupBy("token").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("token", "lead"))
    comps = connected_components(tokens.join(lead, "token").where("rep <> lead").select(F.col("rep").alias("src"), F.col("lead").alias("dst")).distinct(), scratch)
    klass = F.size(F.filter(F.array(*(F.lit(s) for s in limit.size_classes())), lambda s: s <= F.col("size")))
    placed = scratch.keep(active.select(F.col("rep").alias("node"), klass.cast("long").alias("klass"), (F.octet_length("path") / 8).cast("long").alias("elements")).join(comps, "node"))
    stats = placed.groupBy("component", "klass").agg(F.count("*").alias("sets"), F.sum("elements").alias("elements"))
    whole = stats.groupBy("component").agg(F.sum("sets").alias("all_sets"), F.sum("elements").alias("all_elements")).where("all_sets > 1")
    big = (F.col("all_sets") > CHUNK) | (F.col("all_elements") > CHUNK_ELEMENTS)
    wide = F.least(F.lit(CHUNK_SETS), F.greatest(F.lit(CHUNK), F.ceil(1.6 * F.sqrt("all_sets"))))
    parts = F.greatest(F.ceil(F.col("sets") / wide), F.ceil(F.col("elements") / CHUNK_ELEMENTS))
    groups = scratch.keep(stats.join(whole, "component").select("component", "klass", big.alias("big"), parts.alias("parts")))
    chunk = F.when(F.col("big"), F.col("klass") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    spots = scratch.keep(placed.join(groups, ["component", "klass"]).select(F.col("node").alias("rep"), "component", "big", chunk.alias("chunk")))
    alone = spots.where("not big").select("rep", "component", "chunk", F.col("chunk").alias("other"))
    # for large components: the chunks that share an n-gram with a set, one row an n-gram and one a set whatever the group
    large = tokens.join(spots.where("big").select("rep", "component", "chunk"), "rep")
    held = scratch.keep(large.groupBy("token", "component").agg(F.collect_set("chunk").alias("chunks")).where(F.size("chunks") > 1))
    met = large.join(held, ["token", "component"]).groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_set("chunks"))).alias("chunks"))
    near = spots.where("big").join(met, "rep", "left").withColumn("other", F.explode(F.array_union(F.array("chunk"), F.coalesce("chunks", F.array().cast("array<long>")))))
    near = near.where(F.abs(F.shiftright("chunk", 32) - F.shiftright("other", 32)) <= 1).select("rep", "component", "chunk", "other")
    return alone.unionAll(near).select("rep", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents of ``docs`` with the components of the graph that links n-gram sets of Jaccard >= num/den.

    Returns (id_col, n_shingles long, class_id long, n_links long, component_id long): class_id is the smallest id with the same
    set, n_links the number of other documents linked directly, component_id the smallest id reachable by links,
    itself included. Null, empty or blank texts have n_shingles 0, no links, and their own id as class and component.
    Rows with a null id are left out; of rows that share an id the one with the largest set counts. Other columns are
    ignored, an empty table gives an empty result. Equal texts form a class and are joined once.
    """
    limit = Threshold(num, den)
    scratch = Scratch(docs.sparkSession, "ngram")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    met = base.mapInArrow(_map_sieve(n, limit.sieve_end()), SIEVE_DDL).repartition("key").sortWithinPartitions("key").mapInArrow(_meet, SEEN_DDL)
    facts = F.when(F.col("size").isNotNull(), F.struct("size", "h1", "h2", "seen"))
    info = scratch.keep(met.groupBy("node").agg(F.max(facts).alias("f"), F.sum("shared").alias("shared")).select("node", "f.*", "shared"))
    own = F.when(F.col("seen") >= 0, F.col("seen") - F.col("shared"))
    classes = scratch.keep(info.where("size > 0").groupBy("size", "h1", "h2").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.coalesce(F.min(own), F.lit(0)).alias("own")))
    left = scratch.keep(classes.where(F.col("own") < F.col("size") - F.ceil(F.col("size") * num / den) + 1).select("rep", "copies", "size", "h1", "h2"))
    texts = base.join(left.hint("shuffle_hash"), base.id == left.rep).select("rep", "h1", "h2", "text")
    post = scratch.keep(texts.mapInArrow(_map_postings(n), "h long, rep long"))
    freq = post.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.least(F.floor(F.log2("n") * 4), F.lit(255)).cast("int").alias("rank"))
    shared = post.join(scratch.keep(freq).hint("shuffle_hash"), "h").select("rep", "rank", "h")
    told = left.select("rep", F.explode(F.array(F.struct(F.lit(-2).alias("rank"), F.col("copies").alias("h")), F.struct(F.lit(-1).alias("rank"), F.col("size").alias("h")))).alias("t")).select("rep", "t.rank", "t.h")
    active = scratch.keep(shared.unionAll(told).repartition("rep").sortWithinPartitions("rep").mapInArrow(_order(num, den), ORDERED_DDL))
    scratch.drop(post)
    blocks = active.drop("tokens").join(_candidate_blocks(active, limit, scratch), "rep")
    links = scratch.keep(blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_join_blocks(num, den), "kind byte, a long, b long"))
    comps = connected_components(links.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
    counts = links.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    by_class = scratch.keep(classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("size", "h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    found = info.where("size > 0").join(by_class, ["size", "h1", "h2"]).select(F.col("node").alias(id_col), F.col("size").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    empty = info.where("size = 0").select(F.col("node").alias(id_col), F.col("size").alias("n_shingles"), F.col("node").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"))
    return found.unionAll(empty)


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns. Rows without an id have
    no component and stay; rows that share an id stay or go together; documents without words are alone and stay. An
    empty table gives an empty one."""
    joined = ngram_jaccard_join(docs, n, num, den, id_col, text_col)
    first = joined.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col))
    kept = docs.join(first.hint("shuffle_hash"), id_col, "left_semi").select(*docs.columns)
    return kept.unionAll(docs.where(F.col(id_col).isNull()))


def oracle(n: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB SQL for the rows of ``ngram_jaccard_join`` over ``documents``: all pairs that share an n-gram, and the
    closure of the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING {den} * count(*) >= {num} * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS far FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.far)
SELECT c.doc_id, CAST(len(c.s) AS BIGINT) AS n_shingles, c.class_id, (SELECT count(*) FROM l WHERE l.a = c.doc_id) AS n_links, m.component_id
FROM c JOIN (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)"""
