"""Operator 7: Hilbert-curve ordering and cutting into shards. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import Scratch

DIMS, BITS = 3, 5


def curve_tables(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """(next state, curve digit) by state * 2^dims + cell, derived from the reflected Gray code.

    A state is an entry corner and a direction of the subcube: entry * dims + direction.
    """
    cells = 1 << dims

    def turn(x: int, by: int) -> int:  # rotate left
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (cells - 1)

    def gray(w: int) -> int:
        return w ^ (w >> 1)

    def trailing_ones(w: int) -> int:
        return (~w & (w + 1)).bit_length() - 1

    rank = {gray(w): w for w in range(cells)}
    following, digit = [], []
    for state in range(cells * dims):
        entry, direction = divmod(state, dims)
        for cell in range(cells):
            w = rank[turn(cell ^ entry, dims - (direction + 1) % dims)]
            corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            axis = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % dims
            following.append((entry ^ turn(corner, direction + 1)) * dims + (direction + axis + 1) % dims)
            digit.append(w)
    return following, digit


def curve_index(x: str, y: str, z: str, bits: int = BITS) -> str:
    """SQL for the Hilbert index of three integer columns of ``bits`` bits."""
    following, digit = curve_tables()
    cell = f"((shiftright({x}, i) & 1) + 2 * (shiftright({y}, i) & 1) + 4 * (shiftright({z}, i) & 1))"
    at = f"[a.s * 8 + {cell}]"
    tables = [f"array({', '.join(map(str, t))})" for t in (following, digit)]
    steps = ", ".join(str(i) for i in reversed(range(bits)))
    return f"aggregate(array({steps}), named_struct('s', 0, 'h', 0), (a, i) -> named_struct('s', {tables[0]}{at}, 'h', a.h * 8 + {tables[1]}{at}), a -> a.h)"


def _ranked(rows: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` written in the order of ``key``, with ``rank`` from 0 and ``total``: a range exchange sorts, and the rows
    of each partition are counted, so no task holds more than a partition."""
    ordered = scratch.keep(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # one row a partition
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(counts), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before", "place")


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source"), scratch: Scratch | None = None) -> DataFrame:
    """Every document in one of ``shards`` runs of a Hilbert curve; law ``rows``: counts at most one apart.

    The dimensions are two metadata columns (as strings, null as the empty one) and the binary logarithm of the size
    (UTF-8 bytes of the text plus 8; null text: 8). Each is quantised to ``BITS`` bits by the rank of its value among
    the distinct ones, so order is kept and up to 2^BITS values have cells of their own. Equal texts take the cell of
    the copy with the smallest id and stand together, so a group is cut at shard borders only. The total order is (curve
    index, smallest id of the group, id): a range exchange sorts it, each partition's row count gives the ranks, and a
    border falls after every 1/shards of the rows. Slim rows are shuffled, never texts; no key, however frequent, has to
    fit into one task, since ids break every tie.

    Returns (id_col, size long, text_crc32 long, law string, shard int, slot long, grown_shard int (null under this
    law), curve long). Null text: CRC 0, and all null texts are one group. Ids are distinct integers (null ids sort
    first). Other columns are ignored; an empty table gives an empty result; with fewer rows than shards some
    shards are empty.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    value = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in dims]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.coalesce(F.crc32(F.encode(text_col, "UTF-8")), F.lit(0)).cast("long").alias("crc"), F.xxhash64(text_col, F.isnull(text_col)).alias("content"), value[0].alias("v0"), value[1].alias("v1"))
    rows = scratch.keep(rows.withColumn("v2", F.expr("lpad(length(bin(size)), 2, '0')")))
    values = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.col(f"v{k}").alias("value")) for k in range(DIMS)))).alias("e")).select("e.*").distinct()
    values = _ranked(values, ["dim", "value"], scratch)
    spans = values.groupBy("dim").agg(F.min("rank").alias("least"), F.count("*").alias("n"))  # one row a dimension
    cells = scratch.keep(values.join(F.broadcast(spans), "dim").select("dim", "value", F.expr(f"cast((rank - least) * {1 << BITS} div n as int)").alias("cell")))
    group = rows.groupBy("content", "size", "crc").agg(F.min(F.struct("id", "v0", "v1", "v2")).alias("first")).select("content", "size", "crc", "first.*")
    for k in range(DIMS):
        group = group.join(cells.where(F.col("dim") == k).select(F.col("value").alias(f"v{k}"), F.col("cell").alias(f"c{k}")), f"v{k}")
    # written, so that the join deals both sides anew and AQE can split a large group of copies
    group = scratch.keep(group.select("content", "size", "crc", F.col("id").alias("first"), F.expr(curve_index("c0", "c1", "c2")).cast("long").alias("curve")))
    ordered = rows.select("id", "size", "crc", "content").join(group, ["content", "size", "crc"]).select("curve", "first", "id", "size", "crc")
    cut = _ranked(ordered, ["curve", "first", "id"], scratch).withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    slot = F.expr(f"rank - (cast(shard as bigint) * total + {shards - 1}) div {shards}")
    return cut.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def oracle(shards: int = 24) -> str:
    """DuckDB SQL for the same rows."""
    following, digit = curve_tables()
    crc_table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    steps = []
    for k, i in enumerate(reversed(range(BITS))):
        cell = f"(s * 8 + ((x >> {i}) & 1) + 2 * ((y >> {i}) & 1) + 4 * ((z >> {i}) & 1) + 1)"
        steps.append(f"h{k + 1} AS (SELECT * REPLACE ({following}[{cell}] AS s, h * 8 + {digit}[{cell}] AS h) FROM h{k})")
    cell = lambda v: f"CAST((dense_rank() OVER (ORDER BY {v}) - 1) * {1 << BITS} // (SELECT count(DISTINCT {v}) FROM doc) AS INTEGER)"
    return f"""
WITH doc AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(octet_length(encode(text)), 0) + 8 AS size, length(bin(coalesce(octet_length(encode(text)), 0) + 8)) AS log FROM documents),
t AS (SELECT CAST({crc_table} AS BIGINT[]) AS crc_table),
base AS (SELECT doc_id, text, size, {cell("lang")} AS x, {cell("source")} AS y, {cell("log")} AS z FROM doc),
texts AS (SELECT text, hex(encode(text)) AS b, any_value(size) AS size, min(doc_id) AS first FROM base GROUP BY text),
crcs AS (SELECT text, first, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 8), lambda k: CAST('0x' || b[2 * k + 1 : 2 * k + 2] AS BIGINT))), lambda c, v: xor(c >> 8, crc_table[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM texts, t),
h0 AS (SELECT c.text, c.first, c.crc, b.x, b.y, b.z, 0 AS s, 0 AS h FROM crcs c JOIN base b ON b.doc_id = c.first),
{", ".join(steps)},
ranked AS (SELECT b.doc_id, b.size, coalesce(g.crc, 0) AS crc, CAST(g.h AS BIGINT) AS curve, row_number() OVER (ORDER BY g.h, g.first, b.doc_id) - 1 AS rank, count(*) OVER () AS total FROM base b JOIN h{BITS} g ON b.text IS NOT DISTINCT FROM g.text),
cut AS (SELECT *, rank * {shards} // total AS shard FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rank - (shard * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM cut"""
