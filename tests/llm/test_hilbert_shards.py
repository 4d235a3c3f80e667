import zlib

import duckdb

from vectorloom.llm import hilbert_shards as H


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        following, digit = H.curve_tables(dims)
        place = {}
        for code in range(1 << dims * bits):
            point = [code >> (d * bits) & ((1 << bits) - 1) for d in range(dims)]
            state = index = 0
            for i in reversed(range(bits)):
                cell = sum((p >> i & 1) << d for d, p in enumerate(point))
                state, index = following[state << dims | cell], index << dims | digit[state << dims | cell]
            place[index] = point
        assert sorted(place) == list(range(1 << dims * bits))
        assert all(sum(abs(a - b) for a, b in zip(place[k], place[k + 1], strict=True)) == 1 for k in range(len(place) - 1))


DOCS = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 50), f"l{i % 4}", f"s{i % 7}") for i in range(500)] + [(900, None, None, None), (901, None, "l1", "s1"), (902, "", "l0", None), (903, "é" * 100_000, "l2", "s2")]


def test_law_and_contract(spark):
    df = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, lang string, source string, size int").repartition(5)
    rows = H.hilbert_shards(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in DOCS)
    text = {d[0]: d[1] for d in DOCS}
    shards: dict = {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(24))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    places = [k for k, r in enumerate(order) if text[r.doc_id] == "copy"]
    assert places == list(range(places[0], places[0] + len(places)))  # equal texts stand together


def test_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", DOCS[:100] + DOCS[500:503])
    cur = con.execute(H.oracle())
    names = [d[0] for d in cur.description]
    df = spark.createDataFrame(DOCS[:100] + DOCS[500:503], "doc_id long, text string, lang string, source string")
    assert sorted(map(repr, map(tuple, H.hilbert_shards(df).select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", "l", "s"), (1, "a", "l", "s"), (2, "b", "l", "s")], "doc_id long, text string, lang string, source string")
    rows = H.hilbert_shards(df).collect()
    assert len(rows) == 3 and all(r.slot == 0 for r in rows) and len({r.shard for r in rows}) == 3
    assert H.hilbert_shards(df.limit(0)).count() == 0


def test_min_and_max_rule_most_shards_out(spark):
    """A source, a language or a size class lies in under half of the shards' ranges."""
    docs = [(i, f"text {i} " * (1 + (i * 37) % 90), f"l{(i * 7) % 4}", f"s{(i * 11) % 20:02d}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    place = {r.doc_id: (r.shard, r.size.bit_length()) for r in H.hilbert_shards(df).collect()}
    for value in (lambda d: d[3], lambda d: d[2], lambda d: place[d[0]][1]):
        seen: dict = {}
        for d in docs:
            seen.setdefault(place[d[0]][0], set()).add(value(d))
        values = {value(d) for d in docs}
        touched = [sum(min(s) <= v <= max(s) for s in seen.values()) for v in values]
        assert sum(touched) / len(touched) < 12


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "l", "s")], "doc_id long, text string, lang string, source string")
    plan = H.hilbert_shards(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
