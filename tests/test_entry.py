import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 2


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["normalize", "intent_auto_blended", "search_topk", "rrf", "multipath_rerank", "quantize_binary", "feedback_triplets", "factory_examples", "train_migration", "train_stream", "whitening_fit", "online_scheduler", "maxsim_topk", "quantization_recall", "format_float", "corpus_files", "packed_vectors", "pipeline_stored_as_array", "pipeline_metrics", "custom_encoding", "federated_round"])
def test_query_equals_oracle(spark, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
