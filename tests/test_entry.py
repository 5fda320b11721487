import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "coupling_topk" in entry.queries()
    if importlib.util.find_spec("histograin.llm"):
        assert sum(q.startswith("op") and q[2].isdigit() for q in entry.queries()) == 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["coupling_topk", "age_profile", "hotspot_rank", "canonical_paths", "timeline_alive_series", "dir_rollup"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    expected = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 20
