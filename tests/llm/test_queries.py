"""The registered queries against their SQL, and the entry point with and without this folder."""

import sys

import duckdb
import pytest

from check import table
from sitesift.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for view in ("documents", "conversations", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cursor = db.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_point(monkeypatch):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    for module in ("corpus_pipeline", "sitesift.llm", "sitesift.llm.queries"):
        monkeypatch.setitem(sys.modules, module, None)
    rest = set(entry.queries())
    assert rest and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest


@pytest.mark.parametrize("name", ["op3_secret_scan", "op5_chat_format", "op9_sharding"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct"):
        assert node not in plan
