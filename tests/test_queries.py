"""Every query of the dataflow part against its SQL, on the smallest tables."""

import duckdb
import pytest

from millrace.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, str(data)).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: df[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert rows(got).equals(rows(want))


def test_pruning(spark, data):
    plan = QUERIES["conditional_emit"](spark, str(data))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), EqualTo(event_type,purchase), GreaterThan(value,10.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 64 * 36
    assert set(entry.oracle_sql()) <= set(entry.queries())
