import os

import duckdb
import pytest

from scarpline.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


def text(v):
    return "null" if v is None or v != v else str(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    got = plans.queries()[name](spark, DATA)
    want = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted(tuple(text(v) for v in r) for r in found)
    assert rows(got.select(names).collect()) == rows(want.fetchall())


def test_entry_module_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
