"""Every registered query against its SQL, and its plan."""

import pytest
from compare import duck_bag, spark_bag

import __spark_entry__ as entry

QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in entry.LLM_SQL}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    report = entry.entry(spark)
    assert report.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("NestedLoop", "CartesianProduct", "Python", "Arrow", "MapInPandas"):
        assert unwanted not in plan
    names, rows = spark_bag(frame)
    wanted_names, wanted = duck_bag(duck, SQL[name])
    assert names == wanted_names
    assert len(rows) == len(wanted)
    assert [list(map(type, row)) for row in rows] == [list(map(type, row)) for row in wanted]
    assert rows == wanted
