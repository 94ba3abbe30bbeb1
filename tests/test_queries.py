"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check_queries import canonical, duck, same

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert same(canonical([tuple(r) for r in rows], df.columns), canonical(result.fetchall(), names))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
