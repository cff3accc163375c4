import os

import duckdb
import pytest

from termforge.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == expected
