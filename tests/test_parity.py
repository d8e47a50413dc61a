"""Every registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tramline.plans import REGISTRY, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = REGISTRY[name](spark, D)
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    types = {c[0]: str(c[1]) for c in got.description}
    assert {c: t for c, t in df.dtypes} == {c: TYPES.get(types[c], types[c]) for c in columns}
    order = sorted(columns)
    theirs = sorted(str([row[columns.index(c)] for c in order]) for row in got.fetchall())
    assert sorted(str([row[c] for c in order]) for row in df.collect()) == theirs


def test_every_query_runs(spark):
    for name in sorted(set(REGISTRY) - set(SQL)):
        assert REGISTRY[name](spark, D).collect() is not None
