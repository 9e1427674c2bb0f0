"""Every registered query of the engine beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessellum.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return value


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = ordered(tuple(shown(r[c]) for c in names) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == ordered(tuple(shown(x[columns.index(c)]) for c in names) for x in found.fetchall())
