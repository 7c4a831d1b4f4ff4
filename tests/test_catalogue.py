import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue, large, selection  # noqa: F401  the latter two add their queries

REPORTED = sorted(catalogue.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", REPORTED)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df, sql = catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(map(_plain, r)) for r in sql.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
    assert ours == theirs
