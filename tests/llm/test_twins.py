import glob
import os

import duckdb
import pytest
from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, sql = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(sql.project(", ".join(cols)).fetchall(), key=str)
