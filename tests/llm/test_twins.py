"""The registered queries against their DuckDB twins on the smallest data."""

import duckdb
import pytest

from tracewarden.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, data_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = queries.queries()[name](spark, data_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)
