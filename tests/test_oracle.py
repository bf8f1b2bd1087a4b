"""Every registered query against its DuckDB twin on the smallest data."""

import math

import duckdb
import pytest

from tracewarden import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: On the smallest data no point need fail both models.
MAY_BE_EMPTY = {"dual_recon_hard_samples"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else "0" if abs(value) < 1e-9 else f"{value:.8g}"
    return str(value)


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twin(spark, duck, data_dir, name):
    df = plans.QUERIES[name](spark, data_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect())
    result = duck.execute(plans.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows(spark, data_dir, name):
    df = plans.QUERIES[name](spark, data_dir)
    rows = df.collect()
    assert df.columns and (rows or name in MAY_BE_EMPTY)
    assert not [v for r in rows for v in r if isinstance(v, float) and math.isnan(v)]


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and "node_anomaly_rank" in __spark_entry__.queries()
