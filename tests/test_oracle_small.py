"""Every SQL-checkable query vs its DuckDB oracle on the smallest tables."""
import duckdb
import pytest

from core_helpers import SF001
from tools.check_oracle import TABLES, rows_of

import __spark_entry__ as E
from chainlens.plans import catalog, oracle

# the training-data queries have tests of their own
SQL = oracle.oracle_sql()
QUERIES = {k: f for k, f in E.queries().items() if k in catalog.queries()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_oracle_or_is_model_fit():
    rows_only = {"pca_variance_a", "pca_loadings_a", "kmeans_assign_a", "cluster_profiles_a", "segment_cluster_crosstab_a",
                 "pca_variance", "pca_loadings", "pca_scores", "kmeans_sweep", "kmeans_assign",
                 "cluster_sample",
                 "reach_estimates"}  # sketches: their error is checked by reach_rollup
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= rows_only


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    srows, scols = df.collect(), df.columns
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "wallet" in df.columns
