"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from chainloom.queries import ORACLE, QUERIES
from chainloom.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.7g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    result = sql.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(value(r[c]) for c in sorted(names)) for r in df.collect())
    theirs = sorted(tuple(value(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert ours == theirs and ours


#: Rows of the queries without SQL, where the tables tell: a row a vector, a fold, a seed, a kept column, a grid point.
N = {"kmeans": 100, "silhouette": 100, "pca": 100, "svm_rff": 100, "logreg": 100, "mlp": 100, "kfold_cv": 10, "dtree": 5, "rfe": 2, "perm_importance": 64, "relu_perceptron": 100, "svm_grid": 900}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sql, name):
    rows = QUERIES[name](spark, SF).collect()
    vectors = sql.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert len(rows) == (vectors if N.get(name) == 100 else N[name]) if name in N else rows
    for r in rows:
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())


def test_no_python_in_aggregations(spark, capsys):
    """The association and statistics plans stay in the JVM."""
    for name in ("simplex_llh_leaf", "edge_llh", "obs_exp_8", "strand_angles", "threshold_sweep"):
        QUERIES[name](spark, SF).explain()
        assert "Python" not in capsys.readouterr().out
