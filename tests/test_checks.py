"""Every registered query against its SQL check in DuckDB, over the whole smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from threadlens.plans import score_queries
from threadlens.plans.all import CHECKS, PLANS

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    yield con
    con.close()


def _plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    df = PLANS[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "NestedLoop", "BatchEvalPython"))
    cursor = duck.execute(CHECKS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(PLANS) <= set(contract.queries())
    assert set(PLANS) - set(CHECKS) == {"negativity_logit"}


def test_logit_query_is_newtons_on_all_rows(spark):
    """The registered query against a plain fit of all coded rows; Firth's where these part the outcomes."""
    coded = score_queries.coded_mentions(spark, SF).filter("year IS NOT NULL")
    rows = [tuple(r) for r in coded.select("negative", "year", *score_queries.LOGIT_FLAGS).collect()]
    y, year, *flags = (np.array(c, float) for c in zip(*rows))
    columns = {**dict(zip(score_queries.LOGIT_FLAGS, flags)), "year_c": year - year.mean(), "intercept": np.ones(len(y))}
    got = {r.term: r.estimate for r in PLANS["negativity_logit"](spark, SF).collect()}
    x = np.column_stack([columns[t] for t in got])
    at = np.array(list(got.values()))
    p = 1 / (1 + np.exp(-x @ at))
    w = p * (1 - p)
    inverse = np.linalg.inv(x.T @ (x * w[:, None]))
    score = x.T @ (y - p)
    if np.abs(score).max() > 1e-6:  # no highest point of the likelihood: that of the penalised one
        score = x.T @ (y - p + w * np.einsum("ni,ij,nj->n", x, inverse, x) * (0.5 - p))
    assert np.abs(inverse @ score).max() < 1e-6 and {"year_c", "intercept"} <= set(got)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
