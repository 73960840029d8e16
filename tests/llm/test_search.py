"""Top-k search against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import queries, top_search

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_search(rows, k=10, scale=1024):
    able = []
    for name, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(scale * x) for x in v]
            if sum(x * x for x in ints) < 2**62:
                able.append((name, ints))
    out = []
    for i, (query, v) in enumerate(able):
        if query is None or query % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, u)), name is None, name or 0)
                        for j, (name, u) in enumerate(able) if i != j and len(u) == len(v))
        out += [(query, r + 1, None if none else name, -s) for r, (s, none, name) in enumerate(scores[:k])]
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in top_search.top_k(df, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.PLANS["op13_top_search"](spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows)


def test_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(queries.CHECKS["op13_top_search"]).fetchall())
    got = queries.PLANS["op13_top_search"](spark, sf).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == want != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [-1.0, 0.5], None), (None, [3.0, 3.0], 1), (1, [3.0, 3.0], 1),
            (2, [3.0, 3.0], 1), (100, None, 1), (200, [None, 1.0], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1),
            (500, [], 1), (600, [0.0, 0.0], 1), (700, [1.0, 2.0, 3.0], 1), (800, [1e300, 1.0], 1), (3, [1e15, 0.0], 1),
            (4, [1e6, -1e6], 1), (900, [-1e6, 1e6], 1), (-100, [0.0003, -0.0003], 1), (1000, [5.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("dims", "square", "at", "bar", "row", "level")})
    for k in (1, 3, 10):
        assert found(df.repartition(4), k=k) == plain_search(rows, k)
    assert found(df.limit(0)) == []


@pytest.mark.parametrize("options", [{}, {"block": 64, "query_block": 3}, {"block": 7, "query_block": 50, "k": 12}, {"block": 4096}])
def test_blocks(spark, options):
    """Lengths from tiny to large, low rank, ties and copies, some dimensions apart."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, 24))
    rows = []
    for i in range(900):
        v = rng.standard_normal(5) @ base * 10.0 ** rng.uniform(-2, 1) + rng.standard_normal(24) * 0.01
        v = v if i % 50 else np.abs(v)
        rows.append((i if i < 850 else i - 300, [float(np.float32(x)) for x in (v if i % 9 else v[:20])], 1))
    rows += [(2000 + i, rows[3][1], 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    k = options.get("k", 10)
    assert found(df, **options) == plain_search(rows, k)


def test_large_numbers_stay_exact(spark):
    """Beyond 2^53 sums of doubles would round."""
    rng = np.random.default_rng(5)
    rows = [(i * 50, [float(x) for x in rng.integers(-(2**20), 2**20, 6)], 1) for i in range(60)]
    assert found(spark.createDataFrame(rows, SCHEMA), block=16) == plain_search(rows)
