import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegrid.llm import vector_search as vs


def brute(rows, asks, k, factor=256.0):
    good = [(i, [math.floor(factor * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if asks(i):
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, asks, k, **settings):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, label string, score int")
    got = vs.top_k(df, is_query=asks(F.col("vec_id")), k=k, **settings)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 12)]) for i in range(300)]
    asks = lambda i: i % 9 == 0
    assert run(spark, rows, asks, 5, block_rows=block_rows, shards=3) == brute(rows, asks, 5)


def test_ties_and_odd_rows(spark):
    one = [0.5, -0.25]
    rows = [(i, one) for i in range(20)] + [(20, None), (21, [None, 1.0]), (22, [math.inf, 1.0]), (23, [math.nan, 0.0]), (None, one), (24, []), (25, [0.5]), (3, [1.0, 1.0]), (0, [0.75, 0.0])]
    asks = lambda i: i % 5 == 0
    assert run(spark, rows, asks, 4, block_rows=3, shards=4) == brute(rows, asks, 4)


def test_few_candidates(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    asks = lambda i: i == 0
    assert run(spark, rows, asks, 5) == brute(rows, asks, 5)
    assert run(spark, [(0, [1.0])], asks, 5) == []
    assert run(spark, [], asks, 5) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + i), 3.0]) for i in range(6)]
    asks = lambda i: i < 2
    factor = 2.0**-15
    assert run(spark, rows, asks, 3, factor=factor) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], asks, 3, factor)
    exact = vs.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]]))
    assert int(exact[0, 0]) == 2**60 + 1


def test_blocks_are_pruned(monkeypatch):
    """Blocks whose bound lies below the k-th score are not scored."""
    rng = np.random.default_rng(0)

    def block(ids, m):
        return ids, m, m.max(axis=0), m.min(axis=0)

    near = block(np.arange(1000, 1008), np.full((8, 4), 9.0))
    far = [block(np.arange(10 * b, 10 * b + 10), rng.integers(-3, 3, (10, 4)).astype(float)) for b in range(30)]
    monkeypatch.setattr(vs, "FIRST", 1)
    out = vs._ask(np.array([5]), np.full((1, 4), 1.0), np.array([-np.inf]), [*far, near], 5).to_pylist()
    assert [r["vec_id"] for r in out] == [1000, 1001, 1002, 1003, 1004, None]
    assert out[-1]["visited"] == 1 and out[-1]["blocks"] == 31


def test_clustered_rows_are_pruned(spark):
    """Rows of a cluster lie in blocks of their own, whatever their ids, and a
    query leaves most blocks and shards alone; the result is that of brute force."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2400):
        v = rng.normal(0, 0.01, 16)
        v[i * 7 % 16] += 1.0
        rows.append((i, [float(np.float32(x)) for x in v]))
    asks = lambda i: i % 60 == 0
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    settings = {"is_query": asks(F.col("vec_id")), "k": 5, "block_rows": 16, "shards": 6}
    seen = vs.visits(df, **settings).agg(F.sum("visited"), F.sum("blocks"), F.count("*")).first()
    assert seen[2] == 40 and seen[0] < 0.2 * 40 * 150 and seen[1] < 0.5 * 40 * 150
    assert run(spark, rows, asks, 5, block_rows=16, shards=6) == brute(rows, asks, 5)


def test_without_the_shards_bounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 5)]) for i in range(200)]
    asks = lambda i: i % 9 == 0
    monkeypatch.setattr(vs, "SUMMARY", 0)
    assert run(spark, rows, asks, 5, block_rows=8, shards=3) == brute(rows, asks, 5)


def test_huge_components(spark):
    """Finite components of any size take part; scores are ordered exactly."""
    rows = [(0, [1e20, 1.0]), (1, [1e20, 2.0]), (2, [-1e20, 0.0]), (3, [3e38, 0.0]), (4, [0.0, 1.0])]
    got = run(spark, rows, lambda i: i == 0, 4)
    assert [(r[2], r[3]) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 256 * 256), (2, -(2**63))]
    wide = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e308, 0.0]), (2, [-1e300, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in vs.top_k(wide, is_query=F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_clashing_names(spark):
    names = "vec_id bigint, embedding array<float>, rank int, query_id string, shard int, floors int, v string, one int, two int, kind int, score int, visited int, blocks int, ids int, matrix int, width int, code int, top int, low int, h int"
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, "q", 0, 0, "v", *([0] * 13)) for i in range(60)], names)
    assert len(vs.top_k(df).collect()) == 10
