import math

import numpy as np
import pytest
from llm_cases import clashing
from pyspark.sql import functions as F

from galleyworks.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=5):
    """Every anchor with every row, in Python's integers."""
    part = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part[(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    out = []
    for i, y, v in part:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in part if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in score if s[2] == y)[:5]:
            fit = sorted(s for s in score if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(fit)]
    return sorted(out)


def mined(df, every=5):
    return sorted(tuple(r) for r in H.mine(H.scaled(df), F.col("vec_id") % every == 0).collect())


def clusters(n, dim, seed, labels=4):
    g = np.random.default_rng(seed)
    y = g.integers(0, labels, n)
    x = g.normal(size=(labels, dim))[y] * 0.1 + g.normal(size=(n, dim)) * 0.08
    return [(i, [float(c) for c in x[i].astype(np.float32)], int(y[i])) for i in range(n)]


def test_odd_rows_equal_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(260, 20, 1)
    rows += [(1000, rows[5][1], rows[5][2]), (1005, rows[5][1], 9), (1001, rows[5][1], 9), rows[7], rows[10]]  # ties, a lone label, repeated rows
    rows += [(2000, None, 1), (2005, rows[0][1], None), (2010, [nan] * 20, 1), (2015, [inf] * 20, 1), (2020, [None] * 20, 1), (2025, [], 1), (2026, [], 1), (2030, [], 2), (2035, [1.0, 2.0], 1), (2040, [1.0, 2.0], 1), (2041, [1.0, 1.9], 0), (None, rows[0][1], 1), (2045, [0.0] * 20, 2), (-5, rows[9][1], 3)]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "dim", "own", "rank", "lane", "shard", "vector", "n", "m")
    got = mined(df)
    assert got == plain(rows) and got
    none = H.mine(H.scaled(df.filter("false")), F.col("vec_id") % 5 == 0)
    assert none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and none.isEmpty()


@pytest.mark.parametrize("dim", [3, 40, 90])
def test_several_shards_and_lanes_equal_brute_force(spark, monkeypatch, dim):
    """Small groups and tiles; one label has over a third of the rows; vectors longer than the leading components."""
    for name, value in (("SHARD", 60), ("LANE", 16), ("ANCHORS", 8), ("FIRST", 8), ("LARGEST", 32)):
        monkeypatch.setattr(H, name, value)
    rows = [(i, v, 0 if i % 5 < 2 else y) for i, v, y in clusters(400, dim, dim)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and got


def test_bounds_hold_and_discard():
    """No bound is under its exact product, also where products cancel; most pairs of clustered rows go by the bound."""
    import pyarrow as pa

    g = np.random.default_rng(4)
    x = np.floor(256 * (g.normal(size=(500, 64)) * np.exp(-np.arange(64) / 8)))
    x[:50] = -x[50:100] + g.integers(-1, 2, (50, 64))
    q = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    t = pa.table({"vec_id": np.arange(500), "label": np.arange(500) % 3, "vector": pa.array(list(x))})
    s = H.Side(t, 64, q)
    exact = x @ x.T
    for b in s.bounds:
        assert (b.astype(np.float64) @ b.astype(np.float64).T >= exact - 1e-6).all() and (b @ b.T >= exact).all()
    assert (s.bounds[0] @ s.bounds[0].T >= np.sort(exact, 1)[:, -6][:, None]).mean() < 0.1


def test_scores_beyond_doubles_are_an_error(spark):
    df = spark.createDataFrame([(5, [1e7, 1e7], 1), (6, [1e7, 1e7], 1), (7, [1e7, 0.0], 2)], SCHEMA)
    with pytest.raises(Exception, match="not exact"):
        H.mine(H.scaled(df), F.col("vec_id") % 5 == 0).collect()
