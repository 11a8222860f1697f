import numpy as np
import pytest
from llm_cases import clashing

from galleyworks.llm import ann


def brute(x, ids, q, k=20):
    """Ids of the k nearest; equal vectors score alike whatever a matrix product rounds."""
    one, of = np.unique(x, axis=0, return_inverse=True)
    s = np.array([float(np.dot(x[q].astype(float), v.astype(float))) for v in one])[of.ravel()]
    return [int(ids[i]) for i in sorted(range(len(x)), key=lambda i: (-s[i], ids[i])) if i != q][:k], s


def recall(spark, x, kind="float"):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got, hits = {}, 0
    for r in ann.neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, len(x), 20):
        want, s = brute(x, np.arange(len(x)), q)
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, len(want) + 1)) and all(abs(score - s[v]) < 1e-12 * max(1, abs(score)) for _, v, score in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits += len(set(want) & {r[1] for r in rows}) / len(want)
    return hits / len(range(0, len(x), 20))


def test_equal_vectors_and_odd_rows(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0, None] * 8), (5, x[5].tolist()), (780, [1.0, 2.0]), (None, x[0].tolist())]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "shard", "dim", "h1", "ids", "rank", "lane")
    got = {}
    for r in ann.neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q in range(0, 600, 20):
        want, _ = brute(x, np.arange(600), q)
        assert len(got[q]) == 20
        hits += len(set(want) & {v for _, v in got[q]})
    assert hits / 600 >= 0.97 and set(got) == set(range(0, 600, 20))
    none = ann.neighbours(df.filter("false"), df)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.isEmpty()


def test_double_vectors_keep_their_scores(spark):
    x = np.random.default_rng(4).normal(size=(120, 8))
    x[7] = x[6] + 1e-12  # differ in double precision only
    assert recall(spark, x, "double") >= 0.97


@pytest.mark.parametrize("kind", ["unit", "gauss", "clustered"])
def test_recall_of_several_shards(spark, monkeypatch, kind):
    """Hard data widen the beam; queries stream past their shards in several lanes."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 1200)
    monkeypatch.setattr(ann, "LANE", 64)
    g = np.random.default_rng(2)
    x = g.normal(size=(3000, 48))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "clustered":
        x = g.normal(size=(30, 48))[g.integers(0, 30, 3000)] + 0.05 * x
    assert recall(spark, x.astype(np.float32)) >= 0.95


def test_a_full_shard():
    """One shard of SHARD_ROWS vectors with the production settings."""
    x = np.random.default_rng(5).normal(size=(ann.SHARD_ROWS, 64)).astype(np.float32)
    index = ann.Index(x)
    ef, q = index.measured(), np.random.default_rng(6).choice(len(x), 200, replace=False)
    s = x[q] @ x.T
    want, found = np.argpartition(-s, 21, axis=1)[:, :21], index.search(x[q], ef)
    assert sum(len(set(a) & set(b)) for a, b in zip(want, found)) / (200 * 21) >= 0.95 and ef < len(x) // 4
