import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import toxicity

BAD = ["idiot", "worthless", "scumbag", "moron"]


def prose(r, n=60):
    return " ".join("".join(r.choice(["an", "er", "th", "on", "re", "ti"]) for _ in range(3)) for _ in range(n))


def cases(n=300, seed=2):
    r = random.Random(seed)
    y = np.array([i % 3 == 0 for i in range(n)]).astype(int)
    return [" ".join([prose(r), *r.sample(BAD, 2), prose(r, 20)]) if k else prose(r, 80) for k in y], y


@pytest.fixture(scope="module")
def model():
    texts, y = cases()
    return toxicity.train(texts, y)


def scores(model, texts):
    return toxicity.score_batch(pa.array(texts, pa.large_string()), model.gram_scores(), model.bias)


def test_held_out_texts(model):
    texts, y = cases(120, 9)
    top, mean = scores(model, texts)
    assert ((top >= 0.5) == y).mean() > 0.97 and ((0 <= mean) & (mean <= 1)).all()


def test_unseen_misspellings_share_grams(model):
    top, _ = scores(model, ["anerth worthles idiott", "anerth onreti thonan", "idioot moroon"])
    assert top[0] >= 0.5 > top[1] and top[2] > top[1]


def test_no_place_dilutes_a_passage(model):
    """Windows begin at every word, runs without spaces are read whole, and other spaces and underscores part words."""
    r = random.Random(1)
    pad = prose(r, 400).split()
    for k in (0, 5, 13, 16, 100, 391, 400):
        assert scores(model, [" ".join([*pad[:k], "worthless", "idiot", *pad[k:]])])[0][0] >= 0.5, k
    clean = "anerth_" * 8
    for t in ("worthless_idiot", clean + "worthless_idiot", "x\u00a0worthless\u2014idiot\u3000y", "（worthless）【idiot】"):
        assert scores(model, [t])[0][0] >= 0.5, t[:40]
    assert scores(model, [clean * 20])[0][0] < 0.5
    # without spaces there are no grams of a word's begin and end, but what is left is found wherever it stands
    run = "anerthonreti" * 60
    bare, *held = scores(model, [run, *(run[:k] + "worthlessidiot" + run[k:] for k in (0, 96, 360, 720))])[0]
    assert bare < 0.1 and min(held) > 3 * bare


def test_pieces_hold_all_grams_of_a_word():
    """The grams of the pieces of a long word are those of the whole word."""
    word = "abcdefghijklmnopqrstuvwxyz0123456789" * 4
    data = np.frombuffer(word.encode(), np.uint8)
    whole, _ = toxicity.bags(data, np.array([0]), np.array([len(word)]), np.array([True]), np.array([True]))
    grams, begin, which, row = toxicity.words(pa.array([word], pa.large_string()))
    rest = lambda g, b: set(np.delete(g, b).tolist())
    assert rest(whole, [0]) == rest(grams, begin) and len(which) > 5


def test_a_text_scores_alike_in_any_batch(model):
    texts, _ = cases(40, 5)
    texts += ["", "a", "worthless"]
    together = scores(model, texts)
    alone = [scores(model, [t]) for t in texts]
    assert all(together[k][i] == alone[i][k][0] for k in (0, 1) for i in range(len(texts)))


def test_only_training_rows_teach(spark):
    """Labels of held-out rows change nothing; nor do other columns. Null and repeated ids, nulls and odd labels are borne."""
    texts, y = cases(400, 4)
    d = docs(spark, [*[(i, t, "a") for i, t in enumerate(texts)], *ODD])
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))]
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    a = label([(i, 1, int(k)) for i, k in enumerate(y)] + [(None, 1, 1), (1, 0, None), (2, 0, 7), (9999, 1, 1)])
    b = label([(i, 0, int(1 - k) if h else int(k)) for (i, k), h in zip(enumerate(y), held)])
    m, n = toxicity.fit(d, a), toxicity.fit(d, b)
    assert (m.grams == n.grams).all() and (m.table == n.table).all() and m.bias == n.bias and len(m.grams) > 20
    df = clashing(d, "score", "toxicity_", "average", "bytes", "hash")
    got = toxicity.with_score(df, m)
    assert got.columns == [*df.columns, "toxicity"] and got.filter("toxicity.score between 0 and 1").count() == 400 + len(ODD)
    rows = {r.doc_id: (r.s, r.score) for r in got.select("doc_id", F.col("toxicity.score").alias("s"), "score").collect()}
    hit = [(rows[i][0] >= 0.5) == y[i] for i in range(400) if held[i] and i not in (1, 2, 3, 4)]
    assert np.mean(hit) > 0.95 and rows[1][0] < 0.5 and rows[10][1] == "own score"
    assert toxicity.with_score(df.filter("false"), m).isEmpty()


def test_bounds_of_the_sample(spark):
    texts, y = cases(60, 6)
    d = docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(0, "a longer text of the same id " * 20, "a")])
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, toxic int")
    rows = toxicity.sample(d, labels, per_class=7).collect()
    assert len(rows) == 14 and len({r.doc_id for r in rows}) == 14
    size = max(len(t.encode()) for t in texts)
    assert 2 <= len(toxicity.sample(d, labels, sample_bytes=3 * size).collect()) < 14 and toxicity.sample(d, labels, sample_bytes=0).isEmpty()


def test_labels_of_one_class_reject_nothing(spark):
    d = docs(spark, [(i, f"some text {i}", "a") for i in range(20)])
    for rows in ([(i, 1) for i in range(20)], []):
        m = toxicity.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.with_score(d, m).filter("toxicity.score >= 0.5").isEmpty()


def test_a_text_over_the_bound_is_passed_over():
    """One that does not fit, in front of its class, does not keep the others out; no class is empty."""
    rows = [{"doc_id": i, "toxic": i % 2, "bytes": 10, "hash": i, "order": i} for i in range(2, 52)] + [{"doc_id": 1, "toxic": 1, "bytes": 10_000, "hash": 1, "order": 0}]
    kept = toxicity.fitting(rows, 200)
    assert sum(1 for r in kept if r[1] == 0) == sum(1 for r in kept if r[1] == 1) == 20 and all(r[0] != 1 for r in kept)
    only = toxicity.fitting([{"doc_id": 1, "toxic": 1, "bytes": 500, "hash": 1, "order": 0}, {"doc_id": 2, "toxic": 1, "bytes": 400, "hash": 1, "order": 1}], 200)
    assert [r[0] for r in only] == [2] and toxicity.fitting(rows, 0) == []
