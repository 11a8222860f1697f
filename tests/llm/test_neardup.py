import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import neardup


class Value:
    def __init__(self, value):
        self.value = value


def brute_classes(texts, idf):
    """Label of each text: classes of all pairs that reach the threshold, every text held against every other."""
    row, h, w = neardup.weights(pa.array(texts, pa.large_string()), idf)
    sets = [(h[row == i], w[row == i]) for i in range(len(texts))]
    label = list(range(len(texts)))
    postings = {}
    for i, (hh, _) in enumerate(sets):
        found = {j for x in hh.tolist() for j in postings.get(x, ())} if len(hh) else set(postings.get(None, ()))
        for x in hh.tolist() or [None]:
            postings.setdefault(x, []).append(i)
        for j in found:
            if label[i] != label[j] and (not len(hh) or neardup.similar(*sets[i], *sets[j]) >= neardup.THRESHOLD):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_near_duplicates(spark):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        k += 100
        rows += [(10 * k, " ".join(words), "a"), (10 * k + 1, " ".join(words).upper(), "a"), (10 * k + 2, " ".join([*words[:60], "changed", *words[61:]]), "b"), (10 * k + 3, " ".join(words[:60]), "b")]
    got = {x.doc_id: x for x in neardup.classes(docs(spark, [*ODD[:2], *rows, (99, "a b", None), (98, "a b", None)])).collect() if x.doc_id not in (1, 2)}
    for k in range(100, 106):
        assert [got[10 * k + j].class_id for j in range(4)] == [10 * k, 10 * k, 10 * k, 10 * k + 3], k
        assert got[10 * k].n_links == 1
    assert got[99].class_id == 98
    left = neardup.without_copies(docs(spark, [*ODD, *rows]))
    assert left.columns == docs(spark, []).columns and left.filter("doc_id = 2").count() + left.filter("doc_id = 1").count() == 1


def test_near_duplicates_beside_leaders(spark):
    """Variants of one text that differ from each other: classes are those of all pairs that share a band and reach the threshold."""
    r = random.Random(8)
    texts = []
    for k in range(3):
        base = [f"v{k}x{r.randint(0, 10**6)}" for _ in range(150)]
        texts += [" ".join(f"n{r.randint(0, 10**6)}" if r.random() < 0.0115 + 0.002 * k else w for w in base) for _ in range(90)]
    got = {x.doc_id: x.class_id for x in neardup.classes(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    class Idf:
        value = neardup.idf_table(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]))

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], ["doc_id", "text", "id"])
    bands = np.array([b for out in neardup._signer(Idf)([batch]) for b in out.column("bands").to_pylist()])
    row, h, w = neardup.weights(pa.array(texts, pa.large_string()), Idf.value)
    sets = [(h[row == i], w[row == i]) for i in range(len(texts))]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((bands[:i] == bands[i]).any(1)):
            if label[i] != label[j] and neardup.similar(*sets[i], *sets[j]) >= neardup.THRESHOLD:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert [got[i] for i in range(len(texts))] == label and 6 < len(set(label)) < 240


def test_near_duplicates_without_ids(spark):
    """Different texts that share a null or repeated doc_id stay; copies go."""
    r = random.Random(5)
    text = lambda: [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    own = [" ".join(text()) for _ in range(12)]
    near = text()
    near = [" ".join(near), " ".join([*near[:-1], "end"])]
    rows = [(None, t, "a") for t in own[:5]] + [(7, t, "b") for t in own[5:9]] + [(20 + i, t, "a") for i, t in enumerate(own[9:])]
    rows += [(None, own[0], "a"), (7, own[5], "a"), (3, own[6], "b"), (None, own[9], "a"), (None, near[0], "a"), (40, near[1], "a"), (None, None, "a"), (None, "", "a")]
    df = docs(spark, rows)
    got = [(x.doc_id, x.text or "") for x in neardup.without_copies(df).collect()]
    want = [(None, t) for t in own[:5]] + [(7, own[5]), (3, own[6]), (7, own[7]), (7, own[8])] + [(20 + i, t) for i, t in enumerate(own[9:])] + [(40, near[1]), (None, "")]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    found = [(x.doc_id, x.class_id, x.n_copies, x.n_links) for x in neardup.classes(df).collect()]
    assert len(found) == len(rows) and sorted(x[1:] for x in found if x[0] is None and x[1]) == [(20, 2, 0), (40, 1, 1)] and found.count((3, 3, 2, 0)) == found.count((7, 3, 2, 0)) == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 70)], "a long, b long")
    assert {r.id: r.label for r in neardup.components(edges).collect()} == {**{i: 0 for i in range(21)}, 50: 50, 60: 50, 70: 50}


def test_classes_of_all_pairs(spark):
    """On a whole test table with planted pairs of 0.8 to 0.95: classes are those of all pairs at the threshold but for what a band may miss."""
    r = random.Random(12)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(700).collect()]
    for k in range(60):
        words = [f"p{k}q{r.randint(0, 10**6)}" for _ in range(150)]
        other = words[:]
        for _ in range(r.randint(1, 4)):
            other[r.randrange(150)] = f"n{r.randint(0, 10**6)}"
        texts += [" ".join(words), " ".join(other)]
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    want = brute_classes(texts, neardup.idf_table(df))
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    same = lambda of: {(i, of[i]) for i in range(len(texts)) if of[i] != i}
    assert same(got) <= same(want) and len(same(got)) >= 0.99 * len(same(want)) and len(same(want)) > 60


def test_idf_of_shared_shingles_is_that_of_their_documents():
    """The load of rare shingles on a feature is taken off, and frequent ones keep their own idf, however large the corpus is."""
    for n, load in ((1000, 0), (10**6, 1500)):
        df = np.full(neardup.DF_BUCKETS, load)
        df[7], df[8] = load + n // 2, load + n // 20
        idf = neardup.idf_of(df - np.median(df), n)
        assert abs(idf[7] - (1 + np.log(2))) < 1e-3 and abs(idf[8] - (1 + np.log(20))) < 1e-3 and abs(idf[9] - (1 + np.log(neardup.RARE))) < 1e-6


def test_samples_agree_as_texts_do():
    """The share of equal samples is near the weighted Jaccard similarity."""
    r = random.Random(2)
    idf, draws = np.ones(neardup.DF_BUCKETS, np.float32), neardup.Draws()
    off = []
    for _ in range(60):
        a = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
        b = a[:]
        for _ in range(r.randint(2, 40)):
            b[r.randrange(400)] = f"x{r.randint(0, 10**6)}"
        row, h, w = neardup.weights(pa.array([" ".join(a), " ".join(b)], pa.large_string()), idf)
        x, y = [(h[row == i], w[row == i]) for i in (0, 1)]
        off.append((draws.sample(*x) == draws.sample(*y)).mean() - neardup.similar(*x, *y))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


@pytest.mark.parametrize("blocks", [(8, 8), (4096, 512)])
def test_one_bucket_of_many_blocks(spark, monkeypatch, blocks):
    """Texts that share a long passage but are no copies, with copies among them: blocks of a bucket meet."""
    monkeypatch.setattr(neardup, "SKETCHES", blocks[0])
    monkeypatch.setattr(neardup, "BLOCK", blocks[1])
    monkeypatch.setattr(neardup, "BESIDE", 4)
    r = random.Random(7)
    passage = [f"s{k}" for k in range(120)]
    texts = []
    for k in range(45):
        own = [f"o{r.randint(0, 10**6)}" for _ in range(60)]
        texts += [" ".join(passage + own), " ".join(passage + own[:-1] + ["end"])]
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    want = brute_classes(texts, neardup.idf_table(df))
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 45


def test_odd_tables(spark):
    df = clashing(docs(spark, [*ODD, (3, "word " * 30000, "b")]), "stay_", "text_", "kept", "node", "many", "of_text", "id", "label", "key")
    left = neardup.without_copies(df)
    assert left.columns == df.columns and sorted((x.doc_id or -1) for x in left.collect()) == [-1, 1, 3, 4]
    assert neardup.classes(df.filter("false")).isEmpty() and neardup.without_copies(df.filter("false")).isEmpty()
    assert neardup.classes(df).filter(F.col("class_id") == 1).count() == 3
