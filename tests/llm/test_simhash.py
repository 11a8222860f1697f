import re

import numpy as np
import pytest
import xxhash
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import simhash


def plain(text):
    """The fingerprint, word by word and bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(rows):
    """All pairs: doc_id, fingerprint and smallest doc_id reachable of each row."""
    fp = [plain(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
    least = {k: min((r[0] for r, m in zip(rows, label) if m == k and r[0] is not None), default=None) for k in label}
    return sorted(((r[0], f"{f:016x}", least[k]) for r, f, k in zip(rows, fp, label)), key=str)


def test_classes_equal_all_pairs(spark):
    g = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ÀB", "ſ", "a b", "x y"]
    long = " ".join(g.choice(vocabulary, 1500))
    rows = [(50 + i, re.sub("w7 ", f"w{i} ", long, count=1), "s") for i in range(25)] + [(100 + i, " ".join(g.choice(vocabulary, g.integers(0, 9))), "s") for i in range(60)]
    rows += ODD + [(200, "\x0b\x0c \t", "a"), (201, "A b\nC", "a"), (202, "a\tB  c", "a"), (203, "a b c", "a"), (None, long, "a")]
    got = simhash.classes(clashing(docs(spark, rows), "fingerprint", "least", "label", "path", "key", "component_id")).collect()
    assert sorted((tuple(r) for r in got), key=str) == classes_of(rows)
    none = simhash.classes(docs(spark, rows).filter("false"))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.isEmpty()


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(str(k * k % 997) for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text) == whole == plain(text.decode())
    assert simhash.fingerprint(b"x" * 1000 + b" y") == plain("x" * 1000 + " y") and simhash.fingerprint(b" " * 1000) == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices_find_all_near_pairs(radius):
    g = np.random.default_rng(radius)
    base = g.integers(0, 1 << 63, 40, np.uint64)
    bucket = np.sort(g.integers(0, 12, 700))
    values = base[g.integers(0, 40, 700)]
    for _ in range(4):
        values ^= np.where(g.random(700) < 0.6, np.uint64(1) << g.integers(0, 64, 700).astype(np.uint64), np.uint64(0))
    a, b = simhash.near_pairs(values, bucket, radius)
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if bucket[i] == bucket[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    """Buckets over the bound, whose members share one part of the bits or two, lose no link."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    g = np.random.default_rng(8)
    low = [int(x) for x in g.integers(0, 1 << 30, 120)]
    values = {v ^ (1 << int(g.integers(0, 30))) for v in low} | set(low) | {(5 << 40) + k for k in range(70)} | {int(x) for x in g.integers(0, 1 << 62, 50)}
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    tables = simhash.Tables(spark)
    found = {(r.a, r.b) for r in simhash.links(df, tables).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    label = {v: v for v in values}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in found:
        label[max(top(a), top(b))] = min(top(a), top(b))
    got = {v: top(v) for v in values}
    label = {v: v for v in values}
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2 and top(a) != top(b):
                label[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {v: top(v) for v in values}


def test_copies_of_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text of very many rows").otherwise(F.concat(F.lit("text "), F.col("id") * 7919, F.lit(" and "), F.col("id") * 31)).alias("text"))
    got = simhash.classes(rows).filter("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
