import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import fingerprint


def expected(spark, rows):
    """(doc_id, n_chars, edited hash) of every row: all of them in order of id, hash and text, one after another."""
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i if i is not None else fingerprint.LEAST, hashes[t or ""], t or "", i) for i, t, _ in rows), key=lambda r: r[:3])
    out = Counter()
    for k, (_, _, t, i) in enumerate(order):
        after, n = order[(k + 1) % len(order)][2], len(t) // 2
        out[(i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())] += 1
    return out


def found(df):
    rows = fingerprint.edited_fingerprints(df).collect()
    return rows, Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)


def prose(r, n):
    return " ".join(f"w{r.randint(0, 300)}" for _ in range(n))


def test_next_documents(spark):
    rows = [(i, f"{i} " + " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(80)), "a") for i in range(40)] + ODD + [(7, "repeated id", "a")]
    got, counted = found(clashing(docs(spark, rows), "key", "hash", "bucket", "guest", "n", "hot", "parts"))
    assert counted == expected(spark, rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), set()).add((r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.fingerprint == "") == (r.n_chars == 0)
    assert fingerprint.edited_fingerprints(docs(spark, rows).filter("false")).isEmpty()


def test_one_row_follows_itself(spark):
    rows = [(5, "only one text here", "a")]
    got, counted = found(docs(spark, rows))
    assert counted == expected(spark, rows) and got[0].near_next == 1.0


@pytest.mark.parametrize("kind", ["null ids", "alike", "last", "one id"])
def test_an_id_of_very_many_rows(spark, kind):
    r = random.Random(3)
    rows = [(i, prose(r, 12), "a") for i in range(150)]
    if kind == "null ids":
        rows += [(None, prose(r, r.randint(0, 9)), "a") for _ in range(900)]
    elif kind == "alike":
        rows += [(70, "the very same text", "a")] * 20_000 + [(70, prose(r, 5), "a") for _ in range(300)]
    elif kind == "last":
        rows += [(10**6, prose(r, 4), "a") for _ in range(900)] + [((1 << 63) - 1, "x y", "a")] * 700
    else:
        rows = [(3, prose(r, 3), "a") for _ in range(800)]
    _, counted = found(docs(spark, rows).repartition(5))
    assert counted == expected(spark, rows)


def test_likeness_against_all_phrases():
    """The sketch's estimate is near the Jaccard similarity of all phrase names; equal substrings share names wherever they stand."""
    r = random.Random(4)
    for _ in range(12):
        a = prose(r, 700).split()
        b = a[:]
        for _ in range(r.randint(0, 60)):
            b[r.randrange(len(b))] = "changed"
        x, y = " ".join(a), " ".join(["moved", "by", "some"] + b)
        names = []
        for t in (x, y):
            level, row = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(len(t), np.int64)
            with np.errstate(over="ignore"):
                for _ in range(max(fingerprint.LEVELS)):
                    level, row = fingerprint.level(level, row)
            names.append(set(level.tolist()))
        exact = len(names[0] & names[1]) / len(names[0] | names[1])
        p, q = fingerprint.sketches([x, y])
        assert abs(fingerprint.likeness(p, q) - exact) < 0.3 and fingerprint.likeness(p, p) == 1.0
    text = " ".join(f"w{k * k % 9973}" for k in range(400))
    a, b = fingerprint.sketches([text, "some words before it " + text])
    assert fingerprint.likeness(a, b) > 0.8
    assert fingerprint.likeness(*fingerprint.sketches(["", ""])) == 1.0 and fingerprint.likeness(*fingerprint.sketches(["", "a"])) == 0.0


def test_with_fingerprint(spark):
    df = docs(spark, ODD)
    got = fingerprint.with_fingerprint(df).filter("doc_id = 2").collect()
    assert len(got) == 2 and {r.fingerprint for r in got} == {""}
