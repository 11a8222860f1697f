import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_cases import clashing

from galleyworks.llm import prefix_trie as P
from galleyworks.operators import order

SCHEMA = "conv_id long, turn long, role string, text string"


def truncated(c, n):
    return c - abs(c) % n * (1 if c >= 0 else -1)


def plain(rows):
    """The trie as nested prefixes in one dictionary."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, at = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(truncated(c, 20), [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        at.setdefault(seq, []).append(c)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(at.get(p, []))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df):
    return sorted((tuple(r) for r in P.conversation_trie(df).collect()), key=str)


def some(seed, n, longest, words=3):
    g = np.random.default_rng(seed)
    rows = []
    for c in g.choice(n * 2, n, replace=False).tolist():
        rows += [(c, t, str(g.choice(["user", "assistant"])), f"t{g.integers(0, 2)} " * int(g.integers(0, words))) for t in range(int(g.integers(1, longest)))]
    return rows


def test_odd_rows_equal_the_plain_trie(spark):
    rows = some(1, 40, 6) + [(101, None, "user", None), (101, None, None, "b\x0bc"), (101, 3, "user", "x"), (101, 3, "user", "x"), (101, 3, "assistant", "x"), (None, 1, "user", "lost"), (-7, 1, "user", "é 😀"), (-20, 0, "user", "é 😀"), (300, 1, "a", "b c"), (301, 1, "ab", " c"), (200, 5, "user", "w " * 20000)]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(3)]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "pos", "idx", "words", "a", "n", "depth")
    got = built(df)
    assert got == plain(rows)
    none = P.conversation_trie(df.filter("conv_id IS NULL"))
    assert none.columns == [c.split()[0] for c in P.NODE.split(", ")] and none.isEmpty()


@pytest.mark.parametrize("longest", [4, 30, 90])
def test_blocks_keys_and_pieces_of_a_few(spark, monkeypatch, longest):
    """Intervals across many blocks, keys ranked over several levels, digests and depths in pieces."""
    monkeypatch.setattr(order, "BLOCK_ROWS", 4)
    for name, value in (("CHUNK", 3), ("ENDS", 2), ("DEPTHS", 4)):
        monkeypatch.setattr(P, name, value)
    rows = some(longest, 60, longest) + [(c, t, "user", "deep") for c in (500, 501, 502, 540, 541) for t in range(longest + c % 3)]
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("rows", [[(20, 1, "u", "only one")], [(21, 1, "u", "x")], [(40, 1, "u", "a"), (60, 1, "u", "a")], [(0, 0, "u", "a b"), (80, 0, "u", "a b"), (80, 1, "u", "c")]])
def test_few_conversations(spark, rows):
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_nearest_smaller_and_minima():
    g = np.random.default_rng(0)
    v = g.integers(0, 9, 200)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(200)]
    assert P.smaller(v).tolist() == want
    a = g.integers(0, 200, 300)
    b = np.minimum(a + g.integers(0, 200, 300), 199)
    assert P.range_minima(v, a, b).tolist() == [int(v[x : y + 1].min()) for x, y in zip(a, b)]
