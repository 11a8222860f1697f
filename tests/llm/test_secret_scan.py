import hashlib
import random
import re
import time

from llm_cases import ODD, clashing, docs

from galleyworks.llm import secret_scan
from galleyworks.llm.secret_scan import KINDS, SCOPE

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def brute(t):
    """All spans, every part held against every other."""
    known = base(t)
    weak = lambda p, k: [(m.start(), k, m.end()) for m in re.finditer(p, t, re.A)]
    ident, opaque, endpoint = (weak(re.sub(r"\(\?i:(.*?)\)(?=[\[\]\"':]|\[)", r"(?i:\1)", p), k) for p, k in ((secret_scan.IDENT, 3), (secret_scan.OPAQUE, 4), (secret_scan.ENDPOINT, 5)))
    opaque = [x for x in opaque if not any(x[0] < y[2] and y[0] < x[2] for y in known)]
    near = lambda x, ys: any(x[0] <= y[2] + SCOPE and y[0] <= x[2] + SCOPE and (x[2] <= y[0] or y[2] <= x[0]) for y in ys)
    who = [x for x in known if x[1] == 1] + ident
    opaque = [x for x in opaque if near(x, who)]
    secret = [x for x in known if x[1] != 1] + opaque
    endpoint = [x for x in endpoint if near(x, who) and near(x, secret)]
    ident = [x for x in ident if near(x, secret)]
    return sorted(known + ident + opaque + endpoint)


def text_of(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_against_brute_force(spark):
    r = random.Random(6)
    parts = ["user_name: bob77", "login = alice", "AKIA" + "AB12CD34EF56GH78", "Ab3/" * 11, "0123456789abcdef" * 2, "https://s3.example.com/bucket", "postgres://db.example.com:5432/x", "token=abcdefgh1", "password: 'short'", "😀", "pad " * 150, "word", "\n"]
    texts = [t for _, t, _ in ODD] + ["token=api_key: abcdefgh12", "token=ab token=abcdefghij" + "0f" * 20, "token=aaaaaaaaaa " * 300]
    texts += [" ".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(120)]
    df = clashing(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), "assign", "spans", "opaque")
    got = {x.doc_id: x for x in secret_scan.digests(df).collect()}
    linked = 0
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i].base_sha256 == hashlib.sha256(text_of(sorted(base(t))).encode()).hexdigest(), t[:200]
        assert got[i].spans == text_of(brute(t)), t[:300]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base(t)) for n in range(3))
        linked += any(k > 2 for _, k, _ in brute(t))
    assert linked > 40 and secret_scan.digests(df.filter("false")).isEmpty()


def test_alone_weak_parts_are_no_secret(spark):
    rows = [(0, "Ab3/" * 11, "a"), (1, "https://s3.example.com/x", "a"), (2, "user_name: bob77", "a"), (3, "user_name: bob77 " + "pad " * 150 + "Ab3/" * 11, "a")]
    assert {x.spans for x in secret_scan.digests(docs(spark, rows)).collect()} == {""}


def test_a_text_of_very_many_parts(spark):
    t = ("user_name: bob77 " + "Ab3/" * 11 + " https://s3.example.com/x " + "pad " * 120) * 4000
    began = time.time()
    got = secret_scan.digests(docs(spark, [(1, t, "a")])).first().spans
    assert got.count("opaque") == got.count("endpoint") == got.count("ident") == 4000 and time.time() - began < 90
