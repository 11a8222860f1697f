import random

import pytest
from llm_cases import ODD, clashing, docs

from galleyworks.llm import token_count

pytest.importorskip("sentencepiece")
PATH = "/opt/tokenizers/piece_bpe_32k.model"
PARTS = ["a", "the", "é", "  ", " ", "梦", "\n", "😀", "x▁", "ing", " \t"]


def library(pieces, known, least):
    from tokenizers import Tokenizer, models, normalizers

    model = Tokenizer(models.Unigram([("<unk>", least), *pieces, *([(f"<0x{i:02X}>", least) for i in range(256)] if known else [])], 0, known))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return model


def texts(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéthing") for _ in range(r.randint(1, 9))) for _ in range(300)]
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(500)] + [" ".join(r.choice(words) for _ in range(200)) for _ in range(20)] + ["word " * 2000, "unspaced" * 500]


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("kind", ["ranks", "fractions", "ties"])
def test_counts_of_the_library(known, kind):
    """Ranks; scores of a trained model's kind; scores of which many sums are equal but for rounding."""
    pieces, _ = token_count.read_vocabulary(PATH)
    r = random.Random(9)
    if kind == "fractions":
        pieces = [(p, -8 + r.gauss(0, 2)) for p, _ in pieces]
    elif kind == "ties":
        pieces = [(p, -0.1 * len(p)) for p, _ in pieces]
    least = min(s for _, s in pieces)
    count, model = token_count.WordCounter(pieces, known), library(pieces, known, least)
    given = texts()
    assert [count.whole(t) for t in given] == [len(e.ids) for e in model.encode_batch(given, add_special_tokens=False)]


def test_a_piece_across_words():
    pieces = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("a▁b", -1.0), ("▁a", -2.2)]
    count, model = token_count.WordCounter(pieces, False), library(pieces, False, -3.0)
    given = ["a b", "a a b b a b", "b", " a  b"]
    assert not count.cuttable and [count.whole(t) for t in given] == [len(e.ids) for e in model.encode_batch(given, add_special_tokens=False)]


def test_kept_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 100)
    pieces, known = token_count.read_vocabulary(PATH)
    a, b = token_count.WordCounter(pieces, known), token_count.WordCounter(pieces, known)
    b.room = 1 << 30
    given = texts(5)
    assert [a.whole(t) for t in given] == [b.whole(t) for t in given] and sum(map(len, a.kept)) <= 100


def test_table(spark):
    df = clashing(docs(spark, ODD), "tokens", "column")
    got = token_count.with_token_count(df, PATH)
    assert got.columns == [*df.columns, "n_tokens"]
    pieces, known = token_count.read_vocabulary(PATH)
    count = token_count.WordCounter(pieces, known)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted((i or -1, count.whole(t or "")) for i, t, _ in ODD)
    assert token_count.with_token_count(df.filter("false"), PATH).isEmpty()


def test_kept_parts_are_bounded_in_bytes(monkeypatch):
    """What is kept after very many different parts takes the bytes that are allowed, about."""
    import tracemalloc

    monkeypatch.setattr(token_count, "KEPT", 4 << 20)
    counter = token_count.WordCounter([("\u2581", -1.0), ("a", -2.0), ("b", -2.0)], True)
    tracemalloc.start()
    for i in range(60_000):
        counter.whole(f"w{i:07d}")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1.3 * (4 << 20) and len(counter.kept) < 30_000
