import random

from llm_cases import ODD, clashing, docs
from pyspark.sql import functions as F

from galleyworks.llm import packing


def test_packing(spark):
    df = docs(spark, [*ODD, *[(10 + i, "same text here", f"s{i % 3}") for i in range(9)]])
    rows = packing.pack(df, capacity=100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.n_words for r in rows) == 30000 + 2 + 2 + 27
    for inside in bins.values():
        assert sum(r.n_words for r in inside) <= 100 and len({r.cluster for r in inside}) == len(inside) == len({r.source for r in inside})
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_deals_rows_alike(spark):
    """Many rows alike do not meet in one shard."""
    rows = packing.pack(docs(spark, [(None, None, "a")] * 3000 + [(i, f"w{i} " * 5, "b") for i in range(200)]), capacity=100, shard_rows=100).collect()
    shards = {}
    for x in rows:
        shards.setdefault(x.bin_id.split("-")[0], []).append(x)
    assert len(rows) == 3200 and sum(x.n_words for x in rows) == 1000 and max(map(len, shards.values())) < 300


def test_best_fit_against_plain_search():
    r = random.Random(4)
    items = [(r.randint(0, 50), r.randint(0, 5), r.randint(0, 20)) for _ in range(400)]
    items.sort(key=lambda x: -x[0])
    made = packing.pack_rows(*map(list, zip(*items)), 50)
    room, inside, want = [], [], []
    for row, (size, s, c) in enumerate(items):
        fit = [(room[b], b) for b in range(len(room)) if room[b] > 0 and room[b] >= size and all(s != x and c != y for x, y in inside[b])]
        b = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(50)
            inside.append([])
        room[b] -= size
        inside[b].append((s, c))
        want.append((row, b))
    assert [(m[0], m[4]) for m in made] == want


def test_texts_can_be_read_from_the_pieces(spark):
    """Exact round trip: pieces in order are the text with all its white space."""
    r = random.Random(5)
    texts = ["".join(r.choice(["word", "é😀", " ", "  ", "\n", "\t", "\u00a0"]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)] + [(None, "  two words ", None), (7, texts[7], "b"), (80, None, "a"), (81, "", "a"), (82, " \n ", "a"), (83, "long " * 30_000 + "\n", "a")]
    df = clashing(docs(spark, rows), "h1", "h2", "tie", "bin_id", "start", "piece")
    got = packing.packed_texts(df, capacity=50).collect()
    by = {}
    for x in sorted(got, key=lambda x: x.piece):
        by.setdefault((x.doc_id, x.source), []).append(x)
    for i, t, s in rows:
        if (i, s) != (7, "b"):
            mine = [x for x in by[(i, s)]]
            assert "".join(x.text for x in mine) == (t or "") and [x.start for x in mine] == [sum(y.n_words for y in mine[:k]) for k in range(len(mine))]
    assert sorted(x.text for x in got if x.doc_id == 7 and x.piece == 0) == sorted([x.text for x in by[(7, "b")] if x.piece == 0])
    assert sum(x.n_words for x in got) == df.select(F.sum(packing.size_of(F.col("text")))).first()[0]
    assert packing.packed_texts(df.filter("false")).isEmpty()


def test_a_source_of_a_third_of_all_rows(spark):
    rows = packing.pack(docs(spark, [(i, f"w{i} " * (i % 40 + 1), "hot" if i % 3 == 0 else f"s{i % 50}") for i in range(900)]), capacity=100, shard_rows=200).collect()
    bins = {}
    for x in rows:
        bins.setdefault(x.bin_id, []).append(x)
    assert len(rows) == 900 and all(sum(x.n_words for x in b) <= 100 and len({x.source for x in b}) == len(b) for b in bins.values())
    # places within a bin follow each other without gaps
    for b in bins.values():
        b.sort(key=lambda x: (x.bin_start, x.n_words))
        assert [x.bin_start for x in b] == [sum(y.n_words for y in b[:k]) for k in range(len(b))]


def test_pieces_of_very_long_and_of_shared_texts(spark):
    """A text of 10^6 words is cut once, not once a piece; a text that very many rows share is joined like others."""
    import time

    from pyspark.sql import functions as F

    long = " ".join(["w"] * 1_000_000) + "  "
    rows = spark.createDataFrame([(1, long, "a")], "doc_id long, text string, source string")
    rows = rows.unionByName(spark.range(3000).select((F.col("id") + 10).alias("doc_id"), F.lit(" one text\n of all ").alias("text"), F.lit("b").alias("source")))
    began = time.time()
    got = packing.packed_texts(rows).select("doc_id", "piece", "start", "text").collect()
    assert time.time() - began < 120
    assert "".join(r.text for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)) == long
    assert len(got) == 3000 + max(r.piece for r in got) + 1 and {r.text for r in got if r.doc_id != 1} == {" one text\n of all "}
