import re
from collections import Counter

import duckdb
from llm_cases import clashing, docs
from test_neardup import brute_classes

import corpus_pipeline
from galleyworks.llm import neardup, packing, pii, toxicity
from galleyworks.llm.oracles import OP6

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    """Each stage on what its predecessor kept: scores one by one, all pairs of texts, entities by a pattern of Python's, SQL for the mix, and a round trip of the packed texts."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    stages, before = dict(corpus_pipeline.STAGES), source
    kept = {}
    for name, stage in list(stages.items())[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == source.columns, name
        kept[name], before = (before.collect(), after.collect()), after
    model = toxicity.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    was, now = kept["toxicity"]
    low = [r for r in was if toxicity.score_batch(pa.array([r.text or ""], pa.large_string()), model.gram_scores(), model.bias)[0][0] < 0.5]
    assert Counter(low) == Counter(now) and 0 < len(now) < len(was)

    was, now = kept["minhash near-dedup"]
    was.sort(key=lambda r: r.doc_id)
    label = brute_classes([r.text or "" for r in was], neardup.idf_table(docs(spark, [(r.doc_id, r.text, "a") for r in was])))
    assert sorted(r.doc_id for r in now) == sorted(was[i].doc_id for i in range(len(was)) if label[i] == i) and len(now) < len(was)

    was, now = kept["pii surrogates"]
    new = {r.doc_id: r for r in now}
    assert len(now) == len(was)
    mails, changed = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0
    for r in was:
        t = new[r.doc_id].text or ""
        assert not set(mails.findall(r.text or "")) & set(mails.findall(t)) and new[r.doc_id].n_chars == len(t)
        changed += t != (r.text or "")
        if t != (r.text or ""):
            assert re.search(r"@|\d|" + pii.TITLE.replace(r"\x20", " "), r.text)
    assert changed

    was, now = kept["source mixing"]
    documents = spark.createDataFrame(was, source.schema).toPandas()  # noqa: F841
    taken = {i: (size, words) for i, size, _, _, words in duckdb.sql(OP6).fetchall()}
    times = Counter(r.doc_id for r in now)
    assert all(times[i] * size == words for i, (size, words) in taken.items())

    packed = corpus_pipeline.run(spark, SF).collect()
    texts, bins, pieces = Counter(), {}, {}
    for x in packed:
        bins.setdefault(x.bin_id, []).append(x)
        if x.piece == 0 and x.n_words < packing.CAPACITY:
            texts[x.text] += 1
        else:
            pieces[x.doc_id] = pieces.get(x.doc_id, 0) + x.n_words
    assert all(sum(x.n_words for x in b) <= packing.CAPACITY for b in bins.values())
    short = [r for r in now if len(re.findall(r"[^ \t-\r]+", r.text or "")) < packing.CAPACITY]
    assert texts == Counter(r.text or "" for r in short)
    assert sum(x.n_words for x in packed) == sum(len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in now)


def test_odd_tables_pass_every_stage(spark):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "joe@x.com wrote", "a"), (2, "joe@x.com wrote", "a"), (None, "w " * 9000, "b"), (3, "Mr. Bo Li", None)]
    df = clashing(docs(spark, rows), "score", "label", "id", "of", "found", "bin_id", "h1")
    for table in (df, df.filter("false")):
        frame = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == df.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert packed.isEmpty() == table.isEmpty() and "text" in packed.columns
