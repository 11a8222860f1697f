import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleyworks.operators import archive as A
from galleyworks.sources import assets
from galleyworks.sources.cache import ArticleCache
from galleyworks.shared import written
from galleyworks.streaming import streams
from galleyworks.streaming.counters import VisitCounters


def test_positions_over_the_whole(spark):
    rows = [(i, [None, 5, 5, 9, 1][i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "ord int, t int").repartition(7)
    want = [i for i, t in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    got = A.positions(df, F.col("t"), "ord")
    assert got.columns == ["ord", "t", "position"] and [r.ord for r in got.orderBy("position").collect()] == want
    assert A.positions(df.filter("false"), F.col("t"), "ord").isEmpty()


HITS = "event_id long, ts timestamp_ntz, day string, visitor string, page string, article_id string, counted boolean"


def hits(spark, seed, days=(1, 2), n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        d = days[i * len(days) // n]
        rows.append((i, f"2024-01-{d:02d} {i % 24:02d}:{i % 60:02d}:00", f"2024-01-{d:02d}", f"v{r.randint(0, 9)}", *r.choice([("site", None), ("article", "a"), ("article", "b")]), r.random() < 0.8))
    return spark.createDataFrame(rows, HITS.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def counted(df):
    return sorted((r.event_id, r.site_pv, r.site_uv, r.article_pv) for r in df.collect())


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/store"


def test_counters_over_batches_equal_one_batch(spark, place, monkeypatch):
    monkeypatch.setattr(VisitCounters, "MOST_MARKS", 2)
    df = hits(spark, 1, days=(1, 2, 3, 7))
    df = written(df.orderBy("ts", "event_id").withColumn("nth", F.row_number().over(A.Window.orderBy("ts", "event_id"))), "hits")
    store, out = VisitCounters(spark, place), []
    for k in range(5):
        part = df.filter((F.col("nth") > k * 24) & (F.col("nth") <= (k + 1) * 24))
        out += counted(store.apply(part, "s", k))
        assert counted(store.apply(part.limit(1), "s", k)) == sorted(out[-24:])  # applied again, it is what it was
    assert sorted(out) == counted(A.snapshots(df)) and store.version() == 5
    with pytest.raises(ValueError):
        store.apply(df, "s", 3)
    totals = {(r.kind, r.key): r.n for r in store.counters().collect()}
    assert totals["site", ""] == df.filter("counted").count() and totals["day", "2024-01-07"] == df.filter("counted AND day = '2024-01-07'").select("visitor").distinct().count()
    assert store.apply(df.filter("false"), "other", 0).isEmpty()
    assert store.vacuum(keep=1, older=-10) and {(r.kind, r.key): r.n for r in store.counters().collect()} == totals and counted(store.apply(df, "s", 4)) == sorted(out[-24:])


def test_cache_rewrites_changed_parts_alone(spark, place, tmp_path, monkeypatch):
    monkeypatch.setattr(ArticleCache, "PARTS", 8)
    cache = ArticleCache(spark, place, "url string, ord int, title string")
    made = lambda rows: spark.createDataFrame(rows, "title string, url string, ord int, extra string")
    first = [(f"t{i}", f"u{i}", i, "x") for i in range(60)]
    assert cache.read().isEmpty() and cache.update(made(first + [("old", "u3", -1, None), ("lost", None, 1, None)])) == list(range(8))
    files = lambda: {f for f in Path(tmp_path).rglob("*.parquet")}
    before = files()
    assert cache.update(made(first[:10])) == [] and cache.version() == 1 and files() == before
    touched = cache.update(made([*first[:5], ("new", "u7", 7, None), ("more", "u99", 99, None)]))
    assert 1 <= len(touched) <= 2 and cache.version() == 2 and before < files()
    parts = cache.manifest(2)["parts"]
    assert {k: f for k, f in parts.items() if int(k) not in touched} == {k: f for k, f in cache.manifest(1)["parts"].items() if int(k) not in touched}
    got = {r.url: (r.ord, r.title) for r in cache.read().collect()}
    assert got == {f"u{i}": (i, f"t{i}") for i in range(60)} | {"u7": (7, "new"), "u99": (99, "more")}
    assert {r.url: r.title for r in cache.read(1).collect()}["u7"] == "t7"


def test_unused_asset_folders_go(spark, tmp_path):
    base = tmp_path / "images"
    for f in ("stay/a.png", "stay/deep/b.png", "go/c.png", "back/d.png"):
        (base / f).parent.mkdir(parents=True, exist_ok=True)
        (base / f).write_bytes(b"123")
    (base / "loose.png").write_bytes(b"1")
    articles = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    folders = assets.asset_folders(spark, f"file://{base}")
    assert sorted((r.id, r.files, r.bytes) for r in folders.collect()) == [("back", 1, 3), ("go", 1, 3), ("stay", 2, 6)]
    marks = written(assets.unused(folders, articles("stay", None, "", "other")), "marks")
    assert sorted(r.id for r in marks.collect()) == ["back", "go"]
    assert [(r.id, r.removed) for r in assets.sweep(marks, articles("stay", "back")).collect()] == [("go", True)]  # one has reappeared
    assert sorted(p.name for p in base.iterdir()) == ["back", "loose.png", "stay"]
    assert [(r.id, r.removed) for r in assets.sweep(marks, articles("stay", "back")).collect()] == [("go", False)]
    assert assets.asset_folders(spark, f"file://{tmp_path}/none").isEmpty()


def plain_lookups(rows, since=None):
    """Row by row, in order of second and request."""
    out = []
    for second, request, debug in sorted(rows):
        if debug or since is None or second - since >= streams.RESULT_LIFE:
            out.append((second, request))
            since = max(second, since) if since is not None else second
    return out, since


def test_folded_seconds_equal_single_requests():
    r = random.Random(2)
    import pandas as pd

    for n in (0, 1, 5, 60):
        for _ in range(40):
            rows = [(r.randint(0, 30_000) // r.choice([1, 60, 900]), k, r.random() < 0.1) for k in range(n)]
            frame = pd.DataFrame(rows, columns=["second", "request", "debug"]).astype({"second": "int64", "request": "int64", "debug": bool})
            before = r.choice([None, 4000])
            got, since = streams.looked_up(streams._first_requests(frame) if n else np.zeros((0, 3), np.int64), before)
            want, after = plain_lookups(rows, before)
            debugs = [(s, q) for s, q, d in rows if d]
            assert sorted(got + debugs) == sorted(want) and since == after


def test_results_live_over_batches_and_hot_keys(spark, tmp_path):
    inbox = tmp_path / "in"

    def run():
        stream = spark.readStream.schema("ip string, request long, ts timestamp, debug boolean").parquet(str(inbox))
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        streams.cached_lookups(stream, "1 day").writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        return sorted((r.ip, r.request) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    spark.range(300_000).select(F.lit("hot").alias("ip"), F.col("id").alias("request"), at(F.floor(F.col("id") / 50)).alias("ts"), F.lit(False).alias("debug")).repartition(4).write.parquet(str(inbox))
    assert run() == [("hot", 0), ("hot", 180_000)]
    more = spark.createDataFrame([("hot", 400_000, 7199, False), ("hot", 400_001, 7200, None), ("b", 1, 7000, True), ("b", 2, 7001, False)], "ip string, request long, s int, debug boolean")
    more.select("ip", "request", at(F.col("s")).alias("ts"), "debug").write.mode("append").parquet(str(inbox))
    assert run() == [("b", 1), ("hot", 0), ("hot", 180_000), ("hot", 400_001)]
