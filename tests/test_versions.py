import threading

import pytest
from pyspark.sql import functions as F

from galleyworks.sources.versions import Conflict, Registry


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/links"


def links(spark, *urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "ord long, url string")


def all_of(registry, version=None):
    return [(r.url, r.created_at, r.ord) for r in registry.read(version).orderBy("ord").collect()]


def test_appended_in_order_and_once(spark, place):
    r = Registry(spark, place)
    assert r.version() == 0 and r.read().isEmpty()
    assert r.add(links(spark, " x ", "y", "x", "", None), "t1") == 2 and r.add(links(spark, "y"), "t2") == 0 and r.version() == 1
    assert r.add(links(spark, "b", "y", "a"), "t3", "other") == 2
    assert all_of(r) == [("x", "t1", 0), ("y", "t1", 1), ("b", "t3", 2), ("a", "t3", 3)] and all_of(r, 1) == [("x", "t1", 0), ("y", "t1", 1)]
    assert r.add(links(spark), "t4") == 0 and {x.source for x in r.read().collect()} == {"submit_page", "other"}


def test_a_late_writer_begins_anew(spark, place, monkeypatch):
    a, b = Registry(spark, place), Registry(spark, place)
    a.add(links(spark, "x"), "t1")
    seen = b.version()
    a.add(links(spark, "z"), "t2")
    stale = iter([seen])
    monkeypatch.setattr(b, "version", lambda: next(stale, None) or Registry.version(b))
    assert b.add(links(spark, "w", "z"), "t3") == 1
    assert all_of(b) == [("x", "t1", 0), ("z", "t2", 1), ("w", "t3", 2)] and len(b._names("data")) == 3
    monkeypatch.setattr(b, "version", lambda: seen)
    with pytest.raises(Conflict):
        b.add(links(spark, "v"), "t4")
    assert len(a._names("data")) == 3 and [n for n, _ in a._names("versions") if n.endswith("tmp")] == []


def test_writers_in_a_race_add_all_once(spark, place):
    """Every writer has links of its own and shares others; whichever comes first, each link is there once and places have no gap."""
    told, begin = [], threading.Barrier(4)

    def work(k):
        registry = Registry(spark, place)
        begin.wait()
        for step in range(2):
            told.append(registry.add(links(spark, f"own-{k}-{step}", f"shared-{step}", f"shared-{(step + k) % 3}"), f"w{k}", attempts=20))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = all_of(Registry(spark, place))
    assert sorted(u for u, _, _ in rows) == sorted([f"own-{k}-{s}" for k in range(4) for s in range(2)] + ["shared-0", "shared-1", "shared-2"])
    assert [o for _, _, o in rows] == list(range(11)) and sum(told) == 11


def test_one_of_many_makes_a_version(spark, place):
    r, won = Registry(spark, place), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if r.commit(1, {"folders": {}, "by": k}) else None) for k in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and r.manifest(1)["by"] == won[0]


def test_a_writer_that_dies_hinders_nobody(spark, place, monkeypatch):
    r = Registry(spark, place)
    r.add(links(spark, "x"), "t1")
    monkeypatch.setattr(r, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        r.add(links(spark, "lost"), "t2")
    r.fs.create(r._at(f"{place}/versions/{'0' * 32}.tmp"), False).close()
    r.fs.create(r._at(f"{place}/data/part/_temporary/0/x"), False).close()
    other = Registry(spark, place)
    assert other.add(links(spark, "y"), "t3") == 1 and all_of(other) == [("x", "t1", 0), ("y", "t3", 1)]
    assert len(other._names("data")) == 4 and len(other.vacuum(older=-10)) == 3
    assert all_of(other) == [("x", "t1", 0), ("y", "t3", 1)] and len(other._names("data")) == 2 and other.vacuum() == []


def test_batches_of_a_stream_count_once(spark, place):
    r = Registry(spark, place)
    assert [r.add(links(spark, f"u{n}"), "t", batch=("s", n)) for n in (0, 1, 1, 0)] == [1, 1, 0, 0]
    assert r.add(links(spark, "u1"), "t", batch=("s", 2)) == 0 and r.manifest(r.version())["batches"] == {"s": 2}
    assert r.add(links(spark, "u1", "v"), "t", batch=("other", 0)) == 1


def test_folders_are_joined(spark, place, monkeypatch):
    monkeypatch.setattr(Registry, "MOST_FOLDERS", 3)
    r = Registry(spark, place)
    assert [r.add(links(spark, f"u{n}", "u0"), "t") for n in range(6)] == [1] * 6
    assert [o for _, _, o in all_of(r)] == list(range(6)) and len(r.manifest(6)["folders"]) == 3 and len(r.manifest(4)["folders"]) == 1
    assert len(r.vacuum(keep=1, older=-10)) == 5 + 3 and len(all_of(r)) == 6
    assert r.read().agg(F.countDistinct("url")).first()[0] == 6
