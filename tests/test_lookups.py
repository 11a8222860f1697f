import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from galleyworks.functions import extract as X
from galleyworks.operators import iprisk
from galleyworks.session import prepare
from galleyworks.sources import lookups


@pytest.fixture
def server():
    asked = defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.headers["Host"].split(":")[0]].append((time.monotonic(), self.path, self.headers["X-Key"]))
            if "missing" in self.path:
                return self.send_error(404)
            if "slow" in self.path:
                time.sleep(3)
            body = f"<title>é {self.path}</title><article>{'word ' * 20}</article>".encode()
            self.send_response(200)
            self.end_headers()
            try:
                if "drops" in self.path:
                    for b in body[:40]:
                        self.wfile.write(bytes([b]))
                        self.wfile.flush()
                        time.sleep(0.1)
                else:
                    self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield httpd.server_address[1], asked
    httpd.shutdown()


def test_pace_of_each_host(spark, server):
    prepare(spark)
    port, asked = server
    urls = [(f"http://{h}:{port}/{i}",) for h in ("127.0.0.1", "localhost") for i in range(6)] * 2  # repeats are asked once
    began = time.monotonic()
    got = lookups.answers(spark.createDataFrame(urls, "url string").repartition(4), "url", F.col("url"), {"X-Key": "k"}, pace=0.3).collect()
    took = time.monotonic() - began
    assert len(got) == 12 and all(r.error is None and r.body.startswith("<title>é /") for r in got)
    for calls in asked.values():
        times = sorted(t for t, _, _ in calls)
        # the server's times hold the delays of its connections, too
        assert len(times) == 6 and times[-1] - times[0] > 1.25 and all(b - a > 0.15 for a, b in zip(times, times[1:])) and {k for _, _, k in calls} == {"k"}
    assert took < 60


def test_turns():
    pacer, given = lookups._Pacer(0.05, 2), []
    rows = [("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")]
    for i in pacer.ordered(rows):
        given.append((i, time.monotonic()))
        if len(given) == 2:  # both requests are under way: the next waits for one of them, also where it is a host's turn
            threading.Timer(0.3, lambda: [pacer.free.release() for _ in range(2)]).start()
    assert sorted(i for i, _ in given) == [0, 1, 2, 3] and [i for i, _ in given][:2] == [0, 2]
    of_a = [t for i, t in given if rows[i][0] == "a"]
    assert all(b - a >= 0.05 for a, b in zip(of_a, of_a[1:])) and given[2][1] - given[1][1] > 0.25


def test_failures_are_rows(spark, server):
    prepare(spark)
    port, asked = server
    base = f"http://127.0.0.1:{port}"
    rows = [f"{base}/ok", f"{base}/missing", f"{base}/slow", f"{base}/drops", "http://127.0.0.1:1/refused", "no url", "ftp://x/y", "", None]
    got = {r.url: r for r in lookups.answers(spark.createDataFrame([(u,) for u in rows], "url string"), "url", F.col("url"), pace=0.0, seconds=1.0, body="html").collect()}
    assert set(got) == set(rows) and got[f"{base}/ok"].error is None
    assert [got[u].error for u in rows[1:]] == ["HTTPError", "TimeoutError", "TimeoutError", "URLError", "ValueError", "ValueError", "ValueError", "ValueError"]
    assert all(got[u].html is None for u in rows[1:])
    empty = lookups.answers(spark.createDataFrame([], "url string"), "url", F.col("url"))
    assert empty.columns == ["url", "body", "error"] and empty.count() == 0


def test_answers_become_articles(spark, server):
    prepare(spark)
    port, _ = server
    links = spark.createDataFrame([(f"http://127.0.0.1:{port}/a",), (f"http://127.0.0.1:{port}/missing",)], "url string")
    found = lookups.answers(links, "url", F.col("url"), pace=0.0, body="html")
    got = {r.url.rsplit("/", 1)[1]: r for r in X.fetched(links, found, F.lit("2024-01-01")).collect()}
    assert (got["a"].success, got["a"].title) == (True, "é /a") and (got["missing"].success, got["missing"].error) == (False, X.REQUEST_FAILED + "HTTPError")


def test_repeated_answers(spark):
    prepare(spark)
    links = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    page = f"<title>t</title><article>{'word ' * 20}</article>"
    responses = spark.createDataFrame([("u", None, "Timeout"), ("u", page, None), ("u", page, None), ("v", None, "Timeout"), ("v", None, None)], "url string, html string, error string")
    got = {r.url: (r.success, r.error) for r in X.fetched(links, responses, F.lit("now")).collect()}
    assert got == {"u": (True, ""), "v": (False, X.REQUEST_FAILED + "ConnectionError"), "w": (False, X.REQUEST_FAILED + "ConnectionError")}
    table = spark.createDataFrame([("1.1.1.1", None, "slow"), ("1.1.1.1", '{"data":{"abuseConfidenceScore":0,"totalReports":0}}', None)], "ip string, body string, error string")
    rows = iprisk.lookups(spark.createDataFrame([("1.1.1.1",)], "ip string"), {"abuse": table}).collect()
    assert len(rows) == 1 and rows[0].abuse.status == "ok"
