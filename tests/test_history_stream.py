import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from galleyworks.sources import history


@pytest.fixture
def server():
    """Histories of 3 pages (`/a`, `/b`), one that fails at its second page the first time (`/c`); and a receiver that knows keys."""
    asked, got, keys, fail = [], [], set(), {"/c?offset=1"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if self.path in fail:
                fail.discard(self.path)
                self.send_error(503)
                return
            page = int(parse_qs(urlsplit(self.path).query).get("offset", ["0"])[0])
            self.answer({"page": page, "next_offset": page + 1 if page < 2 else None, "ret": 0})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            key = self.headers["Idempotency-Key"]
            if key not in keys:
                got.append(body["links"])
                keys.add(key)
            if "refuse" in fail:
                fail.discard("refuse")  # the links are in, but the answer is lost
                self.send_error(500)
                return
            self.answer({"success": body["password"] == "p"})

        def answer(self, data):
            body = json.dumps(data).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked, got, fail
    httpd.shutdown()


def run(spark, tmp_path, address, paths, stop_at=None, **options):
    """The stream until nothing is due, into a table with a folder a batch."""
    spark.dataSource.register(history.HistorySource)
    starts = json.dumps([address + p for p in paths])
    given = {"starts": starts, "positions": f"file://{tmp_path}/positions", "max_pages": 9, "pause": 0, "rounds": 1} | options

    def write(batch, n):
        if n == stop_at:
            batch.count()  # pages are read, and then the batch fails
            raise RuntimeError("stopped")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")

    query = spark.readStream.format("history").options(**given).load().writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((urlsplit(r.start).path, r.page, r.error is None) for r in rows)


def test_each_page_once_over_a_restart(spark, server, tmp_path):
    address, asked, _, _ = server
    with pytest.raises(Exception, match="stopped"):
        run(spark, tmp_path, address, ["/a", "/b"], stop_at=1)
    before = len(asked)
    assert run(spark, tmp_path, address, ["/a", "/b"]) == [(p, n, True) for p in ("/a", "/b") for n in range(3)]
    resumed = asked[before:]
    assert "/a" not in resumed and resumed[0].endswith("offset=1")  # not from the beginning


def test_an_error_is_a_row_and_the_next_round_goes_on(spark, server, tmp_path, monkeypatch):
    address = server[0]
    got = run(spark, tmp_path, address, ["/c", "/a"], batch_pages=2)
    assert got == [("/a", 0, True), ("/a", 1, True), ("/a", 2, True), ("/c", 0, True), ("/c", 1, False)]
    # a round later, as time has come: a new round begins at the first page
    for f in (tmp_path / "positions").glob("*/*"):
        f.write_text(json.dumps(json.loads(f.read_text()) | {"not_before": 0}))
    got = run(spark, tmp_path, address, ["/c", "/a"], rounds=2)
    assert got.count(("/c", 1, True)) == 1 and got.count(("/c", 2, True)) == 1 and got.count(("/a", 0, True)) == 2


def test_rounds_wait_for_their_time(spark, server, tmp_path):
    assert len(run(spark, tmp_path, server[0], ["/a"], rounds=0, interval=0, max_pages=2)) == 2  # the next round is a minute away
    assert len(run(spark, tmp_path, server[0], ["/a"], rounds=0, max_pages=2)) == 2


def test_links_are_submitted_once(spark, server, tmp_path):
    address, _, got, fail = server
    spark.dataSource.register(history.SubmitSink)
    inbox = tmp_path / "in"
    inbox.mkdir()

    def submit():
        links = spark.readStream.text(str(inbox)).select(F.col("value").alias("url"))
        writer = links.writeStream.format("submit").option("address", address + "/s").option("password", "p").option("checks", f"file://{tmp_path}/checks")
        writer.option("checkpointLocation", f"{tmp_path}/sink").trigger(availableNow=True).start().awaitTermination()

    (inbox / "1.txt").write_text("\n".join(f"https://a/{i}" for i in range(120)))
    fail.add("refuse")
    with pytest.raises(Exception):
        submit()
    submit()  # the batch is sent again, with the same keys
    assert sorted(map(len, got)) == [20, 50, 50] and len({u for x in got for u in x}) == 120
    (inbox / "2.txt").write_text("https://a/1")
    submit()
    assert got[3:] == [["https://a/1"]]  # another batch may send a link anew
    checks = [json.loads(f.read_text()) for f in sorted((tmp_path / "checks").glob("*/*"))]
    assert [(c["batch"], c["links"], c["requests"]) for c in checks] == [(0, 120, 3), (1, 1, 1)]
