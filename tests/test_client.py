import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, parse_qsl, urlencode, urlsplit, urlunsplit

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galleyworks.functions import client as C
from galleyworks.plans import client_queries as Q
from galleyworks.plans import queries
from galleyworks.sources import files, history
from galleyworks.streaming import streams
from tests.test_archive import SF, plain, values

NAMES = [n for n in queries.QUERIES if queries.QUERIES[n].__module__ == Q.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "events", "customer"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, SF).toPandas()).equals(plain(c.sql(queries.ORACLES[name]).df()))


def test_small_functions(spark):
    bodies = ["[]", "junk", None, '{"ret":0}', '{"ret":"0"}', '{"ret":-3,"errmsg":"no session"}', '{"ret":0,"base_resp":{"ret":200,"err_msg":"slow"}}', '{"ret":7,"base_resp":{"ret":0}}']
    assert values(spark, C.history_problem, bodies) == ["not a JSON object"] * 3 + [None, None, "ret=-3 no session", "ret=200 slow", None]
    assert values(spark, C.history_links, [None, "{}", '{"general_msg_list":{"list":[{},{"app_msg_ext_info":{"content_url":"https:\\/\\/mp.weixin.qq.com\\/s"}}]}}']) == [[], [], ["https://mp.weixin.qq.com/s"]]
    assert [tuple(r) for r in values(spark, C.typed_links, ["https://a\n\nhttps://a \n", "https://a\nx", "", None])] == [(["https://a"], True), (["https://a", "x"], False), ([], False), ([], False)]
    assert values(spark, lambda m: C.missing_keys(m, ["a", "b"]), [{"a": "x", "b": ""}, {}], "map<string,string>") == [["b"], ["a", "b"]]
    assert values(spark, lambda c: C.url_join(F.lit("http://a/b/c?d"), c), ["../x", "//h/y", "?q", "", "http://[x", None]) == ["http://a/x", "http://h/y", "http://a/b/c?q", "http://a/b/c?d", "http://[x", None]
    assert values(spark, C.candidate_address, ["a 1 udp 2 1.2.3.4 9 typ host", "a 1 udp 2 x y.local typ", "a b typ", "typ", "", None]) == ["1.2.3.4", "y.local", "b", "", "", ""]


def test_update_query_equals_the_standard_library(spark):
    def plain(url, key, value):
        parts = urlsplit(url)
        return urlunsplit(parts._replace(query=urlencode(dict(parse_qsl(parts.query, keep_blank_values=True)) | {key: value})))

    urls = [
        "https://h/p", "https://h/p?", "HTTPS://h/P?a=1#f", "h/p?a=1&offset=0&b=", "?offset=3&offset=4&x", "https://h/p?a=1&a=2&b=3#", "https://h/p?x=%E6%96%87+y&z=a%20b&*=~",
        "https://h/p?bad=%zz&p=100%&q=a=b=c", "https://h/p?&&a&&", "https://h/p#only?fragment", "https://h/p?ä=ö&t=\u65f6", "", "https://h/p?a=1?b=2",
    ]
    for key, value in [("offset", "10"), ("a", "x y&z"), ("\u65f6~*", "")]:
        assert values(spark, lambda c: C.update_query(c, F.lit(key), F.lit(value)), [*urls, None]) == [plain(u, key, value) for u in urls] + [None]  # noqa: B023
    assert values(spark, lambda c: C.update_query(c, F.lit("k"), F.lit(None).cast("string")), ["h?a=1"]) == ["h?a=1&k="]
    assert values(spark, lambda c: C.update_query(c, F.lit(None).cast("string"), F.lit("v")), ["h"]) == [None]


def test_files(spark, tmp_path):
    assert files.whole_files(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "links.json").write_text('[" https://a ", {"url": "https://b"}, {"u": 1}, 7, null, ""]')
    assert [tuple(r) for r in files.registry_links(files.whole_files(spark, str(tmp_path / "links.json"))).orderBy("ord").collect()] == [(0, "https://a"), (1, "https://b")]
    (tmp_path / "links.txt").write_text("# c\n\n https://a \n")
    assert [r[0] for r in files.text_links(spark.read.text(str(tmp_path / "links.txt"))).collect()] == ["https://a"]
    assert values(spark, lambda c: files.json_or_default(c, "array<int>", F.array(F.lit(0))), ["[1]", "[", None]) == [[1], [0], [0]]
    assert values(spark, lambda c: files.remote_registry(F.lit(200), c), ["WyIx\nIl0=", "/w==", "e", None]) == ['["1"]', "[]", "[]", "[]"]
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.strict_json(spark, str(tmp_path / "bad.json"), "a int").collect()
    rows = spark.createDataFrame([("a", True, 1), ("a", True, 2), ("a", False, 3), ("", True, 4), (None, True, 5)], "url string, success boolean, ord int")
    assert [tuple(r) for r in files.cached_articles(rows, "ord").collect()] == [("a", True, 2)]
    files.write_cache(rows, str(tmp_path / "cache"))
    assert spark.read.json(str(tmp_path / "cache")).count() == 5
    files.write_pages(spark.createDataFrame([("ab1", "<p>")], "article_id string, html string"), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).filter("part = 'ab'").count() == 1


@pytest.fixture(scope="module")
def server():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, said):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def do_GET(self):
            offset = int(parse_qs(urlsplit(self.path).query).get("offset", ["0"])[0])
            self.answer({"ret": 0, "next_offset": offset + 10 if offset < 20 else None})

        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(sent["links"])
            self.answer({"success": sent["password"] == "p", "message": "no"})

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", got
    httpd.shutdown()


def test_history_source(spark, server):
    spark.dataSource.register(history.HistorySource)
    read = lambda most: spark.read.format("history").option("starts", json.dumps([server[0] + "/a?x=1", "http://127.0.0.1:1/"])).option("max_pages", most).option("pause", 0).load().collect()
    rows = read(9)
    assert sorted((r.page, r.error is None) for r in rows) == [(0, False), (0, True), (1, True), (2, True)]
    assert len(read(2)) == 3


def test_watch_submits_each_link_once(spark, server, tmp_path):
    inbox, (address, got) = tmp_path / "in", server
    inbox.mkdir()
    send = lambda new: history.submitted(new.coalesce(1), address, "p")

    def run():
        links = spark.readStream.text(str(inbox)).withColumnRenamed("value", "url")
        streams.watch(links, str(tmp_path / "seen"), send, str(tmp_path / "checkpoint")).awaitTermination()

    (inbox / "1.txt").write_text("\n".join(f"https://a/{i % 120}" for i in range(240)))
    run()
    assert sorted(len(x) for x in got) == [20, 50, 50] and len({u for x in got for u in x}) == 120
    (inbox / "2.txt").write_text("https://a/1\nhttps://b")
    run()
    assert got[3:] == [["https://b"]] and spark.read.parquet(str(tmp_path / "seen")).count() == 121
    with pytest.raises(PySparkException):
        streams.submit_new(spark.createDataFrame([("https://c",)], "url string"), str(tmp_path / "seen"), lambda new: history.submitted(new, address, "wrong"))
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 121


def test_primary_network_and_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = lambda v: F.lit(v).cast("string")
    assert [one(C.primary_isp(lit(a), lit(b))) for a, b in (("A", "B"), ("", "B"), (None, None))] == ["A", "B", C.UNKNOWN]
    assert [one(C.primary_asn(lit(a))) for a in (" AS1 ", "", None)] == ["AS1", C.UNKNOWN, C.UNKNOWN]
    number = lambda v: one(C.stat_number(F.lit(v).cast("double")))
    assert [number(v) for v in (0, 1000, 1234567.5, -1200.1239, 100.0, -0.0001, None, float("nan"), float("inf"))] == ["0", "1,000", "1,234,567.5", "-1,200.124", "100", "0", "-", "-", "-"]
