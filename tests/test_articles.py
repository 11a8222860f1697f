import hashlib
import json

from pyspark.sql import functions as F

from galleyworks.functions import extract as X
from galleyworks.functions import pages as P
from galleyworks.functions import text as T
from galleyworks.functions import visits as V
from galleyworks.operators import archive as A
from galleyworks.operators import images, iprisk
from galleyworks.sources import files
from galleyworks.streaming import streams

LONG = "word " * 20


def extracted(spark, html, url="https://a.com/x"):
    return X.articles(spark.createDataFrame([(url, html)], "url string, html string")).first()


def test_selectors_in_their_order(spark):
    page = f"<body><main><p>short</p><article class='x'>{LONG}<div>in</div></article></main><div class='post-content'>{LONG} other</div></body>"
    assert extracted(spark, page).content_text == LONG.strip() + " in"
    # the first article is too short, that within main is not; a class word must be whole
    page = f"<article>no</article><main><article>{LONG}</article></main>"
    assert extracted(spark, page).content_text == LONG.strip()
    assert extracted(spark, f"<div class='my-content'>{LONG}</div><div class='content big'>{LONG}two</div>").content_text == LONG + "two"
    r = extracted(spark, "<body><p>too short</p></body>")
    assert (r.success, r.error, r.content_html, r.title) == (False, X.NO_BODY, "", X.UNTITLED)
    assert extracted(spark, None).success is False and extracted(spark, "", None).source_host is None
    assert extracted(spark, f"<script>'<article>{LONG}'</script><!-- <article>{LONG}x --><article>{LONG}y</article>").content_text == LONG + "y"


def test_metadata(spark):
    r = extracted(spark, f"<title> A &amp; B&nbsp;&hellip; </title><meta name=author content='Ann &lt;3'><time datetime='2024' content=' now '>x</time><article>{LONG}</article>")
    assert (r.title, r.account_name, r.publish_time, r.source_name) == ("A & B …", "Ann <3", "now", "a.com")
    r = extracted(spark, f"<meta property='og:title' content=''><meta name='twitter:title' content='Two'><article>{LONG}</article>")
    assert r.title == "Two"


def test_archive_page(spark):
    page = "<h1 id='activity-name'> T\n x </h1><script>var nickname = 'N &amp; M'; var ct = \"0\";</script><div id=js_content hidden><p>a</p><section><p> </p><img data-src='/i.png'></section><p></p><section><div>&nbsp;</div></section></div>"
    r = extracted(spark, page, "https://mp.weixin.qq.com/s/x")
    assert (r.title, r.account_name, r.publish_time, r.content_text, r.source_name, r.success) == ("T x", "N & M", "1970-01-01 00:00:00", "a", X.ARCHIVE_SOURCE, True)
    assert 'src="https://mp.weixin.qq.com/i.png"' in r.content_html and r.content_html.startswith("<div id=js_content>") and "nbsp" not in r.content_html
    r = extracted(spark, "<p>x</p>", "https://mp.weixin.qq.com/s/x")
    assert (r.success, r.error, r.title) == (False, X.NO_ARCHIVE_BODY, X.UNTITLED)
    long, promo = f"<p>{'字' * 1200}</p>", "<p>长按识别二维码 拼多多搜</p>"
    r = extracted(spark, f"<div id='js_content'>{promo}{long}<div><p>kept</p></div>{promo}<p>gone</p></div>", "https://mp.weixin.qq.com/s/x")
    assert r.content_text.endswith("kept") and r.content_text.startswith("长按")


def test_promo_score(spark):
    df = spark.createDataFrame([("二维码",), ("长按识别二维码",), ("拼多多搜 iPhone 茅台",), ("百亿补贴",), ("",)], "t string")
    assert [r[0] for r in df.select(A.block_promo_score(F.col("t"))).collect()] == [3, 6, 6, 4, 0]


def test_times(spark):
    df = spark.createDataFrame([("2024-1-2 3:4:5",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+08:00",), ("2024-01-02",), ("2024-01-02 03:04",), ("soon",), ("2024",)], "t string")
    assert [r[0] for r in df.select(T.iso_time(F.col("t"))).collect()] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.500000+08:00", "2024-01-02T00:00:00", "2024-01-02T03:04:00", "", ""]
    page = lambda ct: f"var ct = '{ct}';"
    df = spark.createDataFrame([(page("1700000000"),), (page("x"),), (page("99999999999999"),), ("",)], "t string")
    assert [r[0] for r in df.select(X.publish_time(F.col("t"))).collect()] == ["2023-11-14 22:13:20", "", "", ""]


def test_labels(spark):
    df = spark.createDataFrame([("http://x.com/", "", "微信公众号", False), ("https://mp.weixin.qq.com/s", "Acc", "", True), ("nowhere", "", "", True), ("http://x.com/", "A<", "", True)], "url string, account_name string, source_name string, success boolean")
    a = P.Article.of(df)
    rows = df.select(P.list_source_label(a).alias("label"), P.article_meta(a).alias("meta"), P.article_data(a, "").alias("data")).collect()
    assert [r.label for r in rows] == ["来源 · x.com", "公众号 · Acc", "来源未识别", "作者 · A&lt;"]
    assert "来源" not in rows[0].meta and "抓取失败" in rows[0].meta and rows[2].meta == ""
    assert '"@type":"Organization","name":"Acc"' in rows[1].data and '"url"' not in rows[1].data


def test_index(spark):
    rows = [(i, f"http://x.com/{i}", f"T{i}", i % 4 != 3, i - (i + 1) // 4) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, url string, title string, success boolean, place int")
    pages = {r.page: r.html for r in P.index_pages(df, "https://b.example", "place", 5).collect()}
    assert set(pages) == {0, 1} and pages[0].count('class="article-item"') == 5 and pages[1].count('class="article-item"') == 3
    assert "共 10 条链接，成功归档 8 篇" in pages[0] and "另有 2 条链接" in pages[1] and '"position":1' in pages[0] and pages[0].index("T0") < pages[0].index("T1")
    none = P.index_pages(df.filter("false"), "", "place").first().html
    assert P.NO_ARTICLES in none and "canonical" not in none


def test_index_as_one_document(spark, tmp_path):
    rows = [(i, f"http://x.com/{i}", f"T<{i}", i % 4 != 3, "") for i in range(10)]
    df = spark.createDataFrame(rows, "i int, url string, title string, success boolean, content_text string")
    placed = A.positions(df.filter("success"), F.lit(None).cast("int"), "i").unionByName(df.filter("NOT success").withColumn("position", F.lit(0).cast("long")))
    lines = P.index_lines(placed.repartition(5), "https://b.example", "position")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # several files, as of a large index
    P.write_index(lines, f"file://{tmp_path}/parts")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    P.joined_parts(spark, f"file://{tmp_path}/parts", f"file://{tmp_path}/index.html")
    text = (tmp_path / "index.html").read_text()
    assert text.startswith("<!doctype html>") and text.endswith("</html>\n") and not text.endswith("\n\n") and len(list((tmp_path / "parts").glob("part-*"))) > 1
    data = json.loads(text.split('<script type="application/ld+json">')[1].split("</script>")[0])
    assert [(e["position"], e["name"]) for e in data[1]["itemListElement"]] == [(k + 1, f"T<{i}") for k, i in enumerate(i for i in range(10) if i % 4 != 3)] and data[0]["url"] == "https://b.example/"
    first = """      </header>
<ul class="article-list">
      <li class="article-item">
        <div class="article-title-row">
          <h3><a href="/articles/%s">T&lt;0</a></h3>
          <span class="source-badge">来源 · x.com</span>
        </div>
        <div class="article-meta">
          <span class="meta-item"><span class="meta-key">来源</span><span class="meta-value">x.com</span></span>
        </div>
        <p class="article-summary"><a href="/articles/%s">阅读全文。</a></p>
      </li>
""" % ((hashlib.md5(b"http://x.com/0").hexdigest(),) * 2)
    assert first in text and text.count('<li class="article-item">') == 8 and "\n    </ul>\n    </section>\n  </main>" in text
    assert '<span class="meta">共 10 条链接，成功归档 8 篇</span>' in text and "<strong>8 篇</strong>" in text and '      <p class="help">另有 2 条链接暂未归档成功，已从公开列表中隐藏。</p>\n    </header>' in text
    none = "\n".join(r.line for r in P.index_lines(placed.filter("false"), "", "position").orderBy("section", "at").collect())
    assert P.NO_ARTICLES in none and "<ul" not in none and "canonical" not in none


def test_risk_answers(spark):
    def result(f, body):
        return spark.createDataFrame([(body,)], "b string").select(f(F.col("b")).alias("r")).first().r

    r = result(iprisk.abuse_result, '{"data":{"abuseConfidenceScore":null,"totalReports":2}}')
    assert (r.is_abusive, r.score, r.label, r.summary) == (False, 0.0, "未发现", "置信分 0，报告 2 次")
    r = result(iprisk.abuse_result, '{"data":{"totalReports":"x"}}')
    assert (r.is_abusive, r.score, r.label, r.summary) == (None, None, "未知", iprisk.NO_DETAILS)
    assert result(iprisk.abuse_result, '{"data":{"totalReports":1}}').is_abusive is True and result(iprisk.abuse_result, "{}").label == "未知"
    r = result(iprisk.residential_result, '{"usageType":"isp","category":"Hosting","asn":7}')
    assert (r.is_residential, r.summary) == (True, "用途类型 isp，分类 Hosting，ASN 7")
    r = result(iprisk.risk_result, '{"is_threat":true,"threat":{"is_tor":"true","is_bogon":true}}')
    assert (r.label, r.is_threat, r.hard, r.soft, r.flags, r.summary) == ("高", True, 1, 1, ["bogon"], "bogon")
    assert result(iprisk.risk_result, "{}").label == "低" and result(iprisk.risk_result, '{"threat":7}').summary == iprisk.NO_FLAGS
    r = result(iprisk.risk_result, '{"threat":null}')
    assert (r.status, r.label) == ("error", "查询失败")


def test_lookups_without_a_key(spark):
    ips = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",)], "ip string")
    risk = spark.createDataFrame([("1.1.1.1", '{"threat":{"is_proxy":true}}', None)], "ip string, body string, error string")
    rows = {r.ip: r for r in iprisk.lookups(ips, {"abuse": None, "residential": None, "risk": risk}, debug=True).collect()}
    assert rows["1.1.1.1"].message == "已识别当前访问 IP，已完成 1 项检测，另有 2 项未配置。" and rows["1.1.1.1"].risk.raw.startswith("{")
    assert rows["2.2.2.2"].message == "已识别当前访问 IP，但仅有未配置或失败的检测项：未配置 2 项，失败 1 项。" and not rows["2.2.2.2"].success
    assert rows["1.1.1.1"].abuse.summary == "未配置 ABUSEIPDB_API_KEY，当前仅显示访问者 IP。"


def test_browsers(spark):
    agents = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Version/17.0 Mobile Safari/604.1", "Chrome/120 Safari/537 Edg/120", "Chrome/9 Firefox/9", "Safari/604", "Windows NT 6.1", "iPod"]
    df = spark.createDataFrame([(a,) for a in agents], "a string")
    assert [tuple(r) for r in df.select(V.first_of(V.BROWSERS, F.col("a"), "-"), V.first_of(V.SYSTEMS, F.col("a"), "-")).collect()] == [("Safari", "macOS"), ("Microsoft Edge", "-"), ("Chrome", "-"), ("-", "-"), ("-", "Windows"), ("-", "iOS / iPadOS")]


def test_registry_entries(spark):
    assert [e.url for e in spark.range(1).select(files.registry_entries(F.lit('{"links":[{"url":" a "},"b",{"x":1},3]}')).alias("e")).first().e] == ["a", "b"]


def test_running_totals_over_minutes(spark):
    rows = [(i, f"2024-01-01 00:{i // 20:02d}:{(i * 7) % 60:02d}", f"k{i % 3}" if i % 4 else None, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id int, t string, k string, v int").withColumn("ts", F.to_timestamp("t"))
    got = {r.event_id: r.total for r in A.running_totals(df, ["k"], {"total": F.col("v")}, "ts", "event_id").collect()}
    for i, t, k, _ in rows:
        assert got[i] == sum(v for j, u, h, v in rows if h == k and (u, j) <= (t, i))


def test_caches(spark, tmp_path):
    schema = "url string, success boolean, title string"
    legacy = tmp_path / "legacy.json"
    legacy.write_text('{"articles":[{"url":"a","success":true,"title":"1"},{"url":"a","success":true,"title":"2"},{"url":"b","success":false},7,{"success":true}]}')
    rows = files.read_cache(spark, f"file://{tmp_path}/none.json", f"file://{legacy}", schema).collect()
    assert [(r.url, r.title) for r in rows] == [("a", "2")]
    df = spark.createDataFrame([(str(i), f"2024-01-{i:02d} 00:00:00" if i else "soon") for i in range(9)], "url string, publish_time string")
    files.write_cache(df, f"file://{tmp_path}/cache")
    assert [r.url for r in spark.read.schema("url string").json(f"file://{tmp_path}/cache").collect()] == ["8", "7", "6", "5", "4", "3", "2", "1", "0"]


def test_stored_images_are_not_fetched(spark):
    articles = spark.createDataFrame([("p", True, '<img src="http://i/a.png"><img src="http://i/b.png"><img src="http://i/a.png">')], "id string, success boolean, content_html string")
    assets = spark.createDataFrame([("p", "http://i/a.png"), ("q", "http://i/b.png")], "article_id string, s string").select("article_id", F.md5("s").alias("digest"))
    assert [(r.id, r.source) for r in images.to_download(articles, assets).collect()] == [("p", "http://i/b.png")]


def test_checks_of_the_watcher(spark, tmp_path):
    seen, links = f"file://{tmp_path}/seen", lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    submit = lambda new: new.agg(F.count("*").alias("n"))
    assert streams.seen_in_order(spark, seen).isEmpty() and streams.submit_new(links("a", "b"), seen, submit) == 2 and streams.submit_new(links("b", "c"), seen, submit) == 1
    assert [r.url for r in streams.seen_in_order(spark, seen).collect()] == ["c", "a", "b"]
    assert streams.submit_new(links("a"), seen, submit) == 0 and streams.last_check(spark, seen).first().last_submitted_count == 0
