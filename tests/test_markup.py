import hashlib
from urllib.parse import urljoin

from pyspark.sql import functions as F

from galleyworks.functions import markup as M
from galleyworks.functions import nodes as N
from galleyworks.operators import images
from galleyworks.session import prepare
from tests.test_archive import values


def test_meta_and_addresses(spark):
    page = """<meta content=" A  b " property='og:title'><META name="author" content=""><meta property="article:author" content="x &amp; y">"""
    assert values(spark, lambda c: M.meta_content(c, ("property", "og:title"), ("name", "title")), [page, ""]) == ["A b", ""]
    assert values(spark, lambda c: M.meta_content(c, ("name", "author"), ("property", "article:author")), [page]) == ["x & y"]
    base, refs = "http://a.b/c/d?e#f", ["g", "./g", "../g", "/g/../h", "//x/y", "?q", "#z", "", "mailto:a", "g?x=../y", "../../..", "g/"]
    assert values(spark, lambda c: M.joined_url(F.lit(base), c), refs) == [urljoin(base, r) for r in refs]


def test_clean_html(spark):
    prepare(spark)
    html = """<div hidden id=a><script>x</script><p class="q"></p><mp-sponsor-ad>ad</mp-sponsor-ad><a class="weapp_text_link" href="z">in</a><img data-src="i.png?a=1&amp;b=2" data-w="944" data-ratio="1.3368644067796611"><a href='/k'>t</a></div>"""
    want = '<div id=a>in<img data-src="i.png?a=1&amp;b=2" data-w="944" data-ratio="1.3368644067796611" src="http://h/p/i.png?a=1&amp;b=2" alt="" loading="lazy" width="944" height="1262"/><a href="http://h/k">t</a></div>'
    assert values(spark, lambda c: N.cleaned(c, F.lit("http://h/p/x")), [html, "", None]) == [want, "", None]


def test_localise(spark):
    prepare(spark)
    good, page = "https://i/x?wx_fmt=png", "https://i/page"
    html = f'<p><img src="{good}" alt="a>b"><img src="{page}"><img src="/assets/images/k/o.png"></p>'
    articles = spark.createDataFrame([("k", True, html, 1), ("n", False, html, 2), ("e", True, None, 3)], "id string, success boolean, content_html string, size int")
    downloads = spark.createDataFrame([(good, "image/png"), (good, None), (page, "text/html")], "source string, content_type string")
    got = {r.id: r.content_html for r in images.localise(articles, downloads).collect()}
    local = f"/assets/images/k/{hashlib.md5(good.encode()).hexdigest()}.png"
    assert got["n"] == html and got["e"] is None
    assert got["k"] == f'<p><img src="{local}" alt="a&gt;b" loading="lazy" data-original-src="{good}" data-src="{local}"/><img src="{page}" alt="" loading="lazy"/><img src="/assets/images/k/o.png" alt="" loading="lazy"/></p>'


def test_reports(spark):
    assert values(spark, M.json_or_raw, ['{"a":1}', "", None, "<p>"]) == ['{"a":1}', "{}", "{}", '{"raw":"<p>"}']
    assert values(spark, lambda c: M.with_debug(c, F.lit(True), F.lit("[1]")), ['{"a":1}', "{}"]) == ['{"a":1,"debug":{"raw":[1]}}', '{"debug":{"raw":[1]}}']
    got = values(spark, lambda c: M.visit_message(F.lit("article"), c.isNull(), c, F.lit("2024-01-02")), ["bot", "prefetch", "x", None])
    assert [g.split("，")[0] for g in got] == ["已返回统计数据", "已返回统计数据", "已更新文章阅读量", "已更新文章阅读量"] and all("2024-01-02" in g for g in got)
    assert values(spark, lambda c: M.health_message(F.filter(F.array(c), lambda x: x != ""), "ok", "no: ", "."), ["", "K"]) == ["ok", "no: K."]
