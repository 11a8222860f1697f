"""Labels, structured data and markup of archive pages, as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.functions import text as T

# Wordings and formats.
ARCHIVE_SOURCE, ARCHIVE_HOST = "微信公众号", "mp.weixin.qq.com"
ACCOUNT, AUTHOR, SOURCE, PUBLISHED, FETCHED, STATE, FETCH_FAILED, SITE = "公众号", "作者", "来源", "发布时间", "抓取时间", "状态", "抓取失败", "站点"
NO_SOURCE, SOURCE_TITLE, SEE_SOURCE = "来源未识别", "原文来源", "查看原文"
UNTITLED, DETAILS, SITE_NAME = "未命名文章", "文章详情", "公开文章归档"
NO_ARTICLES = "暂无成功归档的文章。请通过管理员提交页添加公开文章链接。"
HIDDEN_FAILURES = "另有 %d 条链接暂未归档成功，已从公开列表中隐藏。"
COUNTS = "共 %d 条链接，成功归档 %d 篇"
DESCRIPTION = "%s 的归档页，保留原文来源与抓取信息。"
SCHEMA = "https://schema.org"
INDEX_DESCRIPTION = "手动收录公开文章链接，优先适配微信公众号文章，提供稳定的归档阅读页与原文入口。"
# Markup of the pages around what an archive fills in (%s).
HOME_LINK = '      <p><a href="/">返回首页</a></p>\n'
ARTICLE_COUNTS = """
      <div class="stats-inline">
        <span class="meta-item"><span class="meta-key">阅读量</span><span id="article-pv" class="meta-value">加载中...</span></span>
        <span id="article-stats-status" class="stats-status">正在准备统计...</span>
      </div>"""
SOURCE_LINK = ('      <p class="links"><a href="', '" target="_blank" rel="noopener noreferrer">查看原文链接</a></p>\n')
INDEX_TOP = """    <header class="site-header">
      <h1 class="site-title">公开文章归档</h1>
      <p class="site-desc">手动收录公开文章链接，优先适配微信公众号文章，提供更稳定的归档阅读页与原文入口。</p>
      <div class="toolbar">
        <span class="meta">共 %d 条链接，成功归档 %d 篇</span>
        <div class="toolbar-actions">
          <a class="button secondary" href="/visitor-ip">访问 IP 检测工具</a>
          <a class="button secondary" href="/submit">管理员入口</a>
        </div>
      </div>
      %s
    </header>
    <section class="summary-panel" aria-label="站点概览">
      <div class="summary-grid">
        <span class="summary-stat"><strong>%d 条</strong><span>收录</span></span>
        <span class="summary-stat"><strong>%d 篇</strong><span>归档</span></span>
        <span class="summary-stat"><strong id="site-pv">-</strong><span>浏览</span></span>
        <span class="summary-stat"><strong id="site-uv">-</strong><span>今日访客</span></span>
      </div>
      <p id="site-stats-status" class="help stats-status">正在准备统计...</p>
    </section>
    <section class="panel">
      <header class="panel-header">
        <h2 class="section-title">最新归档</h2>
        <p class="help">首页仅展示成功归档的文章，原文链接会继续保留在详情页中。</p>
      </header>
"""


@dataclass
class Article:
    """Columns of an article; those that are missing in a table are empty."""

    url: Column
    title: Column
    account_name: Column
    publish_time: Column
    fetched_at: Column
    source_name: Column
    source_host: Column
    content_text: Column
    content_html: Column
    success: Column
    error: Column

    @classmethod
    def of(cls, df: DataFrame) -> Article:
        own = {c.lower() for c in df.columns}
        text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in own else F.lit("")
        fields = {n: text(n) for n in ("url", "title", "account_name", "publish_time", "fetched_at", "source_name", "content_text", "content_html", "error")}
        host = F.coalesce(F.nullif(text("source_host"), F.lit("")), T.source_host(fields["url"]))
        return cls(**fields, source_host=host, success=F.coalesce("success", F.lit(False)) if "success" in own else F.lit(False))

    @property
    def is_archive(self) -> Column:
        """By the name of the source or its host."""
        return (self.source_name == ARCHIVE_SOURCE) | (self.source_host == ARCHIVE_HOST)


def _item(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'<span class="meta-item"><span class="meta-key">{key}</span><span class="meta-value">'), value, F.lit("</span></span>"))


def meta_time_item(label: str, value: Column) -> Column:
    iso = T.iso_time(value)
    attribute = F.when(iso != "", F.concat(F.lit(' datetime="'), T.escape_html(iso), F.lit('"'))).otherwise("")
    return F.concat(F.lit(f'<span class="meta-item"><span class="meta-key">{label}</span><time class="meta-value"'), attribute, F.lit(">"), T.escape_html(T.display_time(value)), F.lit("</time></span>"))


def article_meta(a: Article) -> Column:
    name = T.escape_html(a.account_name)
    items = F.array(
        F.when(a.account_name != "", F.when(a.is_archive, _item(ACCOUNT, name)).otherwise(_item(AUTHOR, name))),
        F.when((a.source_host != "") & ~a.is_archive, _item(SOURCE, T.escape_html(a.source_host))),
        F.when(a.publish_time != "", meta_time_item(PUBLISHED, a.publish_time)),
        F.when(a.fetched_at != "", meta_time_item(FETCHED, a.fetched_at)),
        F.when(~a.success, _item(STATE, F.lit(FETCH_FAILED))),
    )
    return F.array_join(F.array_compact(items), "\n        ")


def list_source_label(a: Article) -> Column:
    label = lambda kind, value: F.concat(F.lit(f"{kind} · "), T.escape_html(value))
    named = a.account_name != ""
    return F.when(a.is_archive & named, label(ACCOUNT, a.account_name)).when(named, label(AUTHOR, a.account_name)).when(a.source_host != "", label(SOURCE, a.source_host)).otherwise(NO_SOURCE)


def detail_source_card(a: Article) -> Column:
    row = lambda kind, value: F.concat(F.lit(f"<span>{kind}："), T.escape_html(value), F.lit("</span>"))
    rows = F.array(
        F.lit(f"<strong>{SOURCE_TITLE}</strong>"),
        F.when(a.account_name != "", F.when(a.is_archive, row(ACCOUNT, a.account_name)).otherwise(row(AUTHOR, a.account_name))),
        F.when(a.source_host != "", row(SITE, a.source_host)),
        F.concat(F.lit('<a href="'), T.escape_html(a.url), F.lit(f'" target="_blank" rel="noopener noreferrer">{SEE_SOURCE}</a>')),
    )
    return F.array_join(F.array_compact(rows), "\n        ")


def article_summary(a: Article, limit: int = T.SUMMARY_LIMIT) -> Column:
    text = T.clean_text(a.content_text)
    return F.when(text == "", T.EMPTY_SUMMARY).when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit), F.lit(T.SUMMARY_STRIP)), F.lit("...")))


def article_data(a: Article, base: str) -> Column:
    """Structured data of an article as JSON; keys without a value are left out."""
    link = F.nullif(T.absolute_url(T.detail_path(a.url), base), F.lit(""))
    author = F.when(a.account_name != "", F.struct(F.when(a.is_archive, "Organization").otherwise("Person").alias("@type"), a.account_name.alias("name")))
    fields = F.struct(
        F.lit(SCHEMA).alias("@context"), F.lit("Article").alias("@type"), F.coalesce(F.nullif(a.title, F.lit("")), F.lit(DETAILS)).alias("headline"),
        F.nullif(T.iso_time(a.publish_time), F.lit("")).alias("datePublished"), author.alias("author"), link.alias("url"), link.alias("mainEntityOfPage"),
    )
    return F.to_json(fields)


def index_data(items: Column, base: str) -> Column:
    """Structured data of the index as JSON, of its articles' (title, url) in order; positions begin at 1."""
    home = F.nullif(T.absolute_url(F.lit("/"), base), F.lit(""))
    site = F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("WebSite").alias("@type"), F.lit(SITE_NAME).alias("name"), home.alias("url")))
    entry = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), F.coalesce(F.nullif(x["title"], F.lit("")), F.lit(UNTITLED)).alias("name"), F.nullif(T.absolute_url(T.detail_path(x["url"]), base), F.lit("")).alias("url"))
    listed = F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("ItemList").alias("@type"), F.transform(items, entry).alias("itemListElement")))
    return F.concat(F.lit("["), site, F.lit(","), listed, F.lit("]"))


def json_ld(data: Column) -> Column:
    """A script element of JSON data that no markup in it can end; empty for none."""
    safe = F.replace(data, F.lit("<"), F.lit("\\u003c"))
    return F.coalesce(F.concat(F.lit('\n  <script type="application/ld+json">'), safe, F.lit("</script>")), F.lit(""))


def page_shell(title: Column, body: Column, description: Column, canonical: Column, kind: str, data: Column, scripts: Column | None = None) -> Column:
    """A whole page. description, canonical (an absolute address) and data may be empty: their elements are left out."""
    meta = lambda attribute, name, value: F.concat(F.lit(f'<meta {attribute}="{name}" content="'), T.escape_html(value), F.lit('">'))
    given = lambda value, made: F.when(F.coalesce(value, F.lit("")) != "", made)
    head = F.array(
        given(canonical, F.concat(F.lit('<link rel="canonical" href="'), T.escape_html(canonical), F.lit('">'))), meta("property", "og:type", F.lit(kind)), meta("property", "og:site_name", F.lit(SITE_NAME)),
        meta("property", "og:title", title), given(description, meta("property", "og:description", description)), given(canonical, meta("property", "og:url", canonical)), F.lit('<meta name="twitter:card" content="summary">'),
    )
    described = F.coalesce(given(description, F.concat(F.lit("\n  "), meta("name", "description", description))), F.lit(""))
    return F.concat(
        F.lit('<!doctype html>\n<html lang="zh-CN">\n<head>\n  <meta charset="utf-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1">'), described, F.lit("\n  <title>"), T.escape_html(title), F.lit("</title>\n  "),
        F.array_join(F.array_compact(head), "\n  "), F.lit('\n  <link rel="stylesheet" href="/assets/style.css">'), json_ld(data), F.lit('\n</head>\n<body>\n  <main class="site">\n'), body, F.lit("\n  </main>\n"), scripts if scripts is not None else F.lit(""), F.lit("\n</body>\n</html>\n"),
    )


def article_page(a: Article, base: str) -> Column:
    """The page of an article; a failed one shows its error and carries no structured data."""
    title = F.coalesce(F.nullif(a.title, F.lit("")), F.lit(DETAILS))
    source = F.coalesce(F.nullif(a.account_name, F.lit("")), F.nullif(a.source_host, F.lit("")), F.lit(SITE_NAME))
    content = F.when(a.success, a.content_html).otherwise(F.concat(F.lit('<p class="result error">'), T.escape_html(F.coalesce(F.nullif(a.error, F.lit("")), F.lit(FETCH_FAILED))), F.lit("</p>")))
    body = F.concat(
        F.lit('    <article class="article">\n' + HOME_LINK + '      <h1 class="site-title">'), T.escape_html(F.coalesce(F.nullif(a.title, F.lit("")), F.lit(UNTITLED))), F.lit('</h1>\n      <div class="meta">\n        '), article_meta(a),
        F.lit("\n      </div>\n" + ARTICLE_COUNTS + '\n      <div class="source-card">\n        '), detail_source_card(a), F.lit('\n      </div>\n      <div class="article-body">\n'), content, F.lit("\n      </div>\n" + SOURCE_LINK[0]), T.escape_html(a.url), F.lit(SOURCE_LINK[1] + "    </article>"),
    )
    return page_shell(F.concat_ws(" - ", title, source, F.lit(SITE_NAME)), body, F.format_string(DESCRIPTION, title), T.absolute_url(T.detail_path(a.url), base), "article", F.when(a.success, article_data(a, base)))


def index_item(a: Article) -> Column:
    """One entry of the index."""
    link = T.detail_path(a.url)
    return F.concat(
        F.lit('      <li class="article-item">\n        <div class="article-title-row">\n          <h3><a href="'), link, F.lit('">'), T.escape_html(F.coalesce(F.nullif(a.title, F.lit("")), F.lit(UNTITLED))), F.lit('</a></h3>\n          <span class="source-badge">'), list_source_label(a),
        F.lit("</span>\n        </div>\n        "), F.when(article_meta(a) != "", F.concat(F.lit('<div class="article-meta">\n          '), article_meta(a), F.lit("\n        </div>"))).otherwise(""), F.lit('\n        <p class="article-summary"><a href="'), link, F.lit('">'), T.escape_html(article_summary(a)), F.lit("</a></p>\n      </li>"),
    )


def index_pages(articles: DataFrame, base: str, order: str, per_page: int = 1000) -> DataFrame:
    """page, html: the index over all successful articles in descending order of a distinct number from 0, per_page entries a page; failed ones are counted only.

    The order is a column of 0, 1, … so that pages group by it and no document of unbounded size is made in one task.
    """
    a = Article.of(articles)
    total = articles.agg(F.count("*").alias("n"), F.count_if(a.success).alias("ok"))
    rows = articles.filter(a.success).select(F.floor(F.col(order) / per_page).cast("long").alias("page"), F.struct(F.col(order).alias("at"), index_item(a).alias("item"), a.title.alias("title"), a.url.alias("url")).alias("r"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # per_page rows at most
    # one row of totals stands beside every page; page 0 is there even if it is empty
    pages = articles.sparkSession.range(1).select(F.col("id").alias("page"), F.array().cast(pages.schema["rows"].dataType).alias("rows")).unionByName(pages).groupBy("page").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    n, ok = total.first()
    pages = pages.withColumn("n", F.lit(n)).withColumn("ok", F.lit(ok))
    failed = F.col("n") - F.col("ok")
    note = F.when(failed > 0, F.concat(F.lit('      <p class="help">'), F.format_string(HIDDEN_FAILURES, failed), F.lit("</p>\n"))).otherwise("")
    listed = F.when(F.size("rows") > 0, F.concat(F.lit('<ul class="article-list">\n'), F.array_join(F.transform("rows", lambda r: r["item"]), "\n"), F.lit("\n    </ul>"))).otherwise(f'<p class="empty">{NO_ARTICLES}</p>')
    body = F.concat(F.lit(f'    <h1 class="site-title">{SITE_NAME}</h1>\n      <span class="meta">'), F.format_string(COUNTS, "n", "ok"), F.lit("</span>\n"), note, listed)
    data = index_data(F.coalesce("rows", F.array().cast("array<struct<at:bigint,item:string,title:string,url:string>>")), base)
    return pages.select(F.coalesce("page", F.lit(0)).cast("long").alias("page"), page_shell(F.lit(SITE_NAME), body, F.lit(""), T.absolute_url(F.lit("/"), base), "website", data).alias("html"))


def index_lines(articles: DataFrame, base: str, position: str) -> DataFrame:
    """section, at, line: the index over all successful articles as lines of one document, in the order of (section, at). `position` numbers the successful ones from 1 in the archive's order; failed ones are counted only.

    No row holds more than one article: structured data and list are a line for each, between the head and foot that are made once.
    """
    spark, a = articles.sparkSession, Article.of(articles)
    n, ok = articles.agg(F.count("*"), F.count_if(a.success)).first()
    note = f'<p class="help">{HIDDEN_FAILURES % (n - ok)}</p>' if n > ok else ""
    data, items = "\ue000", "\ue001"  # where the articles' lines go
    body = F.lit(INDEX_TOP % (n, ok, note, n, ok) + (items if ok else f'<p class="empty">{NO_ARTICLES}</p>{items}') + "\n    </section>")
    shell = spark.range(1).select(page_shell(F.lit(SITE_NAME), body, F.lit(INDEX_DESCRIPTION), T.absolute_url(F.lit("/"), base), "website", F.lit(data)).alias("html"), T.absolute_url(F.lit("/"), base).alias("home"))
    site = F.to_json(F.struct(F.lit(SCHEMA).alias("@context"), F.lit("WebSite").alias("@type"), F.lit(SITE_NAME).alias("name"), F.nullif("home", F.lit("")).alias("url")))
    parts = F.split("html", f"[{data}{items}]")
    listed = F.lit(f',{{"@context":"{SCHEMA}","@type":"ItemList","itemListElement":[')
    ends = F.array(
        F.struct(F.lit(0).alias("section"), F.concat(parts[0], F.lit("["), F.replace(site, F.lit("<"), F.lit("\\u003c")), listed).alias("line")),
        F.struct(F.lit(2).alias("section"), F.concat(F.lit("]}]"), parts[1], F.lit('<ul class="article-list">' if ok else "")).alias("line")), F.struct(F.lit(4).alias("section"), F.concat(F.lit("    </ul>" if ok else ""), F.regexp_replace(parts[2], "\n$", "")).alias("line")),
    )
    ends = shell.select(F.explode(ends).alias("e")).select("e.section", F.lit(0).cast("long").alias("at"), "e.line")
    at = F.col(position).cast("long")
    entry = F.struct(F.lit("ListItem").alias("@type"), at.alias("position"), F.coalesce(F.nullif(a.title, F.lit("")), F.lit(UNTITLED)).alias("name"), F.nullif(T.absolute_url(T.detail_path(a.url), base), F.lit("")).alias("url"))
    line = F.concat(F.when(at > 1, ",").otherwise(""), F.replace(F.to_json(entry), F.lit("<"), F.lit("\\u003c")))
    both = F.array(F.struct(F.lit(1).alias("section"), line.alias("line")), F.struct(F.lit(3).alias("section"), index_item(a).alias("line")))
    return articles.filter(a.success).select(at.alias("at"), F.explode(both).alias("e")).select("e.section", "at", "e.line").unionByName(ends)


def write_index(lines: DataFrame, path: str) -> None:
    """The document as part files below path, which hold it in the order of their names; a range of lines is one file, so no task writes all."""
    lines.orderBy("section", "at").select("line").write.text(path)


def joined_parts(spark: SparkSession, lines_path: str, target: str) -> None:
    """The part files of write_index as one file, streamed by the file system; nothing is held."""
    fs_ = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    at = fs_.Path(lines_path)
    fs = at.getFileSystem(conf)
    out = fs.create(fs_.Path(target), True)
    try:
        for f in sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            source = fs.open(f)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
    finally:
        out.close()
