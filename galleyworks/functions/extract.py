"""Articles out of web pages: the body by selectors, title, author and time by their metadata; a router picks the rules by the url."""

from __future__ import annotations

import html as hypertext
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.functions import markup as M
from galleyworks.functions import nodes as N
from galleyworks.functions import text as T
from galleyworks.operators import archive as A

# Selectors in their order, defaults and messages.
TITLES = (("property", "og:title"), ("name", "twitter:title"))
AUTHORS = (("name", "author"), ("property", "article:author"))
TIMES = (("property", "article:published_time"), ("name", "publish_date"), ("name", "pubdate"), ("itemprop", "datePublished"))
BODIES = ("article", "main article", "[itemprop=articleBody]", ".post-content", ".entry-content", ".article-content", ".article-body", ".rich-text", "main", ".content", "#content", "body")
UNTITLED, NO_BODY, NO_ARCHIVE_BODY = "未命名文章", "未找到可归档的正文内容", "未找到微信公众号正文内容 #js_content"
ARCHIVE_BODY, ARCHIVE_TITLE, ARCHIVE_ACCOUNT = "#js_content", "#activity-name", "#js_name"
ARCHIVE_SOURCE, REQUEST_FAILED = "微信公众号", "请求失败："


def _in_arrow(df: DataFrame, changes: dict) -> DataFrame:
    """df with columns replaced by what a function of one value makes of them; nulls stay. The last of them is the longest, by which batches are cut."""
    *_, longest = changes

    def run(batches):
        for batch in batches:
            for p in N.pieces(batch.column(longest)):
                own = batch[p]
                columns = [pa.array([None if v is None else changes[n](v) for v in c.to_pylist()], c.type) if n in changes else c for n, c in zip(own.schema.names, own.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=own.schema)

    return df.mapInArrow(run, df.schema)


def publish_time(page: Column) -> Column:
    """UTC time of the seconds in `var ct`; empty if it is no number or beyond the calendar."""
    ct = T.script_string(page, "ct")
    seconds = F.when(ct.rlike(r"^[+-]?\d+$"), ct.try_cast("bigint"))
    return F.coalesce(F.when(seconds.between(-62135596800, 253402300799), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")), F.lit(""))


def tail_pruned(parts: Column) -> Column:
    """Parts (see nodes.edited) up to the block at which promotion begins; text between blocks stays."""

    def pruned(parts: Column) -> Column:
        texts = F.transform(F.filter(parts, lambda p: p["nth"].isNotNull()), lambda p: F.struct(p["nth"].alias("nth"), T.clean_text(T.unescape_html(T.tagless(p["html"]))).alias("text")))
        place = lambda t: F.get(t, A.tail_cut(F.transform(t, lambda x: x["text"]), A.block_promo_score))["nth"]
        return M.let(M.let(texts, place), lambda cut: F.filter(parts, lambda p: cut.isNull() | p["nth"].isNull() | (p["nth"] < cut)))

    return M.let(parts, pruned)


ARTICLE = ("title", "account_name", "publish_time", "content_text", "content_html", "success", "error", "source_name", "source_host")


def articles(pages: DataFrame, html: str = "html", url: str = "url", unescape: Callable[[str], str] = hypertext.unescape) -> DataFrame:
    """pages with the fields of ARTICLE; archive urls go by ids of the archive's pages, others by the selectors above. A page is parsed once, into its table of elements (see nodes.nodes).

    unescape: decodes the character references of titles, accounts and texts; by default as browsers do, `&amp` without a semicolon too (see text.unescape_closed).
    """
    page, archive = F.coalesce(F.col(html), F.lit("")), F.coalesce(T.is_archive_url(F.col(url)), F.lit(False))
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ARTICLE]).alias("_own")  # so that no name clashes
    df = N.with_nodes(pages.select(own, F.col(url).alias("_url"), page.alias("_page"), archive.alias("_archive")), "_page", "_nodes")
    u, page, archive, nodes = F.col("_url"), F.col("_page"), F.col("_archive"), F.col("_nodes")
    clear = lambda n: T.clean_text(T.unescape_html(T.tagless(N.inside(page, n))))
    best = lambda s: M.let(N.select_one(nodes, s), lambda n: F.when(F.length(clear(n)) >= T.LEAST_BODY, n))
    of = lambda s: F.coalesce(M.let(N.select_one(nodes, s), lambda n: T.tagless(N.inside(page, n))), F.lit(""))
    times = N.meta_content(nodes, *TIMES)
    timed = T.clean_text(F.coalesce(F.try_element_at(F.filter(nodes, lambda n: (n["name"] == "time") & F.map_contains_key(n["attributes"], "datetime")), F.lit(1))["attributes"]["content"], F.lit("")))
    found = {
        "_body": F.when(archive, N.select_one(nodes, ARCHIVE_BODY)).otherwise(F.coalesce(*[best(s) for s in BODIES])), "_title": F.when(archive, of(ARCHIVE_TITLE)).otherwise(""), "_account": F.when(archive, of(ARCHIVE_ACCOUNT)).otherwise(""),
        "_head": F.when(archive, "").otherwise(of("title")), "_metas": F.when(archive, N.meta_content(nodes, TITLES[0])).otherwise(N.meta_content(nodes, *TITLES)), "_author": N.meta_content(nodes, *AUTHORS),
        "_time": F.when(archive, publish_time(page)).otherwise(M.let(times, lambda t: F.when(t != "", t).otherwise(timed))), "_nickname": T.script_string(page, "nickname"),
    }
    df = df.select("_own", "_url", "_page", "_archive", "_nodes", *[c.alias(n) for n, c in found.items()])
    body = F.col("_body")
    tops = F.filter(nodes, lambda n: (n["depth"] == body["depth"] + 1) & (n["start"] >= body["inner"]) & (n["end"] <= body["inner_end"]))
    edits = N.cleaning(nodes, u, body["inner"], body["inner_end"])
    df = df.select("_own", "_url", "_archive", *found, "_page", body["inner"].alias("_from"), body["inner_end"].alias("_to"), edits.alias("_edits"), N.spans(tops).alias("_tops"))
    df = N.with_edited(df, ("_page", "_from", "_to", "_edits", "_tops"), "_parts").drop("_page", "_from", "_to", "_edits", "_tops")
    # archive pages lose their promotional tail
    df = df.withColumn("_inner", N.joined(F.when(archive, tail_pruned(F.col("_parts"))).otherwise(F.col("_parts")))).drop("_parts").withColumn("_text", T.tagless("_inner"))
    df = _in_arrow(df, {c: unescape for c in ("_title", "_account", "_head", "_text")})
    first = lambda *values: F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))
    clean = lambda c: T.clean_text(F.coalesce(c, F.lit("")))
    success, host = body.isNotNull(), T.source_host(u)
    values = {
        "title": first(clean("_title"), F.col("_metas"), clean("_head"), F.lit(UNTITLED)),
        "account_name": F.when(F.col("_archive"), first(clean("_account"), F.col("_nickname"))).otherwise(F.col("_author")),
        "publish_time": F.col("_time"),
        "content_text": F.when(success, clean("_text")).otherwise(""),
        "content_html": F.when(success, F.concat(M.shown(body["tag"]), "_inner", F.lit("</"), body["name"], F.lit(">"))).otherwise(""),
        "success": success,
        "error": F.when(success, "").when(F.col("_archive"), NO_ARCHIVE_BODY).otherwise(NO_BODY),
        "source_name": F.when(F.col("_archive"), ARCHIVE_SOURCE).otherwise(host),
        "source_host": host,
    }
    return df.select("_own.*", *[values[n].alias(n) for n in ARTICLE])


def fetched(links: DataFrame, responses: DataFrame, fetched_at: Column, key: str = "url") -> DataFrame:
    """The thirteen fields of an article for every link (url): of its response (url, html, error), or a failure that names the error. One row for each link, never an exception; of a link's responses one without an error counts (the first by its text).

    key: the column of links and responses that tells whose response it is, for links that share a url and were asked each for itself; another one than the url stands before the fields.
    """
    own = [c for c in (key,) if c != "url"]
    rows = links.select(*own, "url").join(A.one_answer(responses, key, "html").withColumnRenamed("error", "fault"), key, "left")
    made = articles(rows)
    bad = F.col("html").isNull() | F.col("fault").isNotNull()
    told = {n: F.when(bad, F.lit("")).otherwise(F.col(n)).alias(n) for n in ("title", "account_name", "source_name", "publish_time", "content_text", "content_html")}
    ident = T.article_id(F.col("url"))
    return made.select(
        *own, ident.alias("id"), "url", F.concat(ident, F.lit(".html")).alias("filename"), *told.values(), "source_host", fetched_at.cast("string").alias("fetched_at"),
        (F.col("success") & ~bad).alias("success"), F.when(bad, F.concat(F.lit(REQUEST_FAILED), F.coalesce("fault", F.lit("ConnectionError")))).otherwise(F.col("error")).alias("error"),
    )
