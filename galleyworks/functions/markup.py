"""Column functions that read and rewrite markup, and the wordings of reports; all native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyworks.functions import text as T

# Fixed values.
IMAGE_SOURCES = ("src", "data-src", "data-original", "data-lazy-src")
WIDGETS = ("mp-common-miniprogram", "mp-sponsor-ad", "mp-style-type")
LINK_CLASSES = "js_weapp_entry|weapp_image_link|weapp_text_link"
LOCAL_IMAGES = "/assets/images/"
MIME_EXTENSIONS = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp"}
PREFETCH_MESSAGE = "已返回统计数据，本次预取请求不计入统计。"
BOT_MESSAGE = "已返回统计数据，本次机器人请求不计入统计。"
ARTICLE_MESSAGE, SITE_MESSAGE = "已更新文章阅读量，", "已更新站点统计，"
DAY_MESSAGE = "今日 UV 按 Asia/Shanghai 日期 %s 去重。"

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRIBUTE = r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; in lambdas Spark would compute it at every mention."""
    return F.transform(F.array(value), use)[0]


def tags(name: str) -> str:
    """Pattern of the opening tags of an element; quoted values may hold a >."""
    return rf"(?is)<{name}(?![\w-]){_INSIDE}>"


def attributes(tag: Column) -> Column:
    """Attributes of an opening tag by their lowercase names, in their order; the last of a name wins, bare ones are empty."""
    inside = F.regexp_replace(tag, r"(?s)^<[\w-]+|/?>$", "")
    one = lambda x: F.struct(F.lower(F.regexp_extract(x, _ATTRIBUTE, 1)), T.unescape_html(F.regexp_replace(F.regexp_extract(x, _ATTRIBUTE, 2), r"""(?s)^(["'])(.*)\1$""", "$2")))
    return F.map_from_entries(F.transform(F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)), one))


def opening_tag(name: str, values: Column, close: str = "") -> Column:
    parts = F.transform(F.map_entries(values), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), T.escape_html(e["value"]), F.lit('"')))
    return F.concat(F.lit(f"<{name}"), F.array_join(parts, ""), F.lit(f"{close}>"))


def rewritten(html: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """html with every match of the pattern replaced by what `change` makes of it."""
    between, found = F.split(html, pattern, -1), F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def first_content(metas: Column, *selectors: tuple[str, str]) -> Column:
    """Content of the first of the meta elements' attributes, in the order of the (attribute, value) selectors, that has any; else empty."""
    first = lambda all_, name, value: F.try_element_at(F.filter(all_, lambda m: m[name] == value), F.lit(1))
    content = lambda all_, name, value: F.nullif(T.clean_text(F.coalesce(first(all_, name, value)["content"], F.lit(""))), F.lit(""))
    return let(metas, lambda m: F.coalesce(*[content(m, n, v) for n, v in selectors], F.lit("")))


def meta_content(html: Column, *selectors: tuple[str, str]) -> Column:
    """first_content of the meta elements in a piece of markup."""
    return first_content(F.transform(F.regexp_extract_all(html, F.lit(tags("meta")), F.lit(0)), attributes), *selectors)


def image_source(values: Column) -> Column:
    """First of the image's addresses that is not empty, else null."""
    return F.coalesce(*[F.nullif(values[name], F.lit("")) for name in IMAGE_SOURCES])


def image_attributes(values: Column) -> Column:
    """Attributes (mention them once: see `let`) with alt, lazy loading, and width and height where the data attributes tell them."""
    own, told = T.positive_int(values["width"]), T.positive_int(values["data-w"])
    height = T.image_height(F.coalesce(own, told), T.positive_float(values["data-ratio"]))
    known = F.coalesce(own, told).isNotNull() & T.positive_float(values["data-ratio"]).isNotNull() & T.positive_int(values["height"]).isNull()
    entry = lambda name, value: F.create_map(F.lit(name), value.cast("string"))
    none = F.create_map().cast("map<string,string>")
    for name, value, when in (
        ("alt", F.lit(""), ~F.map_contains_key(values, "alt")), ("loading", F.lit("lazy"), F.coalesce(values["loading"], F.lit("")) == ""),
        ("width", told, own.isNull() & told.isNotNull()), ("height", height, known),
    ):
        values = F.map_concat(values, F.when(when, entry(name, value)).otherwise(none))
    return values


def joined_url(base: Column, href: Column) -> Column:
    """href seen from base, dot segments resolved."""
    origin, scheme = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(base, r"^[A-Za-z]+:", 0)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(page, r"^[A-Za-z]+://[^/]*|[^/]*$", "")
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def solved(path: Column) -> Column:
        steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
        return F.concat(F.array_join(steps, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))

    def seen(href: Column) -> Column:
        path = F.regexp_extract(href, r"^[^?#]*", 0)
        whole = F.when(href.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
        return (
            F.when(href == "", base).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).when(href.startswith("?"), F.concat(page, href))
            .otherwise(F.concat(origin, let(whole, solved), F.regexp_extract(href, r"[?#].*$", 0)))
        )

    return let(href, seen)


def shown(tag: Column) -> Column:
    """An opening tag without its attribute `hidden`."""
    return F.regexp_replace(tag, r"""(?is)\shidden(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>])""", "")


def extension_of_type(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair])[kind], F.lit("jpg"))


def json_or_raw(body: Column) -> Column:
    """A JSON body as it is, an empty one as {}, any other under `raw`."""
    return F.when(F.coalesce(body, F.lit("")) == "", "{}").when(F.try_parse_json(body).isNotNull(), body).otherwise(F.to_json(F.struct(body.alias("raw"))))


def with_debug(result: Column, enabled: Column, raw: Column) -> Column:
    """JSON object `result`, with {"debug":{"raw":…}} as its last member where enabled; raw is JSON."""
    head = F.regexp_replace(F.rtrim(result), r"\s*\}$", "")
    more = F.concat(head, F.when(head.rlike(r"^\s*\{\s*$"), "").otherwise(","), F.lit('"debug":{"raw":'), raw, F.lit("}}"))
    return F.when(enabled, more).otherwise(result)


def visit_message(page: Column, counted: Column, reason: Column, day: Column) -> Column:
    head = F.when(~counted & (reason == "prefetch"), PREFETCH_MESSAGE).when(~counted & (reason == "bot"), BOT_MESSAGE).when(page == "article", ARTICLE_MESSAGE).otherwise(SITE_MESSAGE)
    return F.concat(head, F.format_string(DAY_MESSAGE, day))


def health_message(missing: Column, fine: str, lacking: str, end: str = "") -> Column:
    """`fine` if no key is missing, else `lacking`, the keys, and `end`."""
    return F.when(F.size(missing) == 0, fine).otherwise(F.concat(F.lit(lacking), F.array_join(missing, ", "), F.lit(end)))
