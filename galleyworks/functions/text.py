"""Column functions for urls, text, time and markup; native expressions but for unescape_all."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARCHIVE_PREFIX = "https://mp.weixin.qq.com/"
SUMMARY_LIMIT, SUMMARY_STRIP = 110, "，。；、,. "
EMPTY_SUMMARY = "阅读全文。"
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp")
LEAST_BODY = 80


def is_article_url(url: Column) -> Column:
    return url.rlike(r"^(?i:https?)://[^/?#]+")


def is_archive_url(url: Column) -> Column:
    return url.startswith(ARCHIVE_PREFIX)


def source_host(url: Column) -> Column:
    """Network location in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r"^www\.", "")


def article_id(url: Column) -> Column:
    return F.md5(url)


def detail_path(url: Column) -> Column:
    return F.concat(F.lit("/articles/"), article_id(url))


def absolute_url(path: Column, base: str) -> Column:
    """path if it is absolute already, else below base; empty without a base."""
    return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit(base.rstrip("/")), path) if base else F.lit(""))


def clean_text(value: Column) -> Column:
    """Runs of Unicode white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def escape_html(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def unescape_html(value: Column) -> Column:
    for name, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def unescape_all(value: Column) -> Column:
    """Every named and numeric character reference of HTML5 decoded; beyond the few of unescape_html the standard library's table is needed."""

    def decode(column: pa.Array) -> pa.Array:
        return pa.array([html.unescape(v) if v and "&" in v else v for v in column.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(value)


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def unescape_closed(text: str) -> str:
    """Every character reference of HTML5 that ends in a semicolon decoded; what lacks one, as the `&amp` of a text that was cut, stays."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def tagless(markup: Column) -> Column:
    """Markup with a space for each tag, comment, script, style and noscript; character references stay."""
    for tag in ("script", "style", "noscript"):
        markup = F.regexp_replace(markup, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(F.regexp_replace(markup, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")


def markup_text(markup: Column) -> Column:
    """Text of markup: script, style and noscript go, tags become spaces."""
    return clean_text(unescape_html(tagless(markup)))


def summary(text: Column, limit: int = SUMMARY_LIMIT) -> Column:
    text = clean_text(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(text, 1, limit), F.lit(SUMMARY_STRIP)), F.lit("..."))
    return F.when(text == "", EMPTY_SUMMARY).when(F.length(text) <= limit, text).otherwise(cut)


def script_string(page: Column, name: str) -> Column:
    """Value of the first `var name = '…'` in a page."""
    return F.trim(unescape_html(F.regexp_extract(page, rf"""var\s+{name}\s*=\s*['"]([^'"]*)['"]""", 1)))


PLAIN_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def article_time(value: Column) -> Column:
    """Instant of a time in either grammar, as UTC where it has no offset; null if it is none."""
    value = F.trim(value)
    plain = F.try_to_timestamp(value, F.lit("yyyy-M-d H:m:s"))
    return F.when(value.rlike(PLAIN_TIME), plain).when(value.rlike(ISO_TIME), value.try_cast("timestamp"))


def display_time(value: Column) -> Column:
    """Wall clock of the time's own offset; what is no time, as it is."""
    value = F.trim(value)
    clock = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 0)
    return F.when(article_time(value).isNull(), value).when(clock != "", F.replace(clock, F.lit("T"), F.lit(" "))).otherwise(F.date_format(article_time(value), "yyyy-MM-dd HH:mm:ss"))


def iso_time(value: Column) -> Column:
    """ISO 8601 of a time in either grammar, in its own offset (Z as +00:00); empty if it is none."""
    value = F.trim(value)
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?(Z|[+-]\d{2}:\d{2})?$"
    part = lambda i, n=2: F.lpad(F.regexp_extract(value, pattern, i), n, "0")
    fraction = F.rpad(F.regexp_extract(value, pattern, 7), 6, "0")
    zone = F.regexp_replace(F.regexp_extract(value, pattern, 8), "^Z$", "+00:00")
    whole = F.concat(part(1, 4), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), zone)
    return F.when(article_time(value).isNotNull(), whole).otherwise("")


def positive_int(value: Column) -> Column:
    """First run of digits, if it is above 0."""
    n = F.regexp_extract(value, r"([0-9]+)", 1).try_cast("int")
    return F.when(n > 0, n)


def positive_float(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def image_height(width: Column, ratio: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(width * ratio).cast("int"))


def image_extension(url: Column) -> Column:
    """From the wx_fmt parameter, else from the path; empty if it is no known one."""
    form = F.lower(F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("wx_fmt")), F.lit("")))
    path = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    found = F.when(form != "", form).otherwise(path)
    return F.when(found == "jpeg", "jpg").when(found.isin(*IMAGE_TYPES), found).otherwise("")
