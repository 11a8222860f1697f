"""Column functions for requests, history pages and what a visitor's page shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyworks.functions import markup as M
from galleyworks.functions import text as T

# Fixed values.
UNKNOWN, NO_DETAILS = "未知", "暂无更多字段。"
STATES = {"ok": "已完成", "not_configured": "未配置", "error": "查询失败"}
RISK_LABELS = {"isTor": "Tor", "isProxy": "代理", "isAnonymous": "匿名网络", "isKnownAttacker": "已知攻击者", "isKnownAbuser": "已知滥用者", "isDatacenter": "数据中心", "isIcloudRelay": "iCloud Relay", "isBogon": "bogon"}
MOST_LINKS = 50
HISTORY = "struct<list:array<struct<app_msg_ext_info:struct<content_url:string,multi_app_msg_item_list:array<struct<content_url:string>>>>>>"


def url_join(base: Column, href: Column) -> Column:
    """href resolved against base; null if either is null, href as it is where the two cannot be joined."""
    return F.when(base.isNotNull() & href.isNotNull(), M.joined_url(base, href))


def decoded(part: Column) -> Column:
    """A name or value of a query as text; a % that begins no escape stays."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(part: Column) -> Column:
    """Text as a name or value of a query."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def update_query(url: Column, key: Column, value: Column) -> Column:
    """url with a query parameter set: in its old place if it was there, else last; of repeated names the last value stays. Null if url or key is null; a null value is empty."""
    scheme = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    front = F.concat(F.lower(scheme), F.substr(F.regexp_extract(url, r"^[^?#]*", 0), F.length(scheme) + 1))
    parts = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    pair = lambda p: F.struct(decoded(F.regexp_extract(p, "(?s)^[^=]*", 0)).alias("name"), decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("value"))
    pairs = F.concat(F.transform(parts, pair), F.array(F.struct(key.alias("name"), F.coalesce(value, F.lit("")).alias("value"))))

    def written(pairs: Column) -> Column:
        last = lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"]
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.array_join(F.transform(names, lambda n: F.concat(encoded(n), F.lit("="), encoded(last(n)))), "&")

    fragment = F.regexp_extract(url, "(?s)#.+$", 0)
    return F.when(url.isNotNull() & key.isNotNull(), F.concat(front, F.lit("?"), M.let(pairs, written), fragment))


def decode_archive_url(url: Column) -> Column:
    """Decoded link of the archive's host, in https; empty for any other."""
    url = F.trim(F.replace(T.unescape_html(F.coalesce(url, F.lit(""))), F.lit("\\/"), F.lit("/")))
    url = F.regexp_replace(url, "^http://mp[.]weixin[.]qq[.]com/", T.ARCHIVE_PREFIX)
    return F.when(T.is_archive_url(url), url).otherwise("")


def history_problem(body: Column) -> Column:
    """Why a page of a history is none; null if it is good. base_resp goes before the top level."""
    base = F.get_json_object(body, "$.base_resp").startswith("{")
    ret = F.when(F.coalesce(base, F.lit(False)), F.get_json_object(body, "$.base_resp.ret")).otherwise(F.get_json_object(body, "$.ret"))
    message = F.when(F.coalesce(base, F.lit(False)), F.get_json_object(body, "$.base_resp.err_msg")).otherwise(F.get_json_object(body, "$.errmsg"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, "not a JSON object").when(ret.isNotNull() & (ret != "0"), F.concat_ws(" ", F.concat(F.lit("ret="), ret), message))


def history_links(body: Column) -> Column:
    """Distinct links of a history page in its order: each message's own and those of its further items."""
    items = F.from_json(F.get_json_object(body, "$.general_msg_list"), HISTORY)["list"]
    none = F.array().cast("array<string>")

    def of(item: Column) -> Column:
        info = item["app_msg_ext_info"]
        more = F.coalesce(F.transform(info["multi_app_msg_item_list"], lambda m: m["content_url"]), none)
        return F.concat(F.array(info["content_url"]), more)

    found = F.transform(F.flatten(F.coalesce(F.transform(items, of), F.array(none))), decode_archive_url)
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def submit_problem(allowed: Column, links: Column) -> Column:
    """Why a batch of links is refused; null if it is taken. The number is tested before repeats go."""
    valid = F.exists(links, lambda u: F.coalesce(T.is_article_url(F.trim(u)), F.lit(False)))
    return F.when(~F.coalesce(allowed, F.lit(False)), "password").when(links.isNull() | (F.size(links) == 0), "no links").when(F.size(links) > MOST_LINKS, "too many links").when(~valid, "no valid link")


def typed_links(typed: Column) -> Column:
    """links: distinct lines; valid: whether all are article links and there is one."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(typed, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.struct(lines.alias("links"), ((F.size(lines) > 0) & F.forall(lines, T.is_article_url)).alias("valid"))


def missing_keys(config: Column, keys: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.coalesce(F.try_element_at(config, k), F.lit("")) == "")


def normal_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: v.isNotNull())


def text_or(value: Column, other: str = UNKNOWN) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(other))


def _known(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "") & (p != UNKNOWN))


def location(country: Column, city: Column, colo: Column) -> Column:
    return text_or(F.array_join(_known(country, city, colo), " / "))


def network_type(usage: Column, category: Column, connection: Column, label: Column) -> Column:
    given = F.filter(F.array(usage, category, connection), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(given) > 0, F.array_join(given, " / ")).otherwise(F.coalesce(F.nullif(label, F.lit("")), F.lit(UNKNOWN)))


def primary_isp(residential: Column, abuse: Column) -> Column:
    """The provider that the usage lookup names, else that of the abuse lookup."""
    return F.coalesce(F.nullif(residential, F.lit("")), F.nullif(abuse, F.lit("")), F.lit(UNKNOWN))


def primary_asn(residential: Column) -> Column:
    return text_or(residential)


def stat_number(value: Column) -> Column:
    """A number in groups of three digits with three decimals at most; - if it is missing or not finite."""
    number = value.cast("double")
    shown = F.regexp_replace(F.format_number(F.round(number, 3), 3), r"\.?0+$", "")
    return F.when(F.abs(number) < float("inf"), F.regexp_replace(shown, "^-0$", "0")).otherwise("-")


def ip_protocol(ip: Column) -> Column:
    ip = F.trim(F.coalesce(ip, F.lit("")))
    return F.when(ip.contains(":"), "IPv6").when(ip.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "IPv4").otherwise(UNKNOWN)


def flag_text(flag: Column) -> Column:
    return F.when(flag, "是").when(~flag, "否").otherwise(UNKNOWN)


def state_label(status: Column) -> Column:
    out = F.when(F.coalesce(status, F.lit("")) == "", UNKNOWN)
    for name, label in STATES.items():
        out = out.when(status == name, label)
    return out.otherwise(status)


def risk_tags(status: Column, flags: Column, threat: Column) -> Column:
    """The flags given, else the labels of the threats (a map) that are true; none unless the status is ok."""
    named = F.array_compact(F.array(*[F.when(F.try_element_at(threat, F.lit(k)), v) for k, v in RISK_LABELS.items()]))
    return F.when(~F.coalesce(status == "ok", F.lit(False)), F.array().cast("array<string>")).when(F.size(flags) > 0, flags).otherwise(named)


def do_not_track(value: Column) -> Column:
    return F.when(value.isin("1", "yes"), "已开启").when(value.isin("0", "no"), "未开启").otherwise(UNKNOWN)


def utc_offset(minutes: Column) -> Column:
    """UTC±HH:MM of minutes west of UTC."""
    away = F.abs(minutes)
    return F.concat(F.when(minutes <= 0, "UTC+").otherwise("UTC-"), F.format_string("%02d:%02d", F.floor(away / 60).cast("int"), (away % 60).cast("int")))


def detail_list(rows: Column, css: str = "detail") -> Column:
    """Markup of an array of (label, value); rows of blank values go."""
    safe = lambda c: F.replace(T.escape_html(c), F.lit("&#x27;"), F.lit("&#39;"))
    kept = F.filter(rows, lambda r: F.trim(F.coalesce(r["value"], F.lit(""))) != "")
    shown = F.transform(kept, lambda r: F.concat(F.lit(f'<div class="{css}-row"><dt>'), safe(r["label"]), F.lit("</dt><dd>"), safe(r["value"]), F.lit("</dd></div>")))
    return F.when(F.size(kept) > 0, F.array_join(shown, "")).otherwise(f'<div class="{css}-empty">{NO_DETAILS}</div>')


def candidate_address(candidate: Column) -> Column:
    """Address of a connection candidate: its fifth word if that looks like one, else a .local name, else the word before `typ`."""
    parts = F.split(F.coalesce(candidate, F.lit("")), r"\s+")
    fifth = F.coalesce(F.get(parts, F.lit(4)), F.lit(""))
    local = F.get(F.filter(parts, lambda p: p.endswith(".local")), F.lit(0))
    before = F.get(parts, (F.array_position(parts, "typ") - 2).cast("int"))
    return F.when(fifth.rlike("[.:]"), fifth).otherwise(F.coalesce(local, before, F.lit("")))


def candidate_counts(candidates: Column) -> Column:
    """Numbers of distinct candidates, of their addresses, and of those that are hidden names, plain, private and public."""
    own = F.array_distinct(candidates)
    found = F.array_distinct(F.filter(F.transform(own, candidate_address), lambda a: a != ""))
    number = lambda test: F.size(F.filter(found, test))
    dotted, near = r"^\d+\.\d+\.\d+\.\d+$", r"^(0*10\.|0*127\.|0*169\.0*254\.|0*172\.0*(1[6-9]|2\d|3[01])\.|0*192\.0*168\.)"
    hidden = number(lambda a: a.endswith(".local"))
    return F.struct(
        F.size(own).alias("candidates"), F.size(found).alias("addresses"), hidden.alias("hidden"), (F.size(found) - hidden).alias("plain"),
        number(lambda a: a.rlike(dotted) & a.rlike(near)).alias("private"), number(lambda a: a.rlike(dotted) & ~a.rlike(near)).alias("public"),
    )
