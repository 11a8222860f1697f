"""Column functions for visit logs and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOTS = r"(?i)bot|crawler|spider|slurp|bingpreview|facebookexternalhit|python-requests|curl\b|wget\b|go-http-client|HeadlessChrome"
PREFETCH = r"(?i)prefetch|prerender|preview"
ARTICLE_ID = r"^[a-f0-9]{32}$"
ZONE = "Asia/Shanghai"
BROWSERS = ((r"Edg/(\d+)", "Microsoft Edge"), (r"OPR/(\d+)", "Opera"), (r"Chrome/(\d+)", "Chrome"), (r"Firefox/(\d+)", "Firefox"), (r"Version/(\d+).+Safari/", "Safari"))
SYSTEMS = (("Windows NT 10", "Windows 10/11"), ("Windows NT", "Windows"), ("Mac OS X", "macOS"), ("iPhone|iPad|iPod", "iOS / iPadOS"), ("Android", "Android"), ("Linux", "Linux"))
COOKIE_AGE = 34560000


def ignored_reason(user_agent: Column, *headers: Column) -> Column:
    """prefetch, bot or empty; the headers are looked at first."""
    fetched = F.lit(False)
    for h in headers:
        fetched = fetched | F.coalesce(h, F.lit("")).rlike(PREFETCH)
    return F.when(fetched, "prefetch").when(F.coalesce(user_agent, F.lit("")).rlike(BOTS), "bot").otherwise("")


def cookies(header: Column) -> Column:
    """Map of a Cookie header; the later of two of one name stays, nameless parts go."""
    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p.rlike("^[^=]+="))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def visitor_id() -> Column:
    """A new random id."""
    return F.uuid()


def visitor_cookie(request_url: Column, visitor: Column, name: str = "visitor_id") -> Column:
    """Set-Cookie of a visitor; secure where the request was."""
    parts = [F.concat(F.lit(f"{name}="), visitor), F.lit("Path=/"), F.lit(f"Max-Age={COOKIE_AGE}"), F.lit("HttpOnly"), F.lit("SameSite=Lax"), F.when(request_url.rlike("^(?i:https):"), "Secure")]
    return F.concat_ws("; ", *parts)


def first_header_value(value: Column) -> Column:
    """First item of a comma list that is not blank, else empty."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0)), F.lit(""))


def visitor_ip(headers: Column, trusted: str = "cf-connecting-ip") -> Column:
    """Address that the trusted header names; forwarded addresses, which clients can set, are not looked at."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    return first_header_value(F.try_element_at(lower, F.lit(trusted)))


def local_day(ts: Column) -> Column:
    """Calendar day in ZONE of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), ZONE))


def valid_payload(page: Column, article_id: Column) -> Column:
    page = F.lower(F.trim(page))
    return (page == "site") | ((page == "article") & F.coalesce(F.lower(F.trim(article_id)), F.lit("")).rlike(ARTICLE_ID))


def _octet(ip: Column, i: int) -> Column:
    return F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")


def is_ipv4(ip: Column) -> Column:
    good = ip.rlike(r"^\d+(\.\d+){3}$")
    for i in range(1, 5):
        good = good & F.coalesce(_octet(ip, i) <= 255, F.lit(False))
    return good


def is_private_ipv4(ip: Column) -> Column:
    a, b = _octet(ip, 1), _octet(ip, 2)
    return is_ipv4(ip) & (a.isin(10, 127, 0) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))


def is_private_ipv6(ip: Column) -> Column:
    low = F.lower(ip)
    return (low == "::1") | low.startswith("fc") | low.startswith("fd") | low.startswith("fe80:")


def is_public_ip(ip: Column) -> Column:
    return F.when(is_ipv4(ip), ~is_private_ipv4(ip)).when(ip.contains(":"), ~is_private_ipv6(ip)).otherwise(False)


def first_of(rules: tuple[tuple[str, str], ...], value: Column, other: str) -> Column:
    """Name of the first rule that matches."""
    out = None
    for pattern, name in rules:
        out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
    return out.otherwise(other)
