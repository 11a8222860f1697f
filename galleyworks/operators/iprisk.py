"""Classification of addresses from the answers of three lookups, and the report over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.functions.client import UNKNOWN
from galleyworks.functions.markup import let
from galleyworks.operators import archive as A

# Codes, flags and wordings.
HOME, OTHER = ("ISP", "MOB"), ("DCH", "CDN", "SES", "CSP", "ORG", "EDU", "GOV", "MIL", "COM")
CENTRE_USAGE, CENTRE_CATEGORY = "data center/web hosting/transit", "data centers"
HARD = ("is_tor", "is_proxy", "is_anonymous", "is_known_attacker", "is_known_abuser", "is_threat")
SOFT = ("is_datacenter", "is_bogon", "is_icloud_relay")
FLAG_NAMES = {"is_tor": "Tor", "is_proxy": "代理", "is_anonymous": "匿名网络", "is_known_attacker": "已知攻击者", "is_known_abuser": "已知滥用者", "is_datacenter": "数据中心", "is_icloud_relay": "iCloud Relay", "is_bogon": "bogon"}
PROVIDERS = {"abuse": ("AbuseIPDB", "ABUSEIPDB_API_KEY"), "residential": ("IP2Location", "IP2LOCATION_API_KEY"), "risk": ("ipdata", "IPDATA_API_KEY")}
NO_DETAILS, NO_FLAGS, FAILED, NOT_CONFIGURED = "未返回更多信息。", "未发现明显风险标记。", "查询失败", "未配置"
HIGH, MIDDLE, LOW = "高", "中", "低"
RECORDED, CLEAN, YES, NO = "有记录", "未发现", "是", "否"
ALL_DONE, NONE_CONFIGURED, UNAVAILABLE = "已完成当前访问 IP 检测。", "已识别当前访问 IP，但检测服务尚未配置，当前仅显示访问者 IP。", "已识别当前访问 IP，但检测服务暂时不可用。"
SOME_DONE, ALSO_NOT_CONFIGURED, AND_FAILED, ALSO_FAILED = "已识别当前访问 IP，已完成 %d 项检测", "，另有 %d 项未配置", "、%d 项查询失败", "，另有 %d 项查询失败"
NOTHING_DONE = "已识别当前访问 IP，但仅有未配置或失败的检测项：未配置 %d 项，失败 %d 项。"
NO_THREAT = "Cannot read properties of null (reading 'is_tor')"
OBJECT = "map<string,string>"


def abusive(score: Column, reports: Column) -> Column:
    """By the score, or where it is missing by the reports; null if neither tells."""
    return F.when(score.isNotNull(), score > 0).when(reports > 0, True)


def residential(usage: Column, category: Column) -> Column:
    """True for homes, false for data centres and institutions by their whole text or code, null if unknown."""
    usage, category = F.trim(F.coalesce(usage, F.lit(""))), F.trim(F.coalesce(category, F.lit("")))
    return F.when((F.lower(usage) == CENTRE_USAGE) | (F.lower(category) == CENTRE_CATEGORY), False).when(F.upper(usage).isin(*HOME), True).when(F.upper(usage).isin(*OTHER), False)


def flag_counts(flags: dict[str, Column], top: Column) -> tuple[Column, Column]:
    """How many hard and how many soft flags are true; `top` is the seventh hard one, beside the others."""
    count = lambda found: F.size(F.filter(F.array(*[F.coalesce(x, F.lit(False)) for x in found] or [F.lit(False)]), lambda x: x))
    return count([flags[n] for n in HARD if n in flags] + [top]), count([flags[n] for n in SOFT if n in flags])


def risk(flags: dict[str, Column], top: Column) -> Column:
    """High for any hard flag, middle for any soft one, else low; only true counts, missing ones do not."""
    return _level(*flag_counts(flags, top))


def _level(hard: Column, soft: Column) -> Column:
    return F.when(hard > 0, HIGH).when(soft > 0, MIDDLE).otherwise(LOW)


def overall(states: list[Column]) -> list[Column]:
    """success and message of lookups that are ok, not_configured or error."""
    count = lambda value: F.size(F.filter(F.array(*states), lambda s: s == value))
    ok, none, failed, n = count("ok"), count("not_configured"), count("error"), len(states)
    done = lambda *parts: F.concat(*[F.format_string(p, c) for p, c in parts], F.lit("。"))
    message = (
        F.when(ok == n, ALL_DONE)
        .when((ok > 0) & (none > 0) & (failed == 0), done((SOME_DONE, ok), (ALSO_NOT_CONFIGURED, none)))
        .when((ok > 0) & (none > 0), done((SOME_DONE, ok), (ALSO_NOT_CONFIGURED, none), (AND_FAILED, failed)))
        .when((ok > 0) & (failed > 0), done((SOME_DONE, ok), (ALSO_FAILED, failed)))
        .when(none == n, NONE_CONFIGURED)
        .when((none > 0) & (failed > 0), F.format_string(NOTHING_DONE, none, failed))
        .otherwise(UNAVAILABLE)
    )
    return [(ok > 0).alias("success"), message.alias("message")]


def provider_summary(checks: list[Column]) -> Column:
    """provider：label of each check, joined."""
    return F.array_join(F.transform(F.array(*[F.struct(c["provider"].alias("provider"), c["label"].alias("label")) for c in checks]), lambda c: F.concat(c["provider"], F.lit("："), c["label"])), "；")


def _object(body: Column, path: str) -> Column:
    """Members of a JSON object as text; a JSON null is a member without a value. Empty if it is no object."""
    return let(F.get_json_object(body, path), lambda part: F.coalesce(F.when(part.startswith("{"), F.from_json(part, OBJECT)), F.create_map().cast(OBJECT)))


def _number(members: Column, name: str) -> Column:
    """A member as a number: text is read, null and blanks are 0, what is missing or no number is null."""
    value = lambda text: F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    finite = lambda v: F.when(F.map_contains_key(members, name) & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return let(let(F.trim(F.try_element_at(members, F.lit(name))), value), finite)


def _shown(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _text(members: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(members, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def _summary(none: str, *parts: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), "，"), F.lit("")), F.lit(none))


def _named(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def _let(values: dict[str, Column], use) -> Column:
    """use(values), each of them computed once."""
    return let(F.struct(*[c.alias(n) for n, c in values.items()]), lambda v: use({n: v[n] for n in values}))


def abuse_result(body: Column) -> Column:
    """The answer of the abuse lookup (JSON) as a check."""

    def made(m: Column) -> Column:
        read = {"score": _number(m, "abuseConfidenceScore"), "reports": _number(m, "totalReports"), "last": _text(m, "lastReportedAt")}
        more = {"country_code": _text(m, "countryCode"), "usage_type": _text(m, "usageType"), "isp": _text(m, "isp")}
        return _let(read, lambda v: let(abusive(v["score"], v["reports"]), lambda bad: checked(v["score"], v["reports"], v["last"], bad, more)))

    def checked(score: Column, reports: Column, last: Column, bad: Column, more: dict[str, Column]) -> Column:
        summary = _summary(NO_DETAILS, F.when(score.isNotNull(), F.concat(F.lit("置信分 "), _shown(score))), F.when(reports.isNotNull(), F.concat(F.lit("报告 "), _shown(reports), F.lit(" 次"))), _named("最近上报 ", last))
        return _check("abuse", F.when(bad, RECORDED).when(~bad, CLEAN).otherwise(UNKNOWN), summary, is_abusive=bad, score=score, reports=reports, last_reported_at=last, **more)

    return let(_object(body, "$.data"), made)


def residential_result(body: Column) -> Column:
    """The answer of the usage lookup (JSON) as a check."""

    def made(m: Column) -> Column:
        read = {"usage_type": _text(m, "usage_type", "usageType"), "category": _text(m, "category"), "connection_type": _text(m, "connection_type"), "isp": _text(m, "isp"), "asn": _text(m, "asn"), "country_name": _text(m, "country_name", "countryName")}
        return _let(read, lambda v: let(residential(v["usage_type"], v["category"]), lambda home: checked(v, home)))

    def checked(v: dict[str, Column], home: Column) -> Column:
        parts = [_named(f"{label} ", v[name]) for label, name in (("用途类型", "usage_type"), ("分类", "category"), ("连接类型", "connection_type"), ("ISP", "isp"), ("ASN", "asn"))]
        return _check("residential", F.when(home, YES).when(~home, NO).otherwise(UNKNOWN), _summary(NO_DETAILS, *parts), is_residential=home, **v)

    return let(_object(body, "$"), made)


def risk_result(body: Column) -> Column:
    """The answer of the threat lookup (JSON) as a check. Flags count if they are JSON's true; a threat that is null is an error, one that is missing or no object has no flags."""
    names = [*HARD, *(n for n in SOFT)]

    def made(data: Column) -> Column:
        flags = {n: data["threat"][n] for n in names}
        hard, soft = flag_counts(flags, data["is_threat"])
        shown = F.array_compact(F.array(*[F.when(flags[n], label) for n, label in FLAG_NAMES.items()]))
        summary = _summary(NO_FLAGS, *[F.when(flags[n], F.lit(label)) for n, label in FLAG_NAMES.items()])
        return _let({"hard": hard, "soft": soft}, lambda v: _check("risk", _level(v["hard"], v["soft"]), summary, is_threat=v["hard"] > 0, hard=v["hard"], soft=v["soft"], flags=shown))

    ok = let(F.from_json(body, f"is_threat boolean, threat struct<{','.join(f'{n}:boolean' for n in names)}>"), made)
    null_threat = let(_object(body, "$"), lambda m: F.map_contains_key(m, "threat") & F.try_element_at(m, F.lit("threat")).isNull())
    bad = _check("risk", F.lit(FAILED), F.lit(NO_THREAT), "error", is_threat=F.lit(None).cast("boolean"), hard=F.lit(None).cast("int"), soft=F.lit(None).cast("int"), flags=F.lit(None).cast("array<string>"))
    return F.when(null_threat, bad).otherwise(ok)


def _check(name: str, label: Column, summary: Column, status: str = "ok", **more: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(PROVIDERS[name][0]).alias("provider"), label.alias("label"), summary.alias("summary"), *[c.alias(n) for n, c in more.items()])


RESULTS = {"abuse": abuse_result, "residential": residential_result, "risk": risk_result}


def lookups(addresses: DataFrame, answers: dict[str, DataFrame | None], debug: bool = False) -> DataFrame:
    """addresses (with ip) with a check for each provider (status, provider, label, summary), success, message and summary.

    answers: for each provider its table (ip, body, error), or None where it is not configured; an address without an answer, or with an error, is an
    error of that provider alone. Each is a left join on ip, one row for each, also where a table repeats an ip; with `debug`, checks carry the raw body.
    """
    df = addresses
    for name, (provider, key) in PROVIDERS.items():
        table = answers.get(name)
        fields = lambda status, label, summary, provider=provider: F.struct(F.lit(status).alias("status"), F.lit(provider).alias("provider"), label.alias("label"), summary.alias("summary"))
        if table is None:
            df = df.withColumn(name, fields("not_configured", F.lit(NOT_CONFIGURED), F.lit(f"未配置 {key}，当前仅显示访问者 IP。")))
            continue
        df = df.join(A.one_answer(table, "ip", "body").select("ip", F.struct("body", "error").alias(f"{name}_answer")), "ip", "left")
        answer = F.col(f"{name}_answer")
        failed = fields("error", F.lit(FAILED), F.coalesce(answer["error"], F.lit(FAILED)))
        good = let(RESULTS[name](answer["body"]), lambda made: F.struct(*[made[f].alias(f) for f in ("status", "provider", "label", "summary")]))
        df = df.withColumn(name, F.when(answer["body"].isNotNull() & answer["error"].isNull(), good).otherwise(failed))
        if debug:
            df = df.withColumn(name, F.struct(f"{name}.*", answer["body"].alias("raw")))
        df = df.drop(f"{name}_answer")
    checks = [F.col(n) for n in PROVIDERS]
    return df.select("*", *overall([c["status"] for c in checks]), provider_summary(checks).alias("summary"))
