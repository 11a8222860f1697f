"""Queries of requests, registries, histories, formats and streams; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.functions import client as C
from galleyworks.functions import markup as M
from galleyworks.functions import visits as V
from galleyworks.operators import archive as A
from galleyworks.operators import images
from galleyworks.plans.queries import ORACLES, VISITS, counted_visits, nearest_second, query, table
from galleyworks.sources import files
from galleyworks.streaming import streams


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || '/x/' || page_id AS joined FROM pages")
def q_url_join(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.url_join(F.col("url"), F.concat(F.lit("/x/"), "page_id")).alias("joined"))


@query(
    "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) || '?' || CASE WHEN split_part(split_part(url, '#', 1), '?', 2) = '' THEN '' ELSE split_part(split_part(url, '#', 1), '?', 2) || '&' END "
    "|| 'offset=' || page_id || '&title=' || replace(replace(title, ' ', '+'), '&', '%26') || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS url FROM (SELECT page_id, url, 'a & b ' || page_id AS title FROM pages)"
)
def q_update_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("next", C.update_query(F.col("url"), F.lit("offset"), F.col("page_id").cast("string")))
    return pages.select("page_id", C.update_query(F.col("next"), F.lit("title"), F.concat(F.lit("a & b "), "page_id")).alias("url"))


@query("SELECT page_id, 0 AS ord, trim(url) AS url FROM pages UNION ALL SELECT page_id, 1, 'v' || page_id FROM pages")
def q_registry_links(spark, sf_dir):
    entry = F.to_json(F.struct(F.concat(F.lit(" "), "url", F.lit(" ")).alias("url")))
    document = F.concat(F.lit("["), entry, F.lit(',"v'), "page_id", F.lit('",5,{"x":1},""]'))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.registry_items(document)).alias("ord", "url"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN '[]' ELSE '["' || page_id || '"]' END AS registry FROM pages""")
def q_remote_registry(spark, sf_dir):
    status = F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)
    coded = F.base64(F.encode(F.concat(F.lit('["'), "page_id", F.lit('"]')), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", files.remote_registry(status, F.when(F.col("page_id") % 5 == 0, "!!").otherwise(coded)).alias("registry"))


@query("""SELECT page_id, unnest(['https://mp.weixin.qq.com/s/' || page_id, 'https://mp.weixin.qq.com/s?a=' || page_id || '&b=2']) AS link FROM pages""")
def q_history_links(spark, sf_dir):
    item = lambda *parts: F.struct(F.concat(*parts).alias("content_url"))
    more = F.array(item(F.lit("https://mp.weixin.qq.com/s?a="), "page_id", F.lit("&amp;b=2")), item(F.lit("https://other.example/"), "page_id"))
    info = F.struct(F.concat(F.lit("http://mp.weixin.qq.com/s/"), "page_id").alias("content_url"), more.alias("multi_app_msg_item_list"))
    messages = F.to_json(F.struct(F.array(F.struct(info.alias("app_msg_ext_info"))).alias("list")))
    body = F.to_json(F.struct(F.lit(0).alias("ret"), messages.alias("general_msg_list")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(C.history_links(body)).alias("link"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'password' WHEN c_custkey % 60 = 0 THEN 'no links' WHEN c_custkey % 60 > 50 THEN 'too many links' WHEN c_custkey % 11 = 0 THEN 'no valid link' END AS problem FROM customer""")
def q_submit_check(spark, sf_dir):
    k = F.col("c_custkey")
    link = F.when(k % 11 == 0, "ftp://a/").otherwise("https://a/")
    return table(spark, sf_dir, "customer").select("c_custkey", C.submit_problem(k % 7 != 0, F.array_repeat(link, (k % 60).cast("int"))).alias("problem"))


@query("""SELECT c_custkey, '<div class="detail-row"><dt>a &amp; b</dt><dd>' || c_name || '</dd></div>' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<div class="detail-row"><dt>it&#39;s</dt><dd>' || c_mktsegment || '</dd></div>' END AS html FROM customer""")
def q_detail_list(spark, sf_dir):
    row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    rows = F.array(row("a & b", F.col("c_name")), row("it's", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))))
    return table(spark, sf_dir, "customer").select("c_custkey", C.detail_list(rows).alias("html"))


@query(f"""WITH c AS (SELECT *, c_custkey % 1440 - 720 AS m FROM customer)
  SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' / Oslo' END AS place, CASE c_custkey % 3 WHEN 0 THEN 'IPv4' WHEN 1 THEN 'IPv6' ELSE '{C.UNKNOWN}' END AS protocol,
  CASE c_custkey % 3 WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE '{C.UNKNOWN}' END AS flag, CASE c_custkey % 3 WHEN 0 THEN '已完成' WHEN 1 THEN '查询失败' ELSE 'other' END AS state,
  CASE WHEN m <= 0 THEN 'UTC+' ELSE 'UTC-' END || printf('%02d:%02d', abs(m) // 60, abs(m) % 60) AS zone,
  CASE WHEN c_custkey % 3 <> 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'Tor,bogon' ELSE 'bogon' END AS tags FROM c""")
def q_client_formats(spark, sf_dir):
    k = F.col("c_custkey")
    case = lambda *of: F.when(k % 3 == 0, of[0]).when(k % 3 == 1, of[1]).otherwise(of[2])
    threat = F.create_map(F.lit("isTor"), k % 2 == 0, F.lit("isBogon"), F.lit(True), F.lit("other"), F.lit(True))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", C.location(F.col("c_mktsegment"), F.when(k % 4 == 0, C.UNKNOWN).otherwise("Oslo"), F.lit("")).alias("place"), C.ip_protocol(case("1.2.3.4", "::1", "x")).alias("protocol"),
        C.flag_text(F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("flag"), C.state_label(case("ok", "error", "other")).alias("state"), C.utc_offset(k % 1440 - 720).alias("zone"),
        F.array_join(C.risk_tags(case("ok", "error", "other"), F.array().cast("array<string>"), threat), ",").alias("tags"),
    )


_ADDRESS = "CASE event_id % 4 WHEN 0 THEN '10.0.0.' || (event_id % 7) WHEN 1 THEN '8.8.8.' || (event_id % 9) WHEN 2 THEN 'h' || (event_id % 3) || '.local' ELSE '192.168.1.1' END"


@query(f"""WITH a AS (SELECT user_id, event_id % 4 AS k, {_ADDRESS} AS address, 'candidate:' || (event_id % 5) AS head FROM events)
  SELECT user_id, count(DISTINCT head || address)::INT AS candidates, count(DISTINCT address)::INT AS addresses, count(DISTINCT address) FILTER (k = 2)::INT AS hidden, count(DISTINCT address) FILTER (k <> 2)::INT AS plain,
  count(DISTINCT address) FILTER (k IN (0, 3))::INT AS private, count(DISTINCT address) FILTER (k = 1)::INT AS public FROM a GROUP BY user_id""")
def q_connection_candidates(spark, sf_dir):
    candidate = F.concat(F.lit("candidate:"), F.col("event_id") % 5, F.lit(" 1 udp 99 "), F.expr(_ADDRESS), F.lit(" 5000 typ host"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(candidate).alias("candidates"))
    return e.select("user_id", C.candidate_counts(F.col("candidates")).alias("c")).select("user_id", "c.*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/event[s].parquet"  # a pattern, as a stream takes a folder or a pattern but no single file
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS uv FROM events GROUP BY 1")
def q_stream_daily_uv(spark, sf_dir):
    visits = events_stream(spark, sf_dir).select("ts", V.local_day(F.col("ts")).cast("string").alias("day"), F.concat(F.lit("v"), "user_id").alias("visitor"))
    return streams.run_to_table(streams.first_visits(visits), "uv").groupBy("day").agg(F.count("*").alias("uv"))


@query("SELECT event_type AS page, json_extract_string(props, '$.k') AS article_id, count(*) AS pv FROM events GROUP BY ALL")
def q_stream_page_counts(spark, sf_dir):
    visits = events_stream(spark, sf_dir).select(F.col("event_type").alias("page"), F.get_json_object("props", "$.k").alias("article_id"))
    return streams.run_to_table(streams.page_counts(visits), "pv", "complete")


@query(ORACLES["q_ip_cache_ttl"])
def q_stream_cache(spark, sf_dir):
    requests = events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("ip"), F.col("event_id").cast("long").alias("request"), F.timestamp_seconds(nearest_second(F.col("ts"))).alias("ts"), F.lit(False).alias("debug"))
    looked = streams.run_to_table(streams.cached_lookups(requests), "lookups")
    return looked.groupBy(F.col("ip").cast("long").alias("user_id")).agg(F.count("*").alias("misses"))


@query("""SELECT page_id, '<p><img src="/assets/images/' || page_id || '/' || md5('https://i.example/' || page_id || '.png') || '.png" data-w="100" data-ratio="0.5" alt="" loading="lazy" width="100" height="50" data-original-src="https://i.example/' || page_id
  || '.png" data-src="/assets/images/' || page_id || '/' || md5('https://i.example/' || page_id || '.png') || '.png"/></p>' AS content_html FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, '<p><img src="https://i.example/' || page_id || '.png" data-w="100" data-ratio="0.5" alt="" loading="lazy" width="100" height="50"/></p>' FROM pages WHERE page_id % 2 = 1""")
def q_localised_images(spark, sf_dir):
    source = F.concat(F.lit("https://i.example/"), "page_id", F.lit(".png"))
    html = F.concat(F.lit('<p><img src="'), source, F.lit('" data-w="100" data-ratio="0.5"></p>'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("id"), F.lit(True).alias("success"), html.alias("content_html"))
    downloads = table(spark, sf_dir, "pages").select(source.alias("source"), F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("text/html").alias("content_type"))
    return images.localise(pages, downloads).select("page_id", "content_html")


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{M.PREFETCH_MESSAGE}' WHEN 1 THEN '{M.BOT_MESSAGE}' WHEN 2 THEN '{M.ARTICLE_MESSAGE}' ELSE '{M.SITE_MESSAGE}' END
  || replace('{M.DAY_MESSAGE}', '%s', 'day' || (event_id % 3)) AS message FROM events""")
def q_visit_messages(spark, sf_dir):
    k = F.col("event_id") % 4
    reason = F.when(k == 0, "prefetch").when(k == 1, "bot").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", M.visit_message(F.when(k == 2, "article").otherwise("site"), k >= 2, reason, F.concat(F.lit("day"), F.col("event_id") % 3)).alias("message"))


@query(VISITS + """, n AS (SELECT article_id, count(*) AS pv FROM c WHERE page = 'article' GROUP BY article_id)
  SELECT page_id, coalesce(pv, 0) AS pv, format('{:,}', coalesce(pv, 0) * 1000 + page_id) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.5' ELSE '.125' END AS shown FROM pages LEFT JOIN n ON n.article_id = md5(url)""")
def q_article_report(spark, sf_dir):
    counts = counted_visits(spark, sf_dir).filter("page = 'article'").groupBy("article_id").agg(F.count("*").alias("pv"))
    df = A.article_report(table(spark, sf_dir, "pages").select("page_id", "url"), counts)
    part = F.when(F.col("page_id") % 3 == 0, 0.0).when(F.col("page_id") % 3 == 1, 0.5).otherwise(0.125)
    return df.select("page_id", "pv", C.stat_number(F.col("pv") * 1000 + F.col("page_id") + part).alias("shown"))
