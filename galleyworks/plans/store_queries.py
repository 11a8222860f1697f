"""Queries of stores that are written in versions, and of the whole archive's order; they join those of `queries`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyworks.functions import text as T
from galleyworks.operators import archive as A
from galleyworks.plans.queries import ORACLES, _raw_times, query, table, visits
from galleyworks.shared import new_path
from galleyworks.sources.cache import ArticleCache
from galleyworks.sources.versions import Registry
from galleyworks.streaming.counters import VisitCounters


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 2 = 0 THEN epoch(date_trunc('second', ts))::BIGINT ELSE epoch(date_trunc('second', ts))::BIGINT - 28800 END AS s FROM events)
          SELECT event_id, row_number() OVER (ORDER BY s DESC NULLS LAST, event_id) AS position FROM r""")
def q_archive_order(spark, sf_dir):
    return A.positions(_raw_times(spark, sf_dir), T.article_time(F.col("raw")), "event_id").select("event_id", "position")


@query("""WITH p AS (SELECT trim(url) AS url, min(page_id % 3 * 1000000000000 + page_id) AS o FROM pages WHERE trim(url) <> '' GROUP BY 1)
          SELECT url, row_number() OVER (ORDER BY o) - 1 AS ord, 't' || (o // 1000000000000) AS created_at FROM p""")
def q_registry_commits(spark, sf_dir):
    """Three additions, each of which finds links of those before it."""
    registry, pages = Registry(spark, new_path(spark, "registry")), table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("ord"))
    for k in range(3):
        registry.add(pages.filter(F.col("ord") % 3 == k), f"t{k}")
    return registry.read().select("url", "ord", "created_at")


@query(ORACLES["q_stats_snapshot"])
def q_stream_snapshots(spark, sf_dir):
    """The counters after each hit, applied in three batches by time."""
    hits = visits(spark, sf_dir).filter("valid").withColumn("counted", F.col("reason") == "")
    first, last = hits.agg(F.min("ts"), F.max("ts")).first()
    third = [first + (last - first) * k / 3 for k in range(3)] if first else []
    counters, out = VisitCounters(spark, new_path(spark, "counters")), []
    for k, begin in enumerate(third):
        own = F.col("ts") >= F.lit(begin)
        out.append(counters.apply(hits.filter(own & (F.col("ts") < F.lit(third[k + 1])) if k < 2 else own), "q", k))
    done = reduce(DataFrame.unionByName, out) if out else A.snapshots(hits)
    return done.select("event_id", "site_pv", "site_uv", "article_pv")


@query("""SELECT url, max(CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) AS again, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY url""")
def q_cache_update(spark, sf_dir):
    """A build of all pages, then one of those that changed: what is in the cache after both."""
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("again"), F.min("page_id").alias("ord"))
    cache = ArticleCache(spark, new_path(spark, "cache"), "url string, ord long, again int, n long")
    cache.update(pages.withColumn("again", F.lit(0)))
    cache.update(pages.filter("again = 1"))
    return cache.read().select("url", "again", "n")
