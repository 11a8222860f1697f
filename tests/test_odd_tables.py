"""Queries against their SQL on small tables that hold what the test tables seldom do."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from galleyworks.functions import text as T
from galleyworks.operators import archive as A
from galleyworks.operators import iprisk
from galleyworks.plans import article_queries, client_queries, store_queries  # noqa: F401, add their queries
from galleyworks.plans import queries as Q


def compared(spark, folder, name, **tables):
    """Rows of a query and of its SQL, sorted; tables as DataFrames."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    made = Q.QUERIES[name](spark, str(folder))
    shown = lambda rows: sorted(map(repr, rows))
    return shown(tuple(r) for r in made.collect()), shown(c.sql(f"select {', '.join(made.columns)} from ({Q.ORACLES[name]})").fetchall())


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_cut_references(spark, tmp_path):
    page = f"<html><head><title>a &amp</title></head><body><article><h1>cut &amp</h1><p>{'word &amp; ' * 20}&copy; &lt</p></article></body></html>"
    made, sql = compared(spark, tmp_path, "q_extract_selectors", pages=pages(spark, *((k, f"https://h.example/{k}", page) for k in range(12))))
    assert made == sql
    assert T.unescape_closed("&amp &amp; &notit; &not; &#65 &#65; &#x42; &nosuch; &eacute;") == "&amp & &notit; ¬ &#65 A B &nosuch; é"


def test_fetched_pages_that_share_a_url(spark, tmp_path):
    made, sql = compared(spark, tmp_path, "q_fetch_rows", pages=pages(spark, *((k, f"https://h.example/{k // 4}", "") for k in range(12))))
    assert made == sql and len(made) == 12


def test_merged_pages_that_share_a_url(spark, tmp_path):
    made, sql = compared(spark, tmp_path, "q_incremental_merge", pages=pages(spark, *((k, f"https://h.example/{k // 4}", "") for k in range(30))))
    assert made == sql and len(made) == 30
    links, cache = spark.createDataFrame([("u",), ("v",)], "url string"), spark.createDataFrame([("u", True, "b"), ("u", True, "a"), ("u", False, "0")], "url string, ok boolean, payload string")
    fetched = spark.createDataFrame([("v", False, "e"), ("v", True, "x"), ("v", None, "n")], "url string, ok boolean, payload string")
    assert sorted(A.incremental_merge(links, cache, fetched).collect()) == [("u", "cache", "a"), ("v", "fetch", "x")]


def events(spark, *seconds):
    """A user's events at these seconds of a day, given with fractions; its rounding decides whether an hour has passed."""
    rows = spark.createDataFrame([(k, s, 7) for k, s in enumerate(seconds)], "event_id long, s decimal(12,6), user_id long")
    return rows.select("event_id", F.expr("timestamp_micros(1704067200000000 + CAST(s * 1000000 AS LONG))").cast("timestamp_ntz").alias("ts"), "user_id")


HOURS = ("10.4", "3609.6", "7300.6", "10900.4", "20000.5", "23599.5", "30001.5")


@pytest.mark.parametrize("name", ["q_ip_cache_ttl", "q_stream_cache"])
def test_times_between_seconds(spark, tmp_path, name):
    made, sql = compared(spark, tmp_path, name, events=events(spark, *map(Decimal, HOURS)))
    assert made == sql


def test_an_answer_is_parsed_once(spark):
    answers = spark.createDataFrame([("a", "{}", None)], "ip string, body string, error string")
    plan = iprisk.lookups(answers.select("ip"), dict.fromkeys(iprisk.PROVIDERS, answers))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 4


def test_snapshots_make_their_rows_once(spark):
    rows = spark.createDataFrame([(1, 0, "2024-01-01", "v", "site", None, True)], "event_id long, s long, day string, visitor string, page string, article_id string, counted boolean")
    hits = rows.select("*", F.timestamp_seconds("s").alias("ts")).drop("s")
    plan = A.snapshots(hits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4 and "LocalRelation" not in plan and "LogicalRDD" not in plan  # one for the rows, one for the sums of each counter
