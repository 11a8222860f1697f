import random

import duckdb
import pytest
from pyspark.sql import functions as F

from galleyworks.functions import text as T
from galleyworks.functions import visits as V
from galleyworks.operators import archive as A
from galleyworks.operators import iprisk
from galleyworks.plans import article_queries, client_queries, store_queries  # noqa: F401, add their queries
from galleyworks.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "events", "customer", "nation", "part", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    df = df[cols]
    for c in cols:
        if df[c].dtype.kind == "f":
            df = df.assign(**{c: df[c].map(lambda v: "" if v != v else f"{v:.12g}")})
    df = df.astype(object).where(df.notna(), "").astype(str)
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert plain(Q.QUERIES[name](spark, SF).toPandas()).equals(plain(duck.sql(Q.ORACLES[name]).df()))


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expression(F.col("x"))).orderBy("i").collect()]


def test_urls_and_text(spark):
    assert values(spark, T.is_article_url, ["http://a", "HTTPS://a/b", "ftp://a", "http://", "a.com"]) == [True, True, False, False, False]
    assert values(spark, T.is_archive_url, ["https://mp.weixin.qq.com/s/x", "http://mp.weixin.qq.com/s/x"]) == [True, False]
    assert values(spark, T.source_host, ["http://WWW.Ex.com:8080/a"]) == ["ex.com:8080"]
    assert values(spark, T.clean_text, ["a　b c  d\n"]) == ["a b c d"]
    assert values(spark, T.positive_int, ["12px", "0", "-5", "abc"]) == [12, None, 5, None]
    assert values(spark, T.positive_float, ["0.5", "inf", "-1", "x"]) == [0.5, None, None, None]
    assert values(spark, T.image_extension, ["http://a/640?wx_fmt=JPEG", "http://a/a.webp", "http://a/a.svg"]) == ["jpg", "webp", ""]
    assert values(spark, T.summary, ["a" * 110, "a" * 109 + ", b", "", None]) == ["a" * 110, "a" * 109 + "...", T.EMPTY_SUMMARY, T.EMPTY_SUMMARY]
    assert values(spark, T.article_id, ["https://mp.weixin.qq.com/s/RbUpPj1jG_bl4J9b2L1x6A"]) == ["a7ab296552e7da020642e4150c0b2a4e"]


def test_image_height(spark):
    df = spark.createDataFrame([(5, 0.5), (1, 0.1), (944, 1.3368644067796611)], "w int, r double")
    assert [x[0] for x in df.select(T.image_height(F.col("w"), F.col("r"))).collect()] == [2, 1, 1262]


def test_times(spark):
    given = ["2024-01-02 03:04:05", "2024-01-01T08:00:00+08:00", "2024", "junk", ""]
    assert values(spark, lambda c: F.unix_timestamp(T.article_time(c)), given) == [1704164645, 1704067200, None, None, None]
    assert values(spark, T.display_time, given) == ["2024-01-02 03:04:05", "2024-01-01 08:00:00", "2024", "junk", ""]


def test_visits(spark):
    assert values(spark, V.cookies, ["a=1; a=2; v=x=y; =z", None]) == [{"a": "2", "v": "x=y"}, {}]
    assert values(spark, lambda c: V.ignored_reason(c), ["curl/8", "curlish", "Mozilla Googlebot"]) == ["bot", "", "bot"]
    assert values(spark, lambda c: V.ignored_reason(c, F.lit("prefetch")), ["curl/8"]) == ["prefetch"]
    given = ["100.64.0.1", "100.128.0.1", "172.31.0.1", "172.32.0.1", "::1", "fe80::1", "2001:db8::1", "01.2.3.4", "1.2.3.999", "x"]
    assert values(spark, V.is_public_ip, given) == [False, True, False, True, False, False, True, True, False, False]
    assert values(spark, lambda c: iprisk.residential(c, F.lit("")), ["ISP", "DCH", "Data Center/Web Hosting/Transit", "ISP/MOB", "Web Hosting", " mob "]) == [True, False, False, None, None, True]
    assert values(spark, lambda c: iprisk.residential(F.lit("ISP"), c), ["Hosting", "Data Centers"]) == [True, False]


def test_ttl_and_tail_cut_against_loops(spark):
    assert values(spark, lambda c: A.ttl_misses(c, 3600), [[0, 1800, 3599, 3600, 5000, 7200, 7201], []], "array<bigint>") == [3, 0]
    r = random.Random(1)
    docs = [["x" * r.randint(0, 600) + r.choice(["", "H", "HS", "S", "HH"]) for _ in range(r.randint(1, 12))] for _ in range(300)]

    def loop(blocks):
        total = run = 0
        for i, b in enumerate(blocks):
            s = 3 * ("H" in b) + ("S" in b) + (2 if "HH" in b else 0)
            run = run + s if s else 0
            if total >= A.CUT_AFTER and (s >= A.CUT_SCORE or run >= A.CUT_RUN):
                return i
            total += len(b)
        return None

    score = lambda b: A.promo_score(b, ["H"], ["S"]) + F.when(b.contains("HH"), 2).otherwise(0)
    assert values(spark, lambda c: A.tail_cut(c, score), docs, "array<string>") == [loop(d) for d in docs]
