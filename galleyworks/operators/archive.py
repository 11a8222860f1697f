"""Joins, folds and orders of the article archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyworks.functions import text as T
from galleyworks.operators.order import numbered
from galleyworks.shared import written

# After so many characters a block of so high a score, or a run of blocks of so high a sum, ends an article.
CUT_AFTER, CUT_SCORE, CUT_RUN = 1200, 5, 8
HARD_MARKERS = ["点击直达", "长按识别二维码", "百亿补贴", "同款好物", "拼多多搜", "二维码"]
SOFT_MARKERS = ["官网价", "大促价", "元起", "补贴", "券包", "会场"]
BRAND, PRODUCTS = "拼多多", ["iPhone", "MacBook", "茅台"]


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; map-side combined, so a frequent key is no large group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def incremental_merge(links: DataFrame, cache: DataFrame, fetched: DataFrame, refetch: bool = False, key: str = "url") -> DataFrame:
    """links (with key) and the row that a build uses: a cached success unless `refetch`, else the fetch, else the cached one.

    cache and fetched: key, ok, payload; of rows that repeat a key one counts, a success before others, then the first by its payload, so that links never multiply.
    Links that share a url but were cached and fetched each for itself need a key of their own. origin: cache, fetch, fallback or missing.
    """
    c = cache.filter("ok").groupBy(key).agg(F.min("payload").alias("cached"))
    best = F.min(F.struct((~F.coalesce("ok", F.lit(False))).alias("bad"), F.col("payload").alias("payload"))).alias("best")
    f = fetched.groupBy(key).agg(best).select(key, (~F.col("best.bad")).alias("fetch_ok"), F.col("best.payload").alias("fetch"))
    both = links.join(c, key, "left").join(f, key, "left")
    use_cache = F.col("cached").isNotNull() & F.lit(not refetch)
    origin = F.when(use_cache, "cache").when(F.coalesce("fetch_ok", F.lit(False)), "fetch").when(F.col("cached").isNotNull(), "fallback").otherwise("missing")
    payload = F.when(use_cache, F.col("cached")).when(F.coalesce("fetch_ok", F.lit(False)), F.col("fetch")).otherwise(F.coalesce("cached", F.col("fetch")))
    return both.select(*[F.col(f"`{n}`") for n in links.columns], origin.alias("origin"), payload.alias("payload"))


def promo_score(text: Column, hard: list[str], soft: list[str]) -> Column:
    """3 for each hard marker in text, 1 for each soft one."""
    score = F.lit(0)
    for words, weight in ((hard, 3), (soft, 1)):
        for w in words:
            score = score + F.when(text.contains(w), weight).otherwise(0)
    return score


def block_promo_score(text: Column) -> Column:
    """The score of a block by the archive's markers, 2 more for the brand and 1 for any of the products."""
    product = F.lit(False)
    for p in PRODUCTS:
        product = product | text.contains(p)
    return promo_score(text, HARD_MARKERS, SOFT_MARKERS) + F.when(text.contains(BRAND), 2).otherwise(0) + F.when(product, 1).otherwise(0)


def tail_cut(blocks: Column, score) -> Column:
    """Index (from 0) at which an array of block texts is cut, null if it is not; one fold, no shuffle."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("run"), F.lit(None).cast("int").alias("cut"))

    def step(acc: Column, b: Column) -> Column:
        s = score(b)
        run = F.when(s == 0, 0).otherwise(acc["run"] + s)
        hit = (acc["sum"] >= CUT_AFTER) & ((s >= CUT_SCORE) | (run >= CUT_RUN))
        return F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.length(b)).alias("sum"), run.alias("run"), F.coalesce(acc["cut"], F.when(hit, acc["i"])).alias("cut"))

    return F.aggregate(blocks, start, step, lambda acc: acc["cut"])


def one_answer(answers: DataFrame, key: str, body: str) -> DataFrame:
    """key, body, error: one row for each key, one with a body and without an error before others, then the first by its text."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), F.col(body).isNull().alias("none"), F.col(body).alias("body"), F.col("error").alias("error"))).alias("best")
    return answers.groupBy(key).agg(best).select(key, F.col("best.body").alias(body), "best.error")


def article_report(articles: DataFrame, counts: DataFrame, url: str = "url") -> DataFrame:
    """articles with `article_id` and `pv`, the reads that `counts` (article_id, pv; one row an id) has of them, 0 if none. Counts of ids that no article has stay out; articles that share a url share their reads; columns of these two names are replaced."""
    made = articles.drop("pv").withColumn("article_id", T.article_id(F.col(url)))
    return made.join(counts.select("article_id", F.col("pv").alias("pv")), "article_id", "left").withColumn("pv", F.coalesce("pv", F.lit(0)))


def positions(articles: DataFrame, time: Column, *tie: str) -> DataFrame:
    """articles with `position`, from 1 in the archive's order: the newest `time` first, those without one last, equal times by `tie` (an order of its own, or rows of one time come in any order)."""
    placed = numbered(articles.withColumn("_time", time), F.col("_time").desc_nulls_last(), *tie, name="position", keep=articles.columns)
    return placed.withColumn("position", F.col("position") + 1)


def chunks(df: DataFrame, order: str, size: int, group: str) -> DataFrame:
    """df with `chunk`, numbering batches of `size` rows within a group in order."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))


def ttl_misses(times: Column, ttl: int) -> Column:
    """How many of the ascending epoch seconds find no cached result: a result lives `ttl` seconds from its miss; hits do not prolong it."""
    start = F.struct(F.lit(None).cast("long").alias("since"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, t: Column) -> Column:
        miss = acc["since"].isNull() | (t - acc["since"] >= ttl)
        return F.struct(F.when(miss, t).otherwise(acc["since"]).alias("since"), (acc["n"] + miss.cast("long")).alias("n"))

    return F.aggregate(times, start, step, lambda acc: acc["n"])


def running_totals(df: DataFrame, keys: list[str], values: dict[str, Column], time: str, tie: str, table: DataFrame | None = None) -> DataFrame:
    """df with the running sum of each value by (time, tie) within keys, the row's own included.

    Sums of minutes run first, a row for each minute and key; then each minute's rows run among themselves. So no key, and no day, is one task.
    table: the same rows, from which the minutes are summed; where totals follow one another, a stored one spares the making of df twice for each.
    """
    told = lambda t: t.select("*", F.date_trunc("minute", F.col(time)).alias("_minute"), *[v.alias(f"_own_{n}") for n, v in values.items()])
    rows, summed = told(df), told(df if table is None else table)
    minutes = summed.groupBy(*keys, "_minute").agg(*[F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_minute").alias("_of_minute"), *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    at = F.col("_minute").eqNullSafe(F.col("_of_minute"))
    for k in keys:
        at = at & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = Window.partitionBy(*keys, "_minute").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(minutes, at).select(*df.columns, *[(F.col(f"_before_{n}") + F.sum(f"_own_{n}").over(within)).alias(n) for n in values])


def first_visits(visits: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The tie of the first of each key by (time, tie); map-side combined."""
    return visits.groupBy(*keys).agg(F.min(F.struct(time, tie)).alias("f")).select(F.col(f"f.{tie}").alias(tie))


def snapshots(visits: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """visits (event_id, ts, day, visitor, page, article_id, counted) with the counters after each: site_pv of all time, site_uv of the day, article_pv of the article and null for the site's own. Hits that do not count read what the others left.

    seen: day, visitor of those that were there before all of visits.
    """
    counted = visits.filter("counted")
    if seen is not None:
        counted = counted.join(seen, ["day", "visitor"], "left_anti")
    first = first_visits(counted, ["day", "visitor"], "ts", "event_id").withColumn("_first", F.lit(1))
    one, article = F.col("counted").cast("int"), F.col("page") == "article"
    table = written(visits.join(first, "event_id", "left").withColumn("_article", F.when(article, F.col("article_id"))), "snapshots")
    df = running_totals(table, [], {"site_pv": one}, "ts", "event_id")
    df = running_totals(df, ["day"], {"site_uv": F.coalesce("_first", F.lit(0))}, "ts", "event_id", table)
    df = running_totals(df, ["_article"], {"article_pv": one}, "ts", "event_id", table)
    return df.withColumn("article_pv", F.when(article, F.col("article_pv"))).drop("_first", "_article")
