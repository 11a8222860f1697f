"""Readers and writers of link documents, caches and rendered pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.functions.text import article_time
from galleyworks.operators.archive import last_wins


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """value: each file's whole text; no rows where there is nothing."""
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def json_or_default(value: Column, schema: str, default: Column) -> Column:
    """Parsed JSON; the default if it is malformed or missing."""
    return F.when(F.try_parse_json(value).isNotNull(), F.coalesce(F.from_json(value, schema), default)).otherwise(default)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files; a malformed one fails the job."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def registry_entries(document: Column) -> Column:
    """(url, created_at, source) of the `links` of a registry in their order, or of a bare JSON array: texts, and objects with a url; others go, as do empty ones."""
    whole = F.try_parse_json(document)
    items = F.coalesce(F.try_variant_get(whole, "$.links", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    kind = lambda x: F.schema_of_variant(x)
    of = lambda x, name: F.when(kind(x).startswith("OBJECT"), F.try_variant_get(x, f"$.{name}", "string"))
    entry = lambda x: F.struct(F.trim(F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(of(x, "url"))).alias("url"), of(x, "created_at").alias("created_at"), of(x, "source").alias("source"))
    return F.filter(F.transform(items, entry), lambda e: F.coalesce(e["url"], F.lit("")) != "")


def registry_items(document: Column) -> Column:
    """The urls of registry_entries."""
    return F.transform(registry_entries(document), lambda e: e["url"])


def registry_links(documents: DataFrame) -> DataFrame:
    """ord (place in its document), url of documents (value)."""
    return documents.select(F.posexplode(registry_items(F.col("value"))).alias("ord", "url"))


def text_links(lines: DataFrame) -> DataFrame:
    """url: trimmed lines (value) that are neither empty nor comments."""
    url = F.trim("value")
    return lines.select(url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def remote_registry(status: Column, content: Column) -> Column:
    """Text of a registry that came as base64; an empty array if it is missing (404), no base64, no UTF-8 or no JSON."""
    text = F.try_validate_utf8(F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64")).cast("string"))
    return F.when((status == 404) | F.try_parse_json(text).isNull(), "[]").otherwise(text)


def cached_articles(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with url and success, the last successful one of each url."""
    return last_wins(rows.filter(F.col("success") & (F.coalesce("url", F.lit("")) != "")), "url", order)


def read_cache(spark: SparkSession, primary: str, legacy: str, schema: str) -> DataFrame:
    """Cached articles (of `schema`, which has url, success and ord) in the primary place, or in the legacy one if there is nothing; the last success of each url."""
    rows = whole_files(spark, primary)
    if rows.isEmpty():
        rows = whole_files(spark, legacy)
    items = F.try_variant_get(F.try_parse_json("value"), "$.articles", "array<variant>")
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    listed = rows.select(F.posexplode(F.transform(objects, lambda x: F.try_variant_get(x, "$", f"struct<{schema}>"))).alias("ord", "a"))
    return cached_articles(listed.select("ord", "a.*").filter("url IS NOT NULL"), "ord")


def write_cache(articles: DataFrame, path: str) -> None:
    """All articles, failures too, the newest first where there is a publish_time; nulls keep their field."""
    if "publish_time" in articles.columns:
        articles = articles.orderBy(article_time(F.col("publish_time")).desc_nulls_last())
    articles.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """article_id, html below one of 256 folders by the id's first two digits, so that a page is found without a scan of all."""
    pages.withColumn("part", F.substring("article_id", 1, 2)).write.mode("overwrite").partitionBy("part").parquet(path)
