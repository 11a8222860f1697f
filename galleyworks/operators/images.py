"""Images of articles, moved to local addresses where their download is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.functions import markup as M
from galleyworks.functions import text as T


def remote_images(articles: DataFrame) -> DataFrame:
    """id, source: the distinct remote images of each successful article's content_html."""
    found = F.transform(F.regexp_extract_all("content_html", F.lit(M.tags("img")), F.lit(0)), lambda t: M.image_source(M.attributes(t)))
    rows = articles.filter("success").select("id", F.explode(F.array_distinct(found)).alias("source"))
    return rows.filter(F.col("source").rlike("^https?://"))


def local_path(article: Column, source: Column, content_type: Column) -> Column:
    """Where a downloaded image is; null if the answer was no image."""
    kind = F.coalesce(content_type, F.lit(""))
    extension = F.coalesce(F.nullif(T.image_extension(source), F.lit("")), M.extension_of_type(kind))
    return F.when((kind == "") | F.lower(kind).startswith("image/"), F.concat(F.lit(M.LOCAL_IMAGES), article, F.lit("/"), F.md5(source), F.lit("."), extension))


def to_download(articles: DataFrame, assets: DataFrame) -> DataFrame:
    """id, source of the remote images whose (article_id, digest) the stored `assets` lack."""
    wanted = remote_images(articles).withColumn("digest", F.md5("source"))
    stored = assets.select(F.col("article_id").alias("id"), "digest").distinct()
    return wanted.join(stored, ["id", "digest"], "left_anti").select("id", "source").distinct()


def localise(articles: DataFrame, downloads: DataFrame) -> DataFrame:
    """articles (id, success, content_html and any more) with the images that `downloads` (source, content_type) has at local addresses.

    The old address stays in data-original-src. Images without a download keep theirs; all get alt, loading and sizes.
    Images are joined with their downloads by address and gathered by article, so no table is sent whole to a task.
    """
    known = downloads.groupBy("source").agg(F.max(F.coalesce("content_type", F.lit(""))).alias("content_type"))
    moved = remote_images(articles).join(known, "source").withColumn("path", local_path(F.col("id"), F.col("source"), F.col("content_type"))).filter("path IS NOT NULL")
    moved = moved.groupBy(F.col("id").alias("of_")).agg(F.map_from_entries(F.collect_list(F.struct("source", "path"))).alias("moved_"))
    none = F.create_map().cast("map<string,string>")
    rows = articles.join(moved, F.col("id") == F.col("of_"), "left").withColumn("moved_", F.coalesce("moved_", none))

    def moved_to(values: Column, source: Column, path: Column) -> Column:
        new = F.create_map(F.lit("data-original-src"), source, F.lit("src"), path, F.lit("data-src"), path)
        return M.opening_tag("img", F.map_concat(values, F.when(path.isNotNull(), new).otherwise(none)), "/")

    image = lambda t: M.let(M.let(M.attributes(t), M.image_attributes), lambda v: M.let(M.image_source(v), lambda s: moved_to(v, s, F.col("moved_")[s])))
    html = F.when(F.col("success"), M.rewritten(F.col("content_html"), M.tags("img"), image)).otherwise(F.col("content_html"))
    return rows.withColumn("content_html", html).select(*articles.columns)
