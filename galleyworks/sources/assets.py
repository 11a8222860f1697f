"""Folders of stored images: listing, marking and removal of those that no article has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def asset_folders(spark: SparkSession, base: str) -> DataFrame:
    """id, path, files, bytes of the folders right below base that hold files, at any depth; Spark lists large trees in parallel, and reads no content."""
    base = base.rstrip("/")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "id string, path string, files long, bytes long")
    name = base.rpartition("/")[2]
    below = F.substring_index(F.col("path"), f"/{name}/", -1) if "/" not in name else F.col("path")
    files = files.withColumn("id", F.when(below.contains("/"), F.substring_index(below, "/", 1))).filter("id IS NOT NULL")
    return files.groupBy("id").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select("id", F.concat(F.lit(base + "/"), "id").alias("path"), "files", "bytes")


def unused(folders: DataFrame, articles: DataFrame) -> DataFrame:
    """folders whose id no article has; articles: id, null and empty ones count for nothing."""
    return folders.join(articles.filter(F.coalesce("id", F.lit("")) != "").select("id"), "id", "left_anti")


def _delete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        gone = []
        for path in frame["path"]:
            where, at = fs.FileSystem.from_uri(path)
            there = where.get_file_info(at).type == fs.FileType.Directory
            if there:
                where.delete_dir(at)
            gone.append(there)
        yield pd.DataFrame({"id": frame["id"], "removed": gone})


def sweep(marks: DataFrame, articles: DataFrame, tasks: int = 64) -> DataFrame:
    """id, removed of the marked folders (id, path, a written table), removed in `tasks` tasks. An article that has come since the marking keeps its folder; a folder that a failed task removed already is no error."""
    return unused(marks, articles).select("id", "path").repartition(tasks, "id").mapInPandas(_delete, "id string, removed boolean")
