"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a folder of this run on a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables that this process made and did not remove.
made: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    made.append(f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}")
    return made[-1]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of `made`. What was made of them must be written itself: a lost executor's work is done again from it."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in made:
            made.remove(p)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, its size is known to the planner."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one operator. `drop` removes those that nothing lazy reads any more: what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = table_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, [path])


def small_side(df: DataFrame, most: int, row_bytes: int = 1024) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows of `row_bytes` bytes each, and together fits BROADCAST_BYTES; as it is otherwise (a shuffle join, split by AQE where skewed).

    df must be cheap to count, as a materialised table is.
    """
    most = min(most, BROADCAST_BYTES // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of a broadcast side, at most.
BROADCAST_BYTES = 128 << 20
