"""The article cache in parts by url, of which a build rewrites those alone whose rows changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.shared import written
from galleyworks.sources.versions import Conflict, Versions


class ArticleCache(Versions):
    """Articles (columns of `schema`, with url and ord, the place in the archive's order) in PARTS parts by a hash of the url. A manifest has the folder of each part; a version appears whole."""

    PARTS = 256

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(spark, path)
        self.schema = schema

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The articles of a version, the newest if none is given, in the archive's order by `ord`."""
        return self._of(list(self.manifest(self.version() if version is None else version).get("parts", {}).values()))

    def update(self, articles: DataFrame, attempts: int = 3) -> list[int]:
        """Put articles in, each for the one of its url, the last by ord of equal urls; null urls go. The parts that were rewritten: those without a change keep their files."""
        old_schema = self._of([])
        given = articles.filter("url IS NOT NULL").select(*[F.col(c).cast(t).alias(c) for c, t in old_schema.dtypes])
        rest = [c for c in given.columns if c != "url"]
        given = given.groupBy("url").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("url", "r.*").withColumn("part", F.pmod(F.xxhash64("url"), F.lit(self.PARTS)).cast("int"))
        given = written(given, "articles")
        for _ in range(attempts):
            version = self.version()
            parts = {int(k): f for k, f in self.manifest(version).get("parts", {}).items()}
            had = self._of([parts[k] for k in sorted({r.part for r in given.select("part").distinct().collect()} & set(parts))])
            same = reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in rest])
            changed = written(given.alias("n").join(had.alias("o"), (F.col("n.url") == F.col("o.url")) & same, "left_anti"), "changed")
            touched = sorted(r.part for r in changed.select("part").distinct().collect())
            if not touched:
                return []
            stay = self._of([parts[k] for k in touched if k in parts]).join(changed.select("url"), "url", "left_anti")
            folder = self.new_folder()
            whole = stay.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(self.PARTS)).cast("int")).select(*changed.columns).unionByName(changed)
            whole.repartition("part").sortWithinPartitions("part", "ord").write.partitionBy("part").parquet(f"{self.path}/{folder}")
            parts |= {k: f"{folder}/part={k}" for k in touched}
            if self.commit(version + 1, {"parts": parts, "folders": dict.fromkeys((f.rpartition("/")[0] for f in parts.values()), 0)}):
                return touched
            self.remove(folder)
        raise Conflict(f"{self.path}: {attempts} attempts, each time another writer was first")
