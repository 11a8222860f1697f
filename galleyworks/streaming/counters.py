"""The site's counters, kept over the batches of a stream."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyworks.operators import archive as A
from galleyworks.shared import written
from galleyworks.sources.versions import Conflict, Versions

#: Fixed value: days that a visitor's mark lives.
MARK_DAYS = 3


class VisitCounters(Versions):
    """Counters (kind: site, day or article; key; n) and visitors' marks (day, visitor) after the batches that were applied, as versions.

    The counters after each hit are running sums of its batch, over all tasks, upon the counters before the batch: neither the site nor an article is one task. Hits count in the order of their time
    within a batch, and in the order of batches. A batch is applied once: applied again, it returns what it returned. Of marks
    those of the newest MARK_DAYS days are kept; after MOST_MARKS batches the next one joins them.
    """

    COUNTERS, MARKS = "kind string, key string, n long", "day string, visitor string"
    MOST_MARKS = 64

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def counters(self) -> DataFrame:
        now = self.manifest(self.version())
        return self._read([now["counters"]] if now else [], self.COUNTERS)

    def apply(self, hits: DataFrame, stream: str, number: int, attempts: int = 3) -> DataFrame:
        """hits (event_id, ts, day, visitor, page, article_id, counted) with site_pv, site_uv and article_pv after each, as A.snapshots has them of all batches at once."""
        hits = written(hits.select("event_id", "ts", F.col("day").cast("string").alias("day"), F.col("visitor").cast("string").alias("visitor"), "page", F.col("article_id").cast("string").alias("article_id"), "counted"), "hits")
        for _ in range(attempts):
            version = self.version()
            now = self.manifest(version)
            done = now.get("batches", {}).get(stream)
            if done and done["number"] >= number:
                if done["number"] > number:
                    raise ValueError(f"batch {done['number']} of {stream} was applied before batch {number}")
                return self.spark.read.parquet(f"{self.path}/{done['out']}")
            folder = self.new_folder()
            counters, marks = self._read([now["counters"]] if now else [], self.COUNTERS), self._read(list(now.get("marks", {})), self.MARKS)
            before = lambda kind, key, n: counters.filter(F.col("kind") == kind).select(F.col("key").alias(key), F.col("n").alias(n))
            site = (counters.filter("kind = 'site'").first() or {"n": 0})["n"]
            after = A.snapshots(hits, marks).join(before("day", "_day", "_uv"), F.col("day").eqNullSafe(F.col("_day")), "left").join(before("article", "_id", "_pv"), F.col("article_id").eqNullSafe(F.col("_id")), "left")
            more = lambda c, base: (F.col(c) + F.coalesce(base, F.lit(0))).alias(c)
            after.select(*hits.columns, more("site_pv", F.lit(site)), more("site_uv", "_uv"), more("article_pv", "_pv")).write.parquet(f"{self.path}/{folder}/out")

            counted = hits.filter("counted")
            new = counted.select("day", "visitor").distinct().join(marks, ["day", "visitor"], "left_anti")
            newest = max([d for d in [*now.get("marks", {}).values(), hits.agg(F.max("day")).first()[0]] if d], default="")
            oldest = str(date.fromisoformat(newest) - timedelta(MARK_DAYS - 1)) if newest else ""
            joined = len(now.get("marks", {})) >= self.MOST_MARKS
            (marks.unionByName(new).filter(F.col("day") >= oldest) if joined else new).write.parquet(f"{self.path}/{folder}/marks")
            kept = {} if joined else {f: d for f, d in now.get("marks", {}).items() if d >= oldest}
            one = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), key.cast("string").alias("key")).agg(F.count("*").alias("n"))
            sums = one(counted, "site", F.lit("")).unionByName(one(new, "day", F.col("day"))).unionByName(one(counted.filter("page = 'article'"), "article", F.col("article_id")))
            counters.unionByName(sums).groupBy("kind", "key").agg(F.sum("n").alias("n")).write.parquet(f"{self.path}/{folder}/counters")
            told = {
                "folders": dict.fromkeys([folder, *[f.rpartition("/")[0] for f in kept], *[b["out"].rpartition("/")[0] for b in now.get("batches", {}).values()]], 0), "counters": f"{folder}/counters",
                "marks": kept | {f"{folder}/marks": newest}, "batches": now.get("batches", {}) | {stream: {"number": number, "out": f"{folder}/out"}},
            }
            if self.commit(version + 1, told):
                return self.spark.read.parquet(f"{self.path}/{folder}/out")
            self.remove(folder)
        raise Conflict(f"{self.path}: {attempts} attempts, each time another writer was first")
