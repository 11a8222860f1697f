"""Visit counters, result cache and link watcher as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from galleyworks.shared import new_path

#: How long a visitor's mark and a cached result live.
MARK_LIFE, RESULT_LIFE = "3 days", 3600


def first_visits(visits: DataFrame) -> DataFrame:
    """The first row of each (day, visitor) of a stream with ts; marks go after MARK_LIFE, as no later row bears their day."""
    return visits.withWatermark("ts", MARK_LIFE).dropDuplicatesWithinWatermark(["day", "visitor"])


def page_counts(visits: DataFrame) -> DataFrame:
    """Running pv of every page and article_id; the state grows with the articles, not with the visits."""
    return visits.groupBy("page", "article_id").agg(F.count("*").alias("pv"))


NEVER = np.iinfo(np.int64).max


def _first_requests(frame: pd.DataFrame) -> np.ndarray:
    """A row for each second, ascending: second, least request that may be served from the cache, least one that may not (NEVER for none)."""
    second, request, debug = (frame[c].to_numpy() for c in ("second", "request", "debug"))
    return _merged(np.stack([second, np.where(debug, NEVER, request), np.where(debug, request, NEVER)], axis=1))


def _merged(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    return np.concatenate([rows[start, :1], np.minimum.reduceat(rows[:, 1:], start)], axis=1)


def looked_up(rows: np.ndarray, since: int | None) -> tuple[list[tuple[int, int]], int | None]:
    """(second, request) of those that find no result, and since when the last result lives. rows: see _first_requests.

    Requests of a second come in their order: one that may not be served from the cache renews the result for those after it.
    """
    out, i, renews = [], 0, np.flatnonzero(rows[:, 2] != NEVER)
    while i < len(rows):
        if since is not None and rows[i, 0] - since < RESULT_LIFE:
            # the next second in which the result is too old, or renewed
            later = int(np.searchsorted(rows[:, 0], since + RESULT_LIFE))
            k = int(np.searchsorted(renews, i))
            renewed = int(renews[k]) if k < len(renews) else len(rows)
            if renewed >= later:
                i = max(later, i)
                continue
            i = renewed
        elif rows[i, 1] < rows[i, 2]:
            out.append((int(rows[i, 0]), int(rows[i, 1])))
        since = max(int(rows[i, 0]), since) if since is not None else int(rows[i, 0])
        i += 1
    return out, since


class ResultCache(StatefulProcessor):
    """When the result of a key was written last; the state goes when the result is too old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.since = handle, handle.getValueState("since", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = lambda pairs: pd.DataFrame({"ip": key[0], "request": [r for _, r in pairs], "second": [s for s, _ in pairs]}).astype({"ip": object, "request": "int64", "second": "int64"})
        held = np.zeros((0, 3), np.int64)
        for frame in rows:
            anew = frame[frame["debug"]]
            if len(anew):
                yield told(list(zip(anew["second"], anew["request"])))
            held = _merged(np.concatenate([held, _first_requests(frame)]))
        before = self.since.get()[0] if self.since.exists() else None
        missed, since = looked_up(held, before)
        if since != before:
            self.since.update((since,))
            # a result of the past goes at the next batch
            self.handle.registerTimer(max((since + RESULT_LIFE) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        if missed:
            yield told(missed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.since.exists() and (self.since.get()[0] + RESULT_LIFE) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_lookups(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """ip, request, second of those requests of a stream (ip, request, ts, debug) that find no result less than RESULT_LIFE seconds old, and so are looked up anew; all others are served from the cache.

    Only what was looked up anew is written, so hits prolong nothing; debug skips the reading but not the writing. The rows of a key and micro-batch are folded in
    order of time, equal seconds by request; of them a task holds three numbers for each second in which there are any, however many requests come in it.
    The state, one number a key, is in RocksDB, which the session is set to; rows later than `late` are dropped.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.withWatermark("ts", late).select("ip", F.col("request").cast("long").alias("request"), F.unix_seconds("ts").alias("second"), F.coalesce("debug", F.lit(False)).alias("debug"), "ts")
    return rows.groupBy("ip").transformWithStateInPandas(ResultCache(), "ip string, request long, second long", "Append", "EventTime")


def seen_links(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("url string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "url string")


def submit_new(links: DataFrame, seen: str, submit: Callable[[DataFrame], DataFrame]) -> int:
    """Submit the links that the table `seen` lacks, then add them to it; how many were submitted.

    They are noted only after all went out: after a failure they go out again (at least once).
    """
    spark = links.sparkSession
    new = links.select("url").distinct().join(seen_links(spark, seen), "url", "left_anti")
    sent = submit(new).agg(F.sum("n")).first()[0] or 0
    if sent:
        new.withColumn("added_at", F.current_timestamp()).write.mode("append").parquet(seen)
    spark.range(1).select(F.current_timestamp().alias("last_checked_at"), F.lit(sent).cast("long").alias("last_submitted_count")).write.mode("append").parquet(f"{seen.rstrip('/')}-checks")
    return sent


def seen_in_order(spark: SparkSession, path: str) -> DataFrame:
    """url of the links seen, the newest additions first."""
    if seen_links(spark, path).isEmpty():
        return seen_links(spark, path)
    return spark.read.schema("url string, added_at timestamp").parquet(path).orderBy(F.col("added_at").desc_nulls_last(), "url").select("url")


def last_check(spark: SparkSession, seen: str) -> DataFrame:
    """last_checked_at, last_submitted_count of the newest check of the watcher."""
    return spark.read.parquet(f"{seen.rstrip('/')}-checks").orderBy(F.col("last_checked_at").desc()).limit(1)


def watch(links: DataFrame, seen: str, submit: Callable[[DataFrame], DataFrame], checkpoint: str, interval: int | None = None):
    """A running query over a stream of url: every `interval` seconds (at least 60) or, without one, once over what is there."""
    writer = links.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: submit_new(batch, seen, submit))
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{max(60, interval)} seconds")).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream makes of all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
