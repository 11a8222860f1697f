"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Each source gets a share of a word budget by its weight, never more than `most_repeats` times its
size; what a source cannot use is reshared by weight. A source's target is `whole` passes over all
its documents and a rest. For the rest, every document has a hash; the documents below a threshold
are taken once more. The threshold is found without sorting: words are summed by source and by the
top bits of the hash; running sums over these buckets leave one bucket per source in which the
threshold lies; only that bucket is split by the next bits, until the bits are used up. Thresholds
are nested: a larger target takes all that a smaller one took.

Documents are never cut, so a source's taken words are within half of the document at its threshold of the
target. Null texts have size 0; null sources are one source, last in order; documents of size 0 are
taken as their hash says and add no words; rows alike in doc_id and text are taken or left together. Reruns agree.
An empty table gives an empty mix; other columns pass through `mixed`, whatever their names. Sources are ranked by ranges and filled up by sums, so that
a source of its own for every document is no more than another table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyworks.llm.scratch import materialise, small_side
from galleyworks.llm.textkit import free_name

WEIGHTS = (3, 1, 2)
#: Words of the mix, as a multiple of all words.
BUDGET = 1.5
MOST_REPEATS = 2
#: Bits of the hash by which each refinement splits; their sum is the length of the hash.
LEVELS = (12, 16, 16)
#: Sources up to which their table is broadcast.
SMALL = 100_000


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space, tab, newline, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 over the id and the text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, sum(LEVELS) // 4), 16, 10).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with nth: the place (from 0) of each row's source by code point, null last; each range of sources counts its own."""
    spark = sizes.sparkSession
    rows = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "mix-ranks")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(F.broadcast(counts), "part").withColumn("nth", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with weight and target: sources whose share at the common level reaches their most are full, until none becomes so any more."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    df = ranked(sizes).withColumn("weight", w).withColumn("most", F.col("source_size") * float(MOST_REPEATS)).drop("nth")
    df = materialise(df, "mix-weights")
    budget = float(df.agg(F.sum("source_size")).first()[0] or 0) * BUDGET
    level, seen = -1.0, -1
    while True:
        # full sources stay full: the level only rises
        full = F.col("most") <= F.lit(level) * F.col("weight")
        n, used, rest = df.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not rest:
            return df.select("source", "source_size", "weight", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        level, seen = (budget - used) / rest, n


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole, threshold, of documents (source, size, hash) and targets: hash < threshold is taken once more."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0)
    bits = sum(LEVELS)
    for k, width in enumerate(LEVELS):
        bits -= width
        goals = materialise(goals.select("source", "source_size", "target", "whole", "left", "prefix", "open"), "mix-goals")
        edges = goals.filter("open").select(F.col("source").alias("of"), "prefix", "left")
        docs = sized.join(small_side(edges, SMALL), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", bits + width) == F.col("prefix")))
        hist = docs.groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^width buckets a source
        hist = hist.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("left"))
        edge = hist.groupBy("source").agg(
            F.min(F.when(F.col("over"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "words"))).alias("edge")
        )
        edge = edge.select(F.col("source").alias("of"), F.lit(True).alias("seen"), "edge.*")
        goals = goals.join(small_side(edge, SMALL), F.col("open") & F.col("source").eqNullSafe(F.col("of")), "left")
        inside = F.coalesce(F.col("open") & F.col("bucket").isNotNull(), F.lit(False))
        goals = goals.select(
            "source", "source_size", "target", "whole",
            F.when(inside, F.col("left") - F.col("below")).otherwise(F.col("left")).alias("left"),
            # without such a bucket all of this prefix is taken: the next prefix of that length is where it ends
            F.when(inside, F.col("bucket")).otherwise(F.when(F.col("open"), F.shiftleft(F.col("prefix") + 1, width)).otherwise(F.shiftleft("prefix", width))).cast("long").alias("prefix"),
            inside.alias("open"), F.when(inside, F.col("words")).alias("words"),
        )
    # the hash is used up: one document (or rows alike) is at the threshold; it is taken if that is nearer
    nearer = F.col("open") & (F.col("left") * 2 >= F.col("words"))
    return materialise(goals.select("source", "source_size", "target", "whole", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold")), "mix-thresholds")


def taken(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized with its source's size and target, and how often each document is taken."""
    found = thresholds(sized, goals).withColumnRenamed("source", "of")
    df = sized.join(small_side(found, SMALL), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return df.withColumn("repeats", F.least(F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(MOST_REPEATS))).drop("whole", "threshold")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, hash of every document, as a table in the shared folder."""
    text = F.col("text")
    return materialise(documents.select("doc_id", "source", size_of(text).alias("size"), hash_of(F.col("doc_id"), text).alias("hash")), "mix-sizes")


def source_targets(sized: DataFrame) -> DataFrame:
    return materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = measured(documents)
    df = taken(sized, source_targets(sized))
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    of, whole, threshold, copy = free_name(documents, "of", "whole", "threshold", "copy")
    goals = materialise(thresholds(sized := measured(documents), source_targets(sized)), "mix-final").select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("threshold").alias(threshold))
    df = documents.join(small_side(goals, SMALL), F.col("source").eqNullSafe(F.col(of)))
    times = F.least(F.col(whole) + (hash_of(F.col("doc_id"), F.col("text")) < F.col(threshold)).cast("long"), F.lit(MOST_REPEATS)).cast("int")
    return df.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in documents.columns])
