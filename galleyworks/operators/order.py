"""Row numbers and running sums over a whole table, without a window that has no partition."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyworks.shared import written

#: Bits of a monotonically increasing id that number the rows of a partition.
ROW_BITS = 33
#: Blocks of a dense number, at most; rows of a block, at least.
BLOCKS, BLOCK_ROWS = 1 << 14, 1 << 14


def numbered(df: DataFrame, *order: Column | str, name: str = "n", keep: list[str] | None = None, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """df (its columns `keep`, if given) with `name`, each row's place from 0 in `order`. Rows alike in all of `order` come in any order, but in the same one whenever the result is read.

    The rows are dealt by ranges of `order`, sorted within each and written; the counts of the ranges, one for each partition, are all that
    reaches the driver. A value that very many rows share is split if `order` goes on to columns in which they differ.
    """
    at, part, before, own = "_at", "_part", "_before", [F.col(f"`{c}`") for c in keep or df.columns]
    rows = write(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, F.monotonically_increasing_id().alias(at)), "numbered")
    counts = sorted(rows.groupBy(F.shiftright(at, ROW_BITS).alias(part)).count().collect())
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, accumulate((n for _, n in counts), initial=0))], f"{part} long, {before} long")
    rows = rows.withColumn(part, F.shiftright(at, ROW_BITS)).join(F.broadcast(offsets), part)
    return rows.select(*own, (F.col(before) + F.col(at).bitwiseAND((1 << ROW_BITS) - 1)).alias(name))


def block_rows(n: int) -> int:
    """Rows of a block so that n rows have BLOCKS blocks at most."""
    return max(BLOCK_ROWS, -(-n // BLOCKS))


def cumulated(df: DataFrame, n: str, sums: dict[str, str], rows: int) -> DataFrame:
    """df with running sums (column: new name) by its dense number `n`, the row's own included: within blocks of `rows`, and the sums of the blocks before. df is read twice."""
    block, taken = "_block", [f"_sum_{c}" for c in sums]
    named = df.withColumn(block, F.floor(F.col(n) / rows).cast("long"))
    totals = sorted(named.groupBy(block).agg(*[F.sum(c).alias(t) for c, t in zip(sums, taken)]).collect())
    before = zip(*[accumulate([r[k + 1] for r in totals], initial=0) for k in range(len(sums))])
    offsets = df.sparkSession.createDataFrame([(r[0], *b) for r, b in zip(totals, before)], ", ".join([f"{block} long", *[f"{t} long" for t in taken]]))
    within = Window.partitionBy(block).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    return named.join(F.broadcast(offsets), block).select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(t) + F.sum(c).over(within)).alias(new) for (c, new), t in zip(sums.items(), taken)])
