"""Document fingerprints by locally consistent parsing.

A text is a row of code points, each of which names itself. A level turns a row of names into a
shorter one: maximal runs of one name become one name; deterministic coin tossing (the lowest bit
in which a name differs from its left neighbour, three times over) turns names into a few labels
that differ between neighbours; local maxima of the labels, and local minima away from them, begin
phrases; a phrase is named by hashing its parts in order. Where phrases begin depends on a few
names around, so equal substrings have equal phrases inside, wherever they stand in a text.

The fingerprint holds, for each of three levels, the lowest hashes of the phrase names (a bottom-k
sketch); two fingerprints are compared on the highest level on which both have enough phrases, by
the share of common names among the lowest of their union.

All functions work on many texts at once, laid end to end, and never across their bounds.

Null texts are empty, and empty texts have an empty fingerprint; equal texts have equal ones. Null doc_ids come before all others; rows of one doc_id are in
order of a hash of their text, then of the text; rows alike follow each other. A doc_id of very many rows (as null may be) is dealt by that hash, and rows
alike among them are counted, so that it is no group of one task. One row follows itself; an empty table gives an empty result; other columns are not
read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.llm.scratch import materialise
from galleyworks.llm.textkit import U, mix

#: Levels of phrases (about 2.5, 16 and 40 code points), names kept of each, names that make a level comparable.
LEVELS, KEPT, ENOUGH = (1, 3, 4), 48, 12
CHUNK = 1 << 19  # code points that are parsed at once
LEAST = -(1 << 63)


def coin(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the index of the lowest bit in which x differs from its left neighbour, plus that bit of x."""
    d = x ^ left
    low = d & (~d + U(1))
    return U(2) * np.bitwise_count(low - U(1)).astype(U) + ((x & low) != 0).astype(U)


def level(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each row of names, and the row of each."""
    n = len(names)
    if not n:
        return names, row
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(row[1:], row[:-1], out=head[1:])
    begin = head.copy()
    begin[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begin)
    if len(at) < n:  # runs
        run = np.diff(np.append(at, n))
        names, row, head = names[at], row[at], head[at]
        names = np.where(run > 1, mix(names + U(0x51ED27) * run.astype(U)), names)
        n = len(names)
    label = names
    for _ in range(3):
        left = np.empty_like(label)
        left[0], left[1:] = 0, label[:-1]
        left[head] = ~label[head]
        label = coin(label, left)
    left, right = np.empty_like(label), np.empty_like(label)
    left[0], left[1:] = 0, label[:-1]
    right[-1], right[:-1] = 0, label[1:]
    edge = head | np.append(head[1:], True)
    top = (label > left) & (label > right) & ~edge
    low = (label < left) & (label < right) & ~edge
    near = top.copy()
    near[1:] |= top[:-1]
    near[:-1] |= top[1:]
    at = np.flatnonzero(head | top | (low & ~near))
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    return mix(np.add.reduceat(mix(names + place.astype(U) * U(0x9E3779B97F4A7C15)), at) + size.astype(U)), row[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text len(LEVELS) x KEPT hashes of 32 bits, ascending, padded with the highest value."""
    out = np.full((len(texts), len(LEVELS), KEPT), 0xFFFFFFFF, np.uint32)
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        names = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        row = np.repeat(np.arange(b - a), [len(t) for t in texts[a:b]])
        with np.errstate(over="ignore"):
            for k in range(1, max(LEVELS) + 1):
                names, row = level(names, row)
                if k in LEVELS and len(names):
                    key = np.unique((row.astype(U) << U(32)) | (mix(names) >> U(32)))
                    own, h = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.uint32)
                    nth = np.arange(len(own)) - np.searchsorted(own, own)
                    keep = nth < KEPT
                    out[a + own[keep], LEVELS.index(k), nth[keep]] = h[keep]
        a = b
    return list(out)


def to_text(sketch: np.ndarray) -> str:
    """Hex of the kept hashes, level by level, between dots; empty for an empty text."""
    parts = [x[x != 0xFFFFFFFF].astype(">u4").tobytes().hex() for x in sketch]
    return ".".join(parts) if any(parts) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrases on the highest comparable level; two empty texts are alike, one alone is not."""
    for k in range(len(LEVELS) - 1, -1, -1):
        x, y = a[k][a[k] != 0xFFFFFFFF], b[k][b[k] != 0xFFFFFFFF]
        if k == 0 or min(len(x), len(y)) >= ENOUGH:
            if not len(x) or not len(y):
                return float(len(x) == len(y))
            both = np.union1d(x, y)[:KEPT]
            return float((np.isin(both, x) & np.isin(both, y)).mean())
    return 0.0


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by a coarse and then a fine search."""
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    coarse = F.array(*[F.lit(b) for b in bounds[::step]]).cast("array<bigint>")
    block = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return (block + F.size(F.filter(F.slice(fine, block + 1, step), lambda b: b <= key))).cast("int")


#: Parts of one doc_id at most.
PARTS = 1 << 20


def with_next(documents: DataFrame, per_partition: int = 8) -> DataFrame:
    """documents as (key, hash, text, doc_id, n, bucket, guest), dealt and sorted so that a row's successor in order of doc_id follows it; n rows are alike.

    Ids are cut at their quantiles into buckets, and an id of more rows than a bucket should have into parts by the hash of the text. Each bucket also gets, as a guest, the first row of the
    next one (the last bucket gets the first of all). One shuffle of the text, and no global sort.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("n"))
    ids = rows.select("key", "hash")
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, cuts = ids.agg(F.count("*"), F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()
    share = max(total // n, 1)
    # ids above twice a bucket's share: n / 2 at most
    hot = {k: min(-(-c // share), PARTS) for k, c in ids.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > max(2 * share, 64)).collect()}
    bounds = sorted(set(cuts or []) | set(hot) | {k + 1 for k in hot if k < (1 << 63) - 1}) or [LEAST]
    bucket = _bucket(F.col("key"), bounds).cast("bigint") * PARTS
    if hot:
        parts = spark.createDataFrame(list(hot.items()), "hot bigint, parts bigint")
        split = lambda df: df.join(F.broadcast(parts), F.col("key") == F.col("hot"), "left")
        # the upper 31 bits of the hash, in the order of the hash, dealt evenly
        place = F.coalesce(F.floor((F.shiftright("hash", 33) + (1 << 30)) * F.col("parts") / (1 << 31)), F.lit(0)).cast("bigint")
        own = lambda df: split(df).withColumn("bucket", bucket + place)
        whole = split(rows)
        alike = whole.filter("parts IS NOT NULL").groupBy("key", "hash", "doc_id").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
        rows = whole.filter("parts IS NULL").select("key", "hash", "text", "doc_id", "n").unionByName(alike)
    else:
        own = lambda df: df.withColumn("bucket", bucket)
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in own(ids).groupBy("bucket").agg(F.min(F.struct("key", "hash"))).collect())  # a row a bucket
    hosts = spark.createDataFrame([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)] or [(LEAST, 0, 0)], "key bigint, hash bigint, bucket bigint")
    guests = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    guests = guests.join(F.broadcast(hosts.select("key", "hash").distinct()), ["key", "hash"]).groupBy("key", "hash").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    guests = materialise(guests, "fingerprint-guests").join(F.broadcast(hosts), ["key", "hash"])
    both = own(rows).select("key", "hash", "text", "doc_id", "n", "bucket", F.lit(False).alias("guest")).unionByName(guests.select("key", "hash", "text", "doc_id", F.lit(1).cast("bigint").alias("n"), "bucket", F.lit(True).alias("guest")))
    return both.repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "hash", "text")


#: Rows of a batch of results, at most.
ROWS = 8192


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    def finished(docs: list[tuple[int | None, str]], follow: list[str], times: list[int]) -> Iterator[pa.RecordBatch]:
        edited = []
        for (_, t), nxt in zip(docs, follow, strict=True):
            k = min(len(t) // 2, len(nxt)) if t else 0
            edited.append(t[: len(t) - len(t) // 2] + nxt[:k])
        made = sketches([t for _, t in docs] + edited + follow[-1:])
        n = len(docs)
        own, changed, last = made[:n], made[n : 2 * n], made[2 * n :]
        # where the successor is the next one of docs, its sketch is there already
        after = [own[i + 1] if i + 1 < n and follow[i] is docs[i + 1][1] else None for i in range(n)]
        lone = [i for i in range(n) if after[i] is None and i < n - 1]
        for i, s in zip(lone, sketches([follow[i] for i in lone]), strict=True):
            after[i] = s
        if n:
            after[n - 1] = last[0]
        batch = pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([d for d, _ in docs], pa.int64()), "n_chars": pa.array([len(t) for _, t in docs], pa.int64()),
                "edited_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [to_text(s) for s in own], "edited_fingerprint": [to_text(s) for s in changed],
                "near_edited": pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()), "near_next": pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
            }
        )
        if max(times) == 1:
            yield batch
            return
        for i, many in enumerate(times):
            while many:
                part = min(many, ROWS)
                yield batch.take(pa.array([i] * part))
                many -= part

    docs: list[tuple[int | None, str]] = []
    follow: list[str] = []
    times: list[int] = []
    held, size = None, 0  # held: a row that waits for its successor
    closed = None  # a bucket whose guest came
    for batch in batches:
        for doc_id, text, n, bucket, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "n", "bucket", "guest")), strict=True):
            if guest and closed == bucket:
                continue
            if held is not None:
                docs.append(held)
                follow.append(text)
                times.append(1)
                size += len(held[1])
            held, closed = (None, bucket) if guest else ((doc_id, text), None)
            if n > 1:  # rows alike: all but the last are followed by the next of them
                docs.append(held)
                follow.append(text)
                times.append(n - 1)
                size += len(text)
            if size >= CHUNK:
                yield from finished(docs, follow, times)
                docs, follow, times, size = [], [], [], 0
    if docs:
        yield from finished(docs, follow, times)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint, and that of its text with the latter half taken from the next document."""
    return with_next(documents).mapInArrow(_digests, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """df and the fingerprint of each whole text; nulls count as empty."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([to_text(s) for s in sketches([t or "" for t in column.to_pylist()])], pa.string())

    return df.withColumn(name, of(F.col(text)))
