"""SimHash near-duplicates: fingerprints of shingles, linked within RADIUS bits by bit-sliced comparison.

1. A text's words are runs of other characters than ASCII white space, its letters A-Z made small; each run of SHINGLE words, joined by
   single spaces, is hashed (XXH64 of UTF-8, seed 42), repeats included; fewer words are one shingle of all. A bit of the
   fingerprint is set if over half of the hashes have it. Null, empty and wordless texts have the fingerprint zero.
2. Equal fingerprints are one row from here on. Two fingerprints within RADIUS bits agree on one of RADIUS + 1 parts of the bits at least: a row goes to
   a bucket for each part. A bucket of more than BUCKET fingerprints is dealt anew by parts of the bits that its members need not share.
   Fingerprints differ, so a bucket whose members share all but log2(BUCKET) bits is never larger than BUCKET: four rounds do, whatever the data.
3. Members of many buckets are laid out in lanes, 64 a machine word, each bucket from a word on, and their bits are stored vertically: a plane for each of the 64 bits. For a
   member and a word of its bucket, a plane's difference is added to 64 distances at once by carry-save counters of few bits; a word whose 64 distances
   are all over RADIUS is abandoned. Planes come in the order of how evenly they divide. Of the links of a bucket those come out that join its members to their classes.
4. Links make classes by label propagation with pointer jumping; a class is named by its smallest doc_id, or null if it has none.

Rows and doc_ids may repeat or be null: each row has its result; ties have no influence; texts of any length are read in pieces of PIECE bytes; an empty table gives an empty result; other columns are not read,
and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyworks.llm.neardup import components
from galleyworks.llm.scratch import Tables
from galleyworks.llm.textkit import U, chunks, flat

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a bucket; members and words of members that are compared at once; bytes of a text that are split at once.
BUCKET, MEMBERS, CELLS, PIECE = 1 << 13, 1 << 15, 1 << 17, 1 << 20
BITS, ALL = 64, U(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes at once; each piece but the first begins with the last SHINGLE - 1 words before it."""
    a, kept = 0, []
    while a < len(text):
        cut = _SPACE.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = cut.start() if cut else len(text)
        words = kept + text[a:b].lower().split()
        yield words
        a, kept = b, words[-(SHINGLE - 1) :]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    ones, n, few = np.zeros(BITS, np.int64), 0, []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for words in _pieces(text):
        if len(words) < SHINGLE:
            few = words
            continue
        h = np.fromiter((digest(join(w), SEED) for w in zip(*(words[k:] for k in range(SHINGLE)))), U)
        n += len(h)
        h = np.pad(h, (0, -len(h) % 255))  # sums of 255 bits fit a byte
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 255, BITS)
        ones += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    if n == 0:
        return digest(join(few), SEED) if few else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def _fingerprints(column: pa.Array) -> pa.Array:
    out = []
    for a, b, part in chunks(column):
        data, offsets = flat(part)
        out += [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(b - a)]
    return pa.array(np.array(out, U).view(np.int64), pa.int64())


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as a signed long) of each document."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.arrow_udf(_fingerprints, "long")("text").alias("fingerprint"))


def near_pairs(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of values within `radius` bits of each other and in one bucket; rows of a bucket stand together."""
    none = np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else none
    size = np.diff(np.append(start, len(bucket)))
    several = np.repeat(size > 1, size)
    if not several.any():
        return none, none
    at, values, size = np.flatnonzero(several), values[several], size[size > 1]
    words = -(-size // BITS)
    first = np.cumsum(words) - words
    nth = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    lane = np.repeat(first, size) * BITS + nth
    member = np.full(words.sum() * BITS, -1)
    member[lane] = np.arange(len(values))
    laid = np.zeros(len(member), U)
    laid[lane] = values
    planes = np.packbits(np.ascontiguousarray(np.unpackbits(laid.view(np.uint8), bitorder="little").reshape(-1, BITS).T), axis=1, bitorder="little").copy(order="C").view(U)
    vacant = np.packbits(member < 0, bitorder="little").view(U)
    of_bit = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, BITS).mean(0)
    order = np.argsort(np.abs(of_bit - 0.5), kind="stable")
    own, end = lane // BITS, np.repeat(first + words, size)
    upto = np.cumsum(end - own)  # cells: a member with each word of its bucket from its own on
    lefts, rights, a = [], [], 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, "right")))
        n = end[a:b] - own[a:b]
        q = np.repeat(np.arange(a, b), n)
        w = own[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        # lanes up to the member's own have their turn when theirs are the members
        over = vacant[w] | np.where(w == own[q], ALL >> (U(63) - (lane[q] % BITS).astype(U)), U(0))
        counters = [np.zeros(len(q), U) for _ in range((radius + 1).bit_length())]
        for k, plane in enumerate(order):
            carry = planes[plane][w] ^ (U(0) - ((values[q] >> U(plane)) & U(1)))
            hit = ALL
            for c, counter in enumerate(counters):
                counters[c], carry = counter ^ carry, counter & carry
                hit = hit & (counters[c] if (radius + 1) >> c & 1 else ~counters[c])
            over |= hit
            if k % 4 == 3:
                live = over != ALL
                if not live.all():
                    q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
                if not len(q):
                    break
        cell, bit = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, BITS))
        lefts.append(q[cell])
        rights.append(member[w[cell] * BITS + bit])
        a = b
    return at[np.concatenate(lefts)], at[np.concatenate(rights)]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least one that it is linked to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, fingerprint) come sorted by bucket; a bucket may go on in the next batch."""

    def found(path, key, value):
        new = np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])]) if len(path) else np.zeros(0, bool)
        a, b = near_pairs(value, np.cumsum(new))
        label = _joined(len(value), a, b)
        linked = np.flatnonzero(label != np.arange(len(value)))
        ends = (value[linked].view(np.int64), value[label[linked]].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)]
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
        held = [np.concatenate([h, x.view(U) if k == 2 else x]) for k, (h, x) in enumerate(zip(held, new))]
        if len(held[0]) >= MEMBERS:
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield found(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield found(*held)


def _parts(bits: list[int]) -> list[list[int]]:
    """RADIUS + 1 parts of bits, of about one length."""
    n = RADIUS + 1
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(values: DataFrame, tables: Tables) -> DataFrame:
    """a, b: links between the distinct fingerprints of `values` (fingerprint) that make the classes of all links within RADIUS bits."""
    spark = values.sparkSession
    free = {0: list(range(BITS))}  # bits that members of a bucket need not share, by the path that led to it
    rows, ready = values.select(F.lit(0).cast("long").alias("path"), "fingerprint"), None
    while True:
        ways, below = [], {}
        for path, bits in free.items():
            for k, part in enumerate(_parts(bits)):
                child = path * (RADIUS + 1) + k + 1
                below[child] = [b for b in bits if b not in part]
                ways.append((path, child, _signed([b for b in range(BITS) if b not in below[child]])))
        ways = F.broadcast(spark.createDataFrame(ways, "path long, child long, mask long"))
        rows = rows.join(ways, "path").select(F.col("child").alias("path"), F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint")
        free = below
        if 1 << max(map(len, free.values())) <= BUCKET:
            ready = rows if ready is None else ready.unionByName(rows)
            break
        hot = tables.write(rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("path", "key"), "simhash-hot")
        if hot.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        fit = rows.join(hot, ["path", "key"], "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        rows = tables.write(rows.join(hot, ["path", "key"], "left_semi"), "simhash-refined").select("path", "fingerprint").distinct()
    # rows of larger buckets were dealt out above: no bucket here has more than BUCKET
    ready = ready.repartition("path", "key").sortWithinPartitions("path", "key", "fingerprint")
    return tables.write(ready.mapInArrow(_links, "a long, b long").distinct(), "simhash-links")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links lead to, its own included; a row per document."""
    tables = Tables(documents.sparkSession)
    docs = tables.write(fingerprints(documents), "simhash-documents")
    one = tables.write(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-values")
    labels = components(links(one.select("fingerprint"), tables), tables)
    of = one.join(labels.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    # only the classes of several fingerprints are gathered
    several = tables.write(labels.join(one, labels["id"] == one["fingerprint"]).groupBy("label").agg(F.min("least").alias("of_class")), "simhash-least")
    of = tables.write(of.join(several, "label", "left").select("fingerprint", F.coalesce("of_class", "least").alias("component_id")), "simhash-classes")
    tables.drop(*[t for t, _ in list(tables.paths.values()) if t is not docs and t is not of])
    return docs.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
