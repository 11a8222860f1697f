"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by hash into shards of a bounded number of rows; a shard packs its documents,
largest first. Open bins stand in order of their residual capacity and carry a bitmap of the sources and one of the
duplicate clusters inside. A document goes into the tightest bin that has room and neither its
source nor its cluster: the search begins at its size and goes on to each successor until a
compatible bin is found, else a bin is opened. A document above the capacity is cut: its full pieces get bins
of their own, what is left is packed like a document. No word is dropped.

Sizes are words. `pack` gives the places of pieces, `packed_texts` also their text: the pieces of a document, one after
another, are its text with all its white space. Null and empty texts have size 0 and go into the tightest compatible bin. Null sources
are one source. Rows alike in all columns are packed each for itself (and, as one cluster, apart), over all shards if there are many.
An empty table has no pieces. Only ids, sizes and keys reach Python; other columns are not read, and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.llm.mixing import size_of
from galleyworks.llm.scratch import materialise, small_side

CAPACITY = 2048
#: Rows of a shard, about.
SHARD_ROWS = 2048
SCHEMA = "doc_id long, piece int, start long, n_words long, source string, cluster string, bin_id string, bin_start long, h1 long, h2 long, last boolean"
COLUMNS = ("doc_id", "piece", "start", "n_words", "source", "cluster", "bin_id", "bin_start")


class Bins:
    """Open bins in order of residual capacity, each with bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words that were in it before) for a piece; source and cluster are bits, 0 for none."""
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            residual, b = self.order[i]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[i]
                break
            i += 1
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if residual - size > 0:
            insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def pack_rows(sizes, sources, clusters, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, words, bin, place in the bin) of each piece of each row; rows come largest first."""
    bits: dict = {}
    bit = lambda kind, value: 1 << bits.setdefault(kind, {}).setdefault(value, len(bits[kind]))
    bits.update(source={}, cluster={})
    bins, out, pieces = Bins(capacity), [], []
    for row, size in enumerate(sizes):
        full = max(size - 1, 0) // capacity
        for k in range(full):
            b = len(bins.sources)
            bins.sources.append(0)
            bins.clusters.append(0)
            out.append((row, k, k * capacity, capacity, b, 0))
        pieces.append((size - full * capacity, row, full))
    for words, row, k in sorted(pieces, key=lambda p: (-p[0], p[1])):
        b, at = bins.place(words, bit("source", sources[row]), bit("cluster", clusters[row]))
        out.append((row, k, k * capacity, words, b, at))
    return out


def _packer(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], na_position="first").reset_index(drop=True)
        none = shard["source"].isna()
        sources, sizes = shard["source"].where(~none, None).tolist(), shard["size"].tolist()
        made = pack_rows(sizes, sources, shard["cluster"].tolist(), capacity)
        rows = [m[0] for m in made]
        of = int(shard["shard"].iloc[0]) if len(shard) else 0
        return pd.DataFrame(
            {
                "doc_id": shard["doc_id"].iloc[rows].astype("Int64").array, "piece": [m[1] for m in made], "start": [m[2] for m in made], "n_words": [m[3] for m in made],
                "source": [sources[r] for r in rows], "cluster": shard["cluster"].iloc[rows].array, "bin_id": [f"{of}-{m[4]}" for m in made], "bin_start": [m[5] for m in made],
                "h1": shard["h1"].iloc[rows].array, "h2": shard["h2"].iloc[rows].array, "last": [m[2] + m[3] == sizes[m[0]] for m in made],
            }
        )

    return pack


def text_cluster(text: Column) -> Column:
    """The cluster of exact copies up to case and white space; texts without words are copies of each other."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return F.md5(words)


def _pieces(documents: DataFrame, cluster: Column | None, capacity: int, shard_rows: int) -> DataFrame:
    """The pieces, with two hashes of their document's text and whether they are the last of it."""
    text = F.coalesce("text", F.lit(""))
    df = documents.select("doc_id", "source", size_of(text).alias("size"), (text_cluster(text) if cluster is None else cluster.cast("string")).alias("cluster"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    df = materialise(df.withColumn("tie", F.xxhash64("doc_id", "h1", "cluster", "source")).withColumn("nth", F.monotonically_increasing_id()), "packing-rows")
    shards = max(1, -(-df.count() // shard_rows))
    # rows alike beyond a small share of a shard are dealt by their place as well; they are the same, so it does not matter which goes where
    alike = materialise(df.groupBy("tie").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, shard_rows // 32)).select("tie", F.lit(True).alias("alike")), "packing-alike")
    dealt = F.col("tie")
    if not alike.isEmpty():
        df = df.join(small_side(alike, 1 << 20, 32), "tie", "left")
        dealt = F.when(F.col("alike"), F.xxhash64("tie", "nth")).otherwise(dealt)
    df = df.select("doc_id", "source", "size", "cluster", "tie", "h1", "h2", F.pmod(dealt, F.lit(shards)).cast("int").alias("shard"))
    return df.groupBy("shard").applyInPandas(_packer(capacity), SCHEMA)


def pack(documents: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, n_words (of the document), source, cluster, bin_id, bin_start (words before it in its bin)."""
    return _pieces(documents, cluster, capacity, shard_rows).select(*COLUMNS)


def packed_texts(documents: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """As pack, with the text of each piece. Texts meet their pieces by hash, each distinct text once; rows alike need not be told apart for that."""
    found = _pieces(documents, cluster, capacity, shard_rows)
    text = F.coalesce("text", F.lit(""))
    texts = documents.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    # each text is cut once: a word with the white space before it; what follows the last word belongs to the last piece
    whole = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / capacity) - 1), lambda p: F.array_join(F.slice(w, (p * capacity + 1).cast("int"), F.lit(capacity)), ""))
    pieces = F.when(size_of(F.col("text")) <= capacity, F.array("text")).otherwise(F.flatten(F.transform(F.array(whole), cut)))
    texts = materialise(texts.select("h1", "h2", F.posexplode(pieces).alias("nth", "part"), F.regexp_extract("text", r"[\x20\x09-\x0D]*\z", 0).alias("tail")), "packing-texts")
    part = F.concat("part", F.when(F.col("last") & (F.col("start") > 0), F.col("tail")).otherwise(""))
    at = (F.floor(F.col("start") / capacity)).cast("int")
    return found.withColumn("nth", at).join(texts.hint("merge"), ["h1", "h2", "nth"]).select(*COLUMNS, part.alias("text"))
