"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text is its five-word shingles, each weighing (1 + ln tf) · idf with idf = 1 + ln(N / max(df, N / RARE)). Document
frequencies are counted over all documents in a hashed space of DF_BUCKETS features; the load that shingles of
few documents put on every feature (the median) is taken off, so that the df of a shingle that many documents share stays right at any
size of the corpus. Shingles in fewer than 1 / RARE of the documents weigh alike.

1. Consistent weighted samples: for each of SAMPLES draws a shingle and a quantised weight are picked so that two
   texts pick alike with a probability of their weighted Jaccard similarity. Every ROWS samples are a band; texts
   that agree on a band are candidates. A byte of each sample is kept as a sketch.
2. Copies alike word for word are one class from here on: a row per distinct text.
3. Every bucket (texts of one band value) has two leaders, its least and greatest id. Each member is held against its
   leaders by sketches first; what is promising is verified, first with one leader a member, then with the other
   leaders of other classes.
4. All other pairs of a bucket whose two members are not in one class yet: blocks of a bucket meet with their sketches, and members with a
   promising partner then meet with their texts; only links come out, and no more of them than join classes of the block.
5. Verification computes the weighted Jaccard similarity of the whole texts exactly. A pair is promising if PROMISING of its SAMPLES sketch bytes
   agree; at a similarity of 0.8 fewer do so in less than one of 100,000 pairs.
6. Links make classes by label propagation with pointer jumping. Texts are named by a 64-bit hash of theirs until here; the
   class id is the smallest doc_id in it, and null for a class without any.

Texts without words are one class (they are equal); texts of fewer than five words have one shingle of all their words.
Null texts count as empty; rows and doc_ids may repeat and be null: classes of different texts that share a doc_id can have
the same class id, but without_copies tells them apart; an empty table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyworks.llm.scratch import Tables, materialise, small_side
from galleyworks.llm.textkit import U, chunks, counted, free_name, mix, shingles

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, ROWS, PROMISING = 56, 4, 31
BANDS = SAMPLES // ROWS
DF_BUCKETS, DF_PART, RARE = 1 << 18, 1 << 10, 128
DRAWS = 1 << 14
#: Members of a block of sketches; members and mean shingles of a block of texts; members that share a leader's copy of the text; more than sums of floats can be off.
SKETCHES, BLOCK, BLOCK_SHINGLES, BESIDE, SLACK = 4096, 512, 1 << 20, 64, 1e-3
#: Hot leaders up to which their counts are broadcast.
SMALL = 100_000
LINK = "a long, b long, similarity double"


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DF_BUCKETS, np.int64), 0
    for batch in batches:
        for a, b, part in chunks(batch.column(0)):
            rows, h = shingles(part, SHINGLE)
            key = np.unique(rows * np.int64(DF_BUCKETS) + (h & U(DF_BUCKETS - 1)).astype(np.int64))
            total += np.bincount(key % DF_BUCKETS, minlength=DF_BUCKETS)
            n += b - a
    if n:
        parts = total.astype(np.int32).reshape(-1, DF_PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(parts)), pa.int32()), pa.array([np.array([n], np.int64).tobytes(), *(p.tobytes() for p in parts)], pa.binary())], ["part", "counts"])


def _sum_parts(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    total = sum(np.frombuffer(x, np.int64 if part < 0 else np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([part], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def idf_table(texts: DataFrame) -> np.ndarray:
    """idf of each of the DF_BUCKETS features; only this table, of fixed size, reaches the driver."""
    parts = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_document_frequencies, "part int, counts binary")
    rows = {r[0]: r[1] for r in parts.groupBy("part").applyInArrow(_sum_parts, "part int, counts binary").collect()}
    n = max(int(np.frombuffer(rows.pop(-1), np.int64)[0]) if rows else 0, 1)
    load = np.concatenate([np.frombuffer(rows[k], np.int64) for k in sorted(rows)]) if rows else np.zeros(DF_BUCKETS, np.int64)
    return idf_of(load - np.median(load), n)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(n / np.clip(df, n / RARE, n))).astype(np.float32)


def weights(part: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles of each text."""
    rows, h, n = counted(*shingles(part, SHINGLE))
    return rows, h, ((1 + np.log(n)) * idf[(h & U(DF_BUCKETS - 1)).astype(np.int64)]).astype(np.float32)


class Draws:
    """Random numbers of improved consistent weighted sampling: r and c are Gamma(2, 1), beta uniform.

    Each comes from its own table, by other bits of a shingle's hash: two shingles share all three draws in one of 2^42 cases.
    """

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        shape = (DRAWS, SAMPLES)
        self.r = g.gamma(2, 1, shape).astype(np.float32)
        self.beta = g.random(shape, np.float32)
        self.log_c = np.log(g.gamma(2, 1, shape)).astype(np.float32)

    def sample(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """SAMPLES 64-bit samples of one text's shingles and weights."""
        best, out, every = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, U), np.arange(SAMPLES)
        m = U(DRAWS - 1)
        for a in range(0, len(h), 2048):
            hh = h[a : a + 2048]
            r, beta = self.r[((hh >> U(20)) & m).astype(np.int64)], self.beta[((hh >> U(34)) & m).astype(np.int64)]
            t = np.log(w[a : a + 2048])[:, None] / r
            t += beta
            np.floor(t, out=t)
            value = self.log_c[(hh >> U(50)).astype(np.int64)]
            value -= r * (t - beta + 1)
            k = value.argmin(axis=0)
            v = value[k, every]
            less = v < best
            best[less] = v[less]
            out[less] = mix(hh[k] + t[k, every].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))[less]
        return out


_draws: list[Draws] = []
SIGNED = "id long, doc_id long, key binary, bands array<long>, sketch binary, whole double, shingles long"


def _signer(idf):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _draws:
            _draws.append(Draws())
        odd = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ROWS)], U)
        for batch in batches:
            for a, b, part in chunks(batch.column("text")):
                rows, h, w = weights(part, idf.value)
                edge = np.searchsorted(rows, np.arange(b - a + 1))
                bands, keys, sketch = np.zeros((b - a, BANDS), np.int64), [], np.zeros((b - a, SAMPLES), np.uint8)
                with np.errstate(over="ignore"):
                    for i in range(b - a):
                        hh, ww = h[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]]
                        # equal sets of shingles with equal counts are one class
                        keys.append(mix(np.array([np.sum(mix(hh + ww.view(np.uint32).astype(U) * odd[1])) if len(hh) else 1, np.sum(mix(hh * odd[2] + U(len(hh)))) if len(hh) else 1], U)).tobytes())
                        if len(hh):
                            s = _draws[0].sample(hh, ww)
                            sketch[i] = (s & U(255)).astype(np.uint8)
                            bands[i] = mix((s.reshape(BANDS, ROWS) * odd).sum(axis=1) + np.arange(BANDS, dtype=U)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(keys, pa.binary()), pa.array(list(bands), pa.list_(pa.int64())), pa.array([s.tobytes() for s in sketch], pa.binary()),
                        pa.array(np.bincount(rows, w, b - a), pa.float64()), pa.array(np.diff(edge), pa.int64()),
                    ],
                    ["id", "doc_id", "key", "bands", "sketch", "whole", "shingles"],
                )

    return sign


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths without nulls as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bytes in which two sketches agree."""
    return pa.array((_bytes(a, SAMPLES) == _bytes(b, SAMPLES)).sum(1), pa.int32())


def promising(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (lead, member) that total weights and sketches do not rule out. texts: id, sketch, whole."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("whole").alias(f"{c}_whole"))
    both = pairs.join(side("lead"), "lead").join(side("member"), "member")
    a, b = F.col("lead_whole"), F.col("member_whole")
    both = both.filter(F.least(a, b) >= (THRESHOLD - SLACK) * F.greatest(a, b))
    agreeing = F.arrow_udf(_agreeing, "int")
    return both.filter(agreeing("lead_sketch", "member_sketch") >= PROMISING).select("lead", "member")


def _verifier(idf, threshold):
    """Rows of one (leader, deal) come together, the leader's own first: link each other one that is alike enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, of, own = None, None, None
        for batch in batches:
            leads, members, firsts = batch.column("lead").to_pylist(), batch.column("member").to_pylist(), batch.column("first").to_pylist()
            found = []
            for a, b, part in chunks(batch.column("text")):
                rows, h, w = weights(part, idf.value)
                edge = np.searchsorted(rows, np.arange(b - a + 1))
                for i in range(b - a):
                    hh, ww = h[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]]
                    if firsts[a + i]:
                        lead, of, own = leads[a + i], hh.copy(), ww.copy()
                        continue
                    if leads[a + i] != lead:
                        continue  # the leader's text is gone from the input
                    if (s := similar(of, own, hh, ww)) >= threshold:
                        found.append((lead, members[a + i], s))
            if found:
                x, y, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return verify


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of the pairs (lead, member) of ids whose texts reach the threshold. Each member's text moves once a pair, a leader's once for BESIDE members."""
    counts = pairs.groupBy("lead").agg(F.count("*").alias("n")).filter(F.col("n") > BESIDE)
    counts = small_side(materialise(counts, "neardup-hot-leaders"), SMALL, 32)
    dealt = pairs.join(counts, "lead", "left").withColumn("deal", F.pmod(F.xxhash64("member"), F.coalesce(F.ceil(F.col("n") / BESIDE), F.lit(1))).cast("int")).select("lead", "member", "deal")
    wanted = dealt.select("lead", "deal", "member", F.lit(False).alias("first")).unionByName(dealt.select("lead", "deal", F.col("lead").alias("member"), F.lit(True).alias("first")).distinct())
    rows = texts.join(wanted.hint("merge"), texts["id"] == wanted["member"]).select("lead", "deal", "member", "first", "text")
    rows = rows.repartition("lead", "deal").sortWithinPartitions("lead", "deal", F.col("first").desc())
    return rows.mapInArrow(_verifier(idf, threshold), LINK)


def similar(of, own, hh, ww) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingle hashes and weights."""
    if not len(of) or not len(hh):
        return 0.0
    at = np.minimum(np.searchsorted(of, hh), len(of) - 1)
    same = of[at] == hh
    low = float(np.minimum(ww[same], own[at[same]]).sum())
    return low / (float(ww.sum() + own.sum()) - low)


def _near_by_sketch(table: pa.Table) -> pa.Table:
    """band, value, id of the members of one or two blocks of a bucket that have a promising partner of another class there."""
    band, value = table.column("band")[0], table.column("value")[0]
    block, two = table.column("block").to_numpy(), table.column("x")[0].as_py() != table.column("y")[0].as_py()
    label, whole, sketch = table.column("label").to_numpy(), table.column("whole").to_numpy(), _bytes(table.column("sketch"), SAMPLES)
    keep = np.zeros(len(label), bool)
    left = np.flatnonzero(block == block.min()) if two else np.arange(len(label))
    right = np.flatnonzero(block != block.min()) if two else left
    turned = np.ascontiguousarray(sketch[right].T)
    for a in range(0, len(left), 256):
        own = left[a : a + 256]
        agree = np.zeros((len(own), len(right)), np.uint8)
        for k in range(SAMPLES):
            agree += sketch[own, k][:, None] == turned[k][None, :]
        w, v = whole[own][:, None], whole[right][None, :]
        near = (agree >= PROMISING) & (label[own][:, None] != label[right][None, :]) & (np.minimum(w, v) >= (THRESHOLD - SLACK) * np.maximum(w, v))
        keep[own[near.any(1)]] = True
        keep[right[near.any(0)]] = True
    ids = table.column("id").filter(pa.array(keep))
    return pa.table({"band": pa.array([band.as_py()] * len(ids), pa.int32()), "value": pa.array([value.as_py()] * len(ids), pa.int64()), "id": ids})


def _block_verifier(idf, threshold):
    """Links between members of one bucket that are of different classes so far: of one block, or of two blocks with each other.

    A pair is looked at in the first band that it shares, and computed exactly. Classes grow as links are found, so that at most one link less than the members comes out.
    """

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, band, block = table.column("id").to_numpy(), table.column("band")[0].as_py(), table.column("block").to_numpy()
        two = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        of = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)[:, :band]
        parts = [(a, *weights(part, idf.value)) for a, _, part in chunks(table.column("text"))]
        row, h, w = (np.concatenate(x) for x in zip(*((a + rows, h, w) for a, rows, h, w in parts), strict=True))
        code = np.unique(h, return_inverse=True)[1].astype(np.int32)
        edge = np.searchsorted(row, np.arange(len(ids) + 1))
        whole, here, found = np.bincount(row, w, len(ids)), np.zeros(len(h), np.float32), []
        for i in range(len(ids) - 1):
            later = slice(i + 1, None)
            # no pair is more alike than its total weights are
            look = (of[later] != of[i]) & (np.minimum(whole[later], whole[i]) >= (threshold - SLACK) * np.maximum(whole[later], whole[i])) & ~(bands[later] == bands[i]).any(1)
            if two:
                look &= block[later] != block[i]
            if not look.any():
                continue
            own, rest = slice(edge[i], edge[i + 1]), slice(edge[i + 1], None)
            here[code[own]] = w[own]
            low = np.bincount(row[rest] - i - 1, np.minimum(w[rest], here[code[rest]]), len(ids) - i - 1)
            here[code[own]] = 0
            for j in i + 1 + np.flatnonzero(look & (low >= (threshold - SLACK) * (whole[later] + whole[i] - low))):
                its = slice(edge[j], edge[j + 1])
                if of[j] != of[i] and (s := similar(h[own], w[own], h[its], w[its])) >= threshold:
                    found.append((ids[i], ids[j], s))
                    of[of == of[j]] = of[i]
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return verify


def _grid(rows: DataFrame) -> DataFrame:
    """Rows of buckets (band, value; blocks) once for each pair (x, y) of blocks in which theirs takes part."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).drop("blocks", "other")


def open_links(members: DataFrame, labels: DataFrame, one: DataFrame, texts: DataFrame, idf, tables: Tables, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of links between members of a bucket whose classes (labels) differ. Every group holds two blocks, however large a bucket is.

    The leaders of a bucket were held against all of it before; buckets of the same members count once, in their first band.
    """
    rows = members.filter("id != low and id != high").drop("low", "high")
    rows = tables.write(rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "neardup-rest")
    sizes = rows.groupBy("band", "value").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("set_"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("set2_"))
    sizes = sizes.filter("least != most").withColumn("blocks", F.ceil(F.col("n") / SKETCHES).cast("int"))
    sizes = tables.write(sizes.groupBy("set_", "set2_", "n").agg(F.min(F.struct("band", "value", "blocks")).alias("s")).select("s.*"), "neardup-classless")
    open_ = _grid(rows.join(sizes, ["band", "value"])).join(one.select("id", "sketch", "whole"), "id")
    near = tables.write(open_.groupBy("band", "value", "x", "y").applyInArrow(_near_by_sketch, "band int, value long, id long").distinct(), "neardup-open")
    tables.drop(rows)
    rows = near.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(one.select("id", "bands", "shingles"), "id")
    sizes = near.join(one.select("id", "shingles"), "id").groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    # written: the join is then no part of the aggregation's stage, and a bucket of very many members can be split
    sizes = tables.write(sizes.select("band", "value", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "neardup-sizes")
    both = texts.join(_grid(rows.join(sizes, ["band", "value"])).drop("shingles").hint("merge"), "id")
    found = tables.write(both.groupBy("band", "value", "x", "y").applyInArrow(_block_verifier(idf, threshold), LINK), "neardup-open-links")
    tables.drop(near)
    return found


def merged(labels: DataFrame | None, more: DataFrame, tables: Tables) -> DataFrame:
    """labels (id, label; of all linked ids so far) after further links (a, b)."""
    if labels is None:
        return components(more, tables)
    named = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    of = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c)).alias(c)
    joined = components(more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(of("a"), of("b")).filter("a != b"), tables)
    whole = labels.unionByName(joined.select("id", F.col("id").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
    whole = whole.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    whole = tables.write(whole, "neardup-labels")
    tables.drop(joined, labels)
    return whole


def links(docs: DataFrame, one: DataFrame, idf, tables: Tables) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, similarity: verified links between distinct texts), (id, label: classes of the linked ones). docs: id, text, which may repeat; one: id, bands, sketch, whole, shingles of distinct texts."""
    members = one.select("id", F.posexplode("bands").alias("band", "value"))
    groups = members.groupBy("band", "value").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = tables.write(members.join(groups, ["band", "value"]), "neardup-members")
    # a leader among the members of another's bucket comes in both directions: one is enough
    pairs = members.select(F.explode(F.array("low", "high")).alias("lead"), F.col("id").alias("member")).filter("lead != member")
    pairs = pairs.select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b"), F.when(F.col("lead") < F.col("member"), 0).otherwise(1).alias("turned")).groupBy("a", "b").agg(F.min("turned").alias("turned"))
    pairs = pairs.select(F.when(F.col("turned") == 0, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(F.col("turned") == 0, F.col("b")).otherwise(F.col("a")).alias("member"))
    pairs = tables.write(promising(pairs, one), "neardup-pairs")
    # each text once, before the shuffle: copies must not meet in one task
    texts = tables.write(docs.groupBy("id").agg(F.first("text").alias("text")).join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "neardup-held")
    first = pairs.groupBy("member").agg(F.min("lead").alias("lead"))
    found = tables.write(verified(tables.write(first, "neardup-first"), texts, idf), "neardup-links")
    labels = merged(None, found, tables)
    named = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    rest = pairs.join(first.select("member", F.col("lead").alias("done")), "member").filter("lead != done").join(named("lead"), "lead", "left").join(named("member"), "member", "left")
    rest = tables.write(rest.filter(F.coalesce("lead_label", "lead") != F.coalesce("member_label", "member")).select("lead", "member"), "neardup-second")
    if not rest.isEmpty():
        more = tables.write(verified(rest, texts, idf), "neardup-more-links")
        labels, found = merged(labels, more, tables), found.unionByName(more)
    tables.drop(rest, pairs)
    more = open_links(members, labels, one, texts, idf, tables)
    if not more.isEmpty():
        labels, found = merged(labels, more, tables), found.unionByName(more)
    tables.drop(members, texts)
    return found, labels


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """id, label (the smallest id that is connected) of every end of an edge (a, b)."""
    tables = tables or Tables(edges.sparkSession)
    both = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = tables.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = tables.write(new, "cc-step")
        jump = step.select(F.col("id").alias("via"), F.col("label").alias("far"))
        new = tables.write(step.join(jump, step["label"] == jump["via"], "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "cc-labels")
        done = new.filter("label != old").isEmpty()
        tables.drop(step, labels)
        if done:
            tables.drop(both)
            out = new.select("id", "label")
            tables.paths[id(out)] = (out, tables.paths.pop(id(new))[1])
            return out
        labels = new


def _nodes(documents: DataFrame) -> DataFrame:
    """id (a hash of the text), doc_id and text of each document. Links and classes are between texts: doc_ids may be null or repeat."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.xxhash64(text).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _classes(documents: DataFrame) -> DataFrame:
    """id, doc_id, label (the same for all documents of a class, and for no others), class_id, n_links, n_copies, a row per document."""
    spark = documents.sparkSession
    tables = Tables(spark)
    docs = _nodes(documents)
    idf = spark.sparkContext.broadcast(idf_table(docs))
    signed = tables.write(docs.mapInArrow(_signer(idf), SIGNED), "neardup-signed")
    one = signed.groupBy("key").agg(F.min(F.struct("id", "bands", "sketch", "whole", "shingles")).alias("s"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    one = tables.write(one.select("key", "s.*", "least", "n_copies"), "neardup-texts")
    edges, labels = links(docs.select("id", "text"), one.filter("shingles > 0").select("id", "bands", "sketch", "whole", "shingles"), idf, tables)
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of = one.select("key", "id", "least", "n_copies").join(labels, "id", "left").join(degree, "id", "left")
    of = tables.write(of.select("key", F.coalesce("label", "id").alias("label"), "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"), "neardup-classes")
    # texts without links have their own least doc_id; only the classes of several texts are gathered
    several = tables.write(of.filter("n_links > 0").groupBy("label").agg(F.min("least").alias("of_class")), "neardup-least")
    of = of.join(several, "label", "left").select("key", "label", F.coalesce("of_class", "least").alias("class_id"), "n_links", "n_copies")
    tables.drop(one, labels)
    idf.unpersist()
    return signed.select("id", "doc_id", "key").join(of, "key").drop("key")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class; null if it has none), n_links (links of its text to different texts that were found: to leaders of its buckets, and those that joined classes after them; texts of one class are not all compared), n_copies (documents of its text), a row per document."""
    return _classes(documents).select("doc_id", "class_id", "n_links", "n_copies")


def without_copies(documents: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: that of its smallest doc_id, null last, and then of the smallest hash of its text; of rows alike in both, one."""
    found = materialise(_classes(documents), "neardup-result")
    rows = found.groupBy("label", "doc_id", "id").agg(F.count("*").alias("n"))
    stay = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n")).alias("s"))
    kept, node, many, of_text = free_name(documents, "kept", "node", "many", "of_text")
    stay = materialise(stay.select(F.col("s.doc_id").alias(kept), F.col("s.id").alias(node), (F.col("s.n") > 1).alias(many)), "neardup-kept")
    named = documents.withColumn(of_text, F.xxhash64(F.coalesce("text", F.lit(""))))
    at = (F.col(of_text) == F.col(node)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept))
    own = [F.col(f"`{c}`") for c in documents.columns]
    once = named.join(stay.filter(~F.col(many)), at).select(*own)
    repeated = stay.filter(many)
    if repeated.isEmpty():
        return once
    more = named.join(repeated, at).dropDuplicates([kept, of_text]).select(*own)
    return once.unionByName(more)
