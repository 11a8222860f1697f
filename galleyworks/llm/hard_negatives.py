"""Hard negatives of an embedding table, found exactly behind an orthogonal PCA rotation.

Rows (vec_id, label, vector of integers) score by integer inner products. For each anchor the best rows of its label are its positives; for each
positive, the best rows of other labels whose score is within a share of the positive's are its negatives.

1. The sums of products of all pairs of components, over all rows, are gathered by row of that matrix; its eigenvectors, leading ones first, are the rotation: a matrix of the vectors' length squared
   at most, whatever the number of rows. The first LEADING of them are sent to tasks.
2. Rows and anchors meet in blocks: a group is one shard of rows and one lane of anchors, so that a label with a third of all rows is many groups. For positives, shards are of one label.
3. In a group, anchors and rows are rotated. Partial products over the first STEPS[0] components come first; the remainder is at most the product of the
   residuals' lengths. Both, and a slack for rounding that is a share of the product of the vectors' lengths, are one matrix product of vectors with two more components. Pairs whose bound is under what their anchor
   needs are discarded; for the others the product goes on to STEPS[1] components, with a new bound. Survivors are verified by the integer product.
   What an anchor needs is its k-th best so far in the range of scores it wants, and rows come in tiles of growing size, so that it is known early.
4. The best of the shards are ranked for each anchor: higher scores first, ties by smaller vec_id.

Rows with a null vec_id, label or vector, or with any null, NaN or infinite component take no part. Vectors of different lengths never meet; empty ones all score 0. Rows alike in
vec_id, label and vector count once; rows of one vec_id that differ are rows of their own, but never positives or negatives of each other. An anchor without another row of its label
has no result, a positive without a row in its range none for it. A score whose exact value might be over MOST_SCORE is an error. An empty table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyworks.llm.scratch import materialise

#: Components of the two partial products; the second bounds what tasks get of the rotation.
STEPS = (16, 64)
#: Rows of a shard, anchors of a lane, about; anchors of a tile, and rows of the first and the largest tile.
SHARD, LANE, ANCHORS, FIRST, LARGEST = 1 << 14, 1 << 14, 512, 256, 4096
#: Share of a tile's pairs from which all its integer products are computed at once.
DENSE = 0.02
MOST_SCORE = 1 << 52
PRODUCTS = 1 << 12


def finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def scaled(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor(scale · x) of each component of `embedding`) of the rows that take part, rows alike once."""
    ids = rows.filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    vector = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return ids.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector")).distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components, a row of the matrix a row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            x = _matrix(batch.filter(pa.array(dims == dim)).column("vector"), dim)
            for a in range(0, len(x), PRODUCTS):
                sums[dim] = sums.get(dim, 0) + x[a : a + PRODUCTS].T @ x[a : a + PRODUCTS]
    for dim, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(list(s))], ["dim", "at", "sums"])


def _sum_rows(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    return pa.table({"dim": table.column("dim")[:1], "at": table.column("at")[:1], "sums": pa.array([_matrix(table.column("sums"), dim).sum(0)])})


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the leading STEPS[1] eigenvectors of the sums of products over all rows, as columns."""
    summed = rows.filter("dim > 0").select("dim", "vector").mapInArrow(_products, "dim int, at int, sums array<double>").groupBy("dim", "at").applyInArrow(_sum_rows, "dim int, at int, sums array<double>")
    parts: dict[int, list] = {}
    for r in summed.collect():
        parts.setdefault(r.dim, []).append((r.at, r.sums))
    out = {}
    for dim, of in parts.items():
        m = np.array([s for _, s in sorted(of)])
        m = (m + m.T) / max(2 * np.abs(m).max(), 1)  # its scale does not matter
        out[dim] = np.linalg.eigh(m)[1][:, ::-1][:, : STEPS[1]]
    return out


class Side:
    """Rows or anchors of a group: integer vectors, and their leading components with what bounds the remainder."""

    def __init__(self, table: pa.Table, dim: int, q: np.ndarray):
        self.ids, self.labels, self.x = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vector"), dim)
        self.length = np.sqrt(np.einsum("nd,nd->n", self.x, self.x))
        self.lead = self.x @ q
        self.bounds = [self._bound(k) for k in dict.fromkeys(min(k, q.shape[1]) for k in STEPS)]

    def _bound(self, k: int) -> np.ndarray:
        """Leading components, the length of the residual, and the share of the length that covers rounding to single precision, of the vectors and of their product."""
        part = self.lead[:, :k]
        rest = np.sqrt(np.maximum(self.length**2 - np.einsum("nk,nk->n", part, part), 0) + 1e-12 * self.length**2)
        return np.concatenate([part, rest[:, None], np.sqrt((k + 12) * 2.0**-23) * self.length[:, None]], 1).astype(np.float32)


def best(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> list[tuple[np.ndarray, ...]]:
    """For each range j of scores, low[:, j] to high[:, j] of each anchor: anchor position, score and vec_id of the k best rows in it."""
    if len(rows.ids) and len(anchors.ids) and anchors.length.max() * rows.length.max() >= MOST_SCORE:
        raise ValueError(f"a score may be over {MOST_SCORE}, which is not exact")
    n, ranges = len(anchors.ids), low.shape[1]
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(ranges)]
    need = low.astype(np.float64)
    a, width = 0, FIRST
    while a < len(rows.ids):
        tile = slice(a, a + width)
        for p in range(0, n, ANCHORS):
            own = slice(p, p + ANCHORS)
            least = need[own].min(1)
            r, c = np.nonzero(anchors.bounds[0][own] @ rows.bounds[0][tile].T >= least[:, None])
            if not len(r):
                continue
            same = anchors.labels[own][r] == rows.labels[tile][c]
            keep = (same if same_label else ~same) & (anchors.ids[own][r] != rows.ids[tile][c])
            r, c = r[keep], c[keep]
            many = len(r) > DENSE * len(anchors.ids[own]) * len(rows.ids[tile])
            for x, y in list(zip(anchors.bounds, rows.bounds))[1:]:
                if many or not len(r):
                    break
                near = np.einsum("nk,nk->n", x[own][r], y[tile][c]) >= least[r]
                r, c = r[near], c[near]
            # integers below 2^53: sums in double precision are exact in any order
            s = (anchors.x[own] @ rows.x[tile].T)[r, c] if many else np.einsum("nd,nd->n", anchors.x[own][r], rows.x[tile][c])
            s, at, ids = s.astype(np.int64), r + p, rows.ids[tile][c]
            for j in range(ranges):
                fit = (s >= need[at, j]) & (s <= high[at, j])
                if not fit.any():
                    continue
                old = (held[j][0] >= p) & (held[j][0] < p + ANCHORS)
                of, score, vec = (np.concatenate([h[old], x[fit]]) for h, x in zip(held[j], (at, s, ids)))
                order = np.lexsort((vec, -score, of))
                of, score, vec = of[order], score[order], vec[order]
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                full = nth == k - 1
                need[of[full], j] = np.maximum(need[of[full], j], score[full])
                top = nth < k
                held[j] = tuple(np.concatenate([h[~old], x[top]]) for h, x in zip(held[j], (of, score, vec)))
        a, width = a + width, min(2 * width, LARGEST)
    return held



def _positives(rotation, k: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor": [], "own": [], "vec_id": [], "score": []}
        if len(anchors) and len(rows):
            dim = anchors.column("dim")[0].as_py()
            q = rotation.value.get(dim, np.zeros((dim, 0)))
            a = Side(anchors, dim, q)
            edge = np.full((len(a.ids), 1), np.iinfo(np.int64).max)
            (at, score, vec) = best(a, Side(rows, dim, q), -edge, edge, k, True)[0]
            out = {"anchor": a.ids[at], "own": anchors.column("own").to_numpy()[at], "vec_id": vec, "score": score}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return find


def _negatives(rotation, k: int, low: int, high: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor", "own", "positive_id", "positive_score", "vec_id", "score")}
        if len(anchors) and len(rows):
            dim = anchors.column("dim")[0].as_py()
            q = rotation.value.get(dim, np.zeros((dim, 0)))
            a, ids, scores = Side(anchors, dim, q), anchors.column("positive_ids").to_pylist(), anchors.column("positive_scores").to_pylist()
            n = max(map(len, ids))
            # 100 · score from low · positive to high · positive, in integers; an absent positive has an empty range
            least, most = np.full((len(ids), n), MOST_SCORE), np.full((len(ids), n), -MOST_SCORE)
            for i, s in enumerate(scores):
                least[i, : len(s)], most[i, : len(s)] = [-(-low * x // 100) for x in s], [high * x // 100 for x in s]
            for j, (at, score, vec) in enumerate(best(a, Side(rows, dim, q), least, most, k, False)):
                found = {"anchor": a.ids[at], "own": anchors.column("own").to_numpy()[at], "positive_id": [ids[i][j] for i in at], "positive_score": [scores[i][j] for i in at], "vec_id": vec, "score": score}
                out = {c: [*x, *found[c]] for c, x in out.items()}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return find


def _meet(anchors: DataFrame, rows: DataFrame, counts: DataFrame, keys: list[str], find, schema: str) -> DataFrame:
    """Every anchor with every row of its keys, in groups of a shard and a lane. counts: keys, shards, lanes."""
    deal = lambda df, of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    a = anchors.join(counts, keys)
    a = a.withColumn("lane", deal(a, "own", "lanes")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "lanes")
    r = rows.join(counts, keys)
    r = r.withColumn("shard", deal(r, "own", "shards")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("shards", "lanes", "own")
    r = r.select(*[F.col(c).alias(c) for c in r.columns])  # the anchors may be of the same table
    group = [*keys, "shard", "lane"]
    return a.groupBy(*group).cogroup(r.groupBy(*group)).applyInArrow(find, schema)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, vector of integers as doubles (see scaled); anchors: a condition on vec_id.

    A negative's score is from `low` to `high` hundredths of its positive's.
    """
    spark = rows.sparkSession
    rows = materialise(rows.select("vec_id", "label", "vector", F.size("vector").alias("dim"), F.xxhash64("vec_id", "label", "vector").alias("own")), "negatives-rows")
    rotation = spark.sparkContext.broadcast(rotations(rows))
    asked = rows.filter(anchors)
    size = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    counted = rows.groupBy("dim", "label").agg(F.count("*").alias("n"), F.count_if(anchors).alias("m"))
    counted = materialise(counted.select("dim", "label", "n", "m"), "negatives-sizes")
    of_label = counted.filter("m > 0").select("dim", "label", size(F.col("n"), SHARD).alias("shards"), size(F.col("m"), LANE).alias("lanes"))
    hits = _meet(asked, rows, of_label, ["dim", "label"], _positives(rotation, positives), "anchor long, own long, vec_id long, score long")
    order = lambda *key: Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order("own"))).filter(F.col("rank") <= positives)
    best_of = ranked.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    best_of = best_of.select("own", F.transform("p", lambda x: x["vec_id"]).alias("positive_ids"), F.transform("p", lambda x: x["score"]).alias("positive_scores"))
    known = materialise(asked.join(best_of, "own"), "negatives-positives")
    of_dim = counted.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select("dim", size(F.col("n"), SHARD).alias("shards"), size(F.col("m"), LANE).alias("lanes"))
    hits = _meet(known, rows, of_dim, ["dim"], _negatives(rotation, negatives, low, high), "anchor long, own long, positive_id long, positive_score long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(order("own", "positive_id", "positive_score"))).filter(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
