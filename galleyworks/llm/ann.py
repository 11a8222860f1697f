"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Vectors are dealt by hash into shards of about SHARD_ROWS. A shard's graph is a stack of levels, each a flat array of
neighbour positions; every vector is on the bottom level, and one in M of a level on the one above. Search goes
greedily down the stack and keeps a beam of the best on the bottom; whole blocks of queries move through the graph
in lock step. An added coordinate makes all indexed vectors equally long, which turns largest inner product
into nearest neighbour and leaves inner products with queries as they are. Every shard measures its own recall against brute force
on PROBES of its vectors and widens its beam until RECALL is reached, so that hard data get wider beams instead of worse answers. Every shard answers every query; the
shards' answers are merged by score. The whole beam is scored anew in double precision on the original vectors.

Equal vectors are indexed once, with the ids that an answer could need (the smallest K + 1), found in
salted steps, so that a vector that a third of all rows share is no large group anywhere. A shard's index moves to a task once for LANE queries, which stream past it.

Null and zero vectors and those with null or non-finite components take no part, as queries or candidates. Vectors of
different lengths never meet. Rows alike in id and vector count once; of several vectors of one query id, the one of the least hash asks. Ties go to the smaller id. An empty table gives an empty
result; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleyworks.llm.scratch import materialise

K, M, EF_BUILD, EF = 20, 24, 96, 64
#: Vectors of a shard, about; queries that share a copy of a shard's index; a shard's own queries that measure its recall, and the share of the K + 1 nearest that they must find.
SHARD_ROWS, LANE, PROBES, RECALL = 16_384, 1 << 20, 64, 0.98
SALTS = (64, 8, 1)
LONE = -1


def beam(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the `ef` best found for each query, best first; LONE and -inf where there are fewer.

    graph: neighbour positions of each position, LONE at the end. entry: positions per query. The `width` best that were not
    expanded yet are expanded together.
    """
    n, q = len(graph), len(queries)
    out_i, out_s = np.full((q, ef), LONE, np.int32), np.full((q, ef), -np.inf, np.float32)
    for a in range(0, q, step := max(1, (1 << 25) // max(n, 1))):
        part = queries[a : a + step]
        b = len(part)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # LONE
        ids = np.full((b, ef), LONE, np.int32)
        sims = np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        e = entry[a : a + step][:, :ef]
        ids[:, : e.shape[1]] = e
        sims[:, : e.shape[1]] = np.where(e == LONE, -np.inf, np.einsum("bed,bd->be", vectors[e], part))
        done[:, : e.shape[1]] = e == LONE
        np.put_along_axis(seen, e.astype(np.int64) % (n + 1), True, 1)
        seen[:, n] = True
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            best = np.argpartition(-open_sims, min(width, ef) - 1, axis=1)[:, :width] if ef > width else np.arange(ef)[None].repeat(len(live), 0)
            value = np.take_along_axis(open_sims, best, 1)
            going = np.isfinite(value).any(1)
            live, best, value = live[going], best[going], value[going]
            if not len(live):
                break
            chosen = np.where(np.isfinite(value), np.take_along_axis(ids[live], best, 1), LONE)
            flags = done[live]
            np.put_along_axis(flags, best, True, 1)
            near = np.where(chosen[:, :, None] == LONE, LONE, graph[chosen]).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = LONE
            fresh = ~seen[live[:, None], near % (n + 1)]
            near = np.where(fresh, near, LONE)
            seen[live[:, None], near % (n + 1)] = True
            new = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            new[r, c] = np.einsum("ed,ed->e", vectors[near[r, c]], part[live[r]])
            all_i, all_s = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], new], 1)
            all_d = np.concatenate([flags, ~fresh], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_i, all_s, all_d))
        order = np.argsort(-sims, axis=1, kind="stable")
        out_i[a : a + b], out_s[a : a + b] = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return out_i, out_s


def select(vectors: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row out of its candidates (best first): those nearer to the row than to one chosen before, then the next best."""
    n, c = cand.shape
    x = vectors[cand]
    mutual = np.einsum("ncd,ned->nce", x, x, optimize=True) if c * c * n < 1 << 22 else np.matmul(x, x.transpose(0, 2, 1))
    real = np.isfinite(sims)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        blocked = (taken[:, :j] & (mutual[:, j, :j] > sims[:, j, None])).any(1)
        taken[:, j] = real[:, j] & ~blocked & (taken[:, :j].sum(1) < m)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(cand, order, 1), LONE)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=LONE)
    return out


def top_rows(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def build_level(vectors: np.ndarray, m: int, enter) -> np.ndarray:
    """Flat neighbour array of one level, batch by batch; enter(vectors) gives entry positions on this level."""
    n = len(vectors)
    graph = np.full((n, m), LONE, np.int32)
    done = 0
    while done < n:
        b = min(n - done, max(64, min(done, 1024)))
        new = np.arange(done, done + b)
        own = vectors[new] @ vectors[new].T
        np.fill_diagonal(own, -np.inf)
        near = top_rows(own, min(b, m))
        cand, sims = near + done, np.take_along_axis(own, near, 1)
        if done:
            first = enter(vectors[new])
            first = np.where(first < done, first, LONE)
            first[:, 0] = np.where(first[:, 0] == LONE, 0, first[:, 0])
            found, fs = beam(vectors, graph[:done], vectors[new], first, EF_BUILD)
            cand, sims = np.concatenate([found, cand], 1), np.concatenate([fs, sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, : EF_BUILD]
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        graph[new, : m // 2] = select(vectors, cand, sims, m // 2)
        # the other way round: each chosen neighbour takes the new one in, and keeps its best m
        src, col = np.nonzero(graph[new] != LONE)
        dst = graph[new][src, col]
        order = np.argsort(dst, kind="stable")
        dst, back = dst[order], new[src[order]]
        hit, at, size = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(hit), 4096):
            h, f, s = hit[lo : lo + 4096], at[lo : lo + 4096], size[lo : lo + 4096]
            more = np.full((len(h), int(s.max())), LONE, np.int32)
            rows = np.repeat(np.arange(len(h)), s)
            more[rows, np.arange(len(rows)) - np.repeat(np.cumsum(s) - s, s)] = back[np.repeat(f - (np.cumsum(s) - s), s) + np.arange(len(rows))]
            both = np.concatenate([graph[h], more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = LONE
            bs = np.where(both == LONE, -np.inf, np.einsum("ncd,nd->nc", vectors[both], vectors[h]))
            order2 = top_rows(bs, 2 * m)
            both, bs = np.take_along_axis(both, order2, 1), np.take_along_axis(bs, order2, 1)
            full = (np.isfinite(bs).sum(1) > m)
            graph[h] = np.pad(both, ((0, 0), (0, max(0, m - both.shape[1]))), constant_values=LONE)[:, :m]
            if full.any():
                graph[h[full]] = select(vectors, both[full], bs[full], m)
        done += b
    return graph


class Index:
    """vectors (n x d) with levels: (positions in vectors, flat neighbour array), bottom first."""

    def __init__(self, vectors: np.ndarray, levels: list | None = None, seed: int = 11):
        length = np.einsum("nd,nd->n", vectors, vectors)
        self.vectors = np.concatenate([vectors, np.sqrt(np.maximum(length.max(initial=0) - length, 0))[:, None]], 1).astype(np.float32)
        self.levels = levels or []
        if levels is None:
            rng = np.random.default_rng(seed)
            height = np.minimum((-np.log(rng.random(len(vectors))) / np.log(M)).astype(int), 8)
            order = np.argsort(-height, kind="stable")  # those of upper levels come first on each level
            for h in range(int(height.max(initial=0)), -1, -1):
                members = order[height[order] >= h]
                flat = build_level(self.vectors[members], 2 * M if h == 0 else M, lambda x, members=members: self._enter(x, members))
                self.levels.insert(0, (members.astype(np.int32), flat))

    def _enter(self, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Entry positions on the level of `members`, which begins with those of the levels above, in their order."""
        if not self.levels:
            return np.zeros((len(queries), 1), np.int64)
        return self._down(queries, 0)

    def _down(self, queries: np.ndarray, to: int) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int64)
        for members, graph in self.levels[: to - 1 if to else None : -1]:
            entry = beam(self.vectors[members], graph, queries, entry, 8)[0][:, :4].astype(np.int64)
        return entry

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """Positions of the `ef` best found for each query, LONE where there are fewer."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        entry = self._down(q, 1) if len(self.levels) > 1 else np.zeros((len(q), 1), np.int64)
        members, graph = self.levels[0]
        found = beam(self.vectors[members], graph, q, entry, ef, max(4, ef // 32))[0]
        return np.where(found == LONE, LONE, members[found])

    def measured(self, k: int = K + 1, seed: int = 3) -> int:
        """The beam with which PROBES of the vectors find RECALL of their k nearest; the number of vectors, which finds all, at most."""
        n = len(self.vectors)
        probes = np.random.default_rng(seed).permutation(n)[:PROBES]
        own, k, ef = self.vectors[probes][:, :-1], min(k, n), EF
        sims = own @ self.vectors[:, :-1].T
        least = np.partition(sims, n - k, axis=1)[:, n - k, None]
        while ef < n:
            found = self.search(own, ef)
            hits = (np.where(found == LONE, -np.inf, np.take_along_axis(sims, np.maximum(found, 0), 1)) >= least - 1e-6).sum(1)
            if np.minimum(hits, k).sum() >= RECALL * k * len(probes):
                break
            ef *= 2
        return min(ef, n)


def sound(v: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int = K + 1) -> DataFrame:
    """h1, h2, ids (the `keep` smallest of the rows of one vector, ascending), embedding: a row per distinct vector."""
    ids = rows.select("h1", "h2", "vec_id").distinct().withColumn("deal", F.xxhash64("vec_id"))
    for salt in SALTS:
        w = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
        ids = ids.withColumn("salt", F.pmod("deal", F.lit(salt))).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= keep).drop("nth")
    ids = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.join(rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")), ["h1", "h2"])


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("h1").reset_index(drop=True)
    exact = np.stack(shard["embedding"].to_numpy()).astype(np.float64)
    v = exact.astype(np.float32)
    index = Index(v)
    ids = [np.asarray(x, np.int64) for x in shard["ids"]]
    return pd.DataFrame(
        {
            "dim": [v.shape[1]], "shard": [int(shard["shard"].iloc[0])], "beam": [index.measured()], "vectors": [v.tobytes()], "exact": [exact.tobytes() if (v != exact).any() else b""],
            "ids": [np.concatenate(ids).tobytes()], "n_ids": [np.array([len(x) for x in ids], np.int32).tobytes()], "members": [[m.tobytes() for m, _ in index.levels]], "graphs": [[g.tobytes() for _, g in index.levels]],
        }
    )


INDEX = "dim int, shard int, beam int, vectors binary, exact binary, ids binary, n_ids binary, members array<binary>, graphs array<binary>"
HITS = "query_id long, vec_id long, score double"


def participants(df: DataFrame) -> DataFrame:
    """vec_id, embedding in double precision, of the rows that take part."""
    rows = df.filter(sound(F.col("embedding")) & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def build(embeddings: DataFrame) -> DataFrame:
    """The index: a row for each shard, as a table in the shared folder."""
    rows = participants(embeddings).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    one = materialise(distinct_vectors(rows), "ann-vectors")
    shards = max(1, -(-one.count() // SHARD_ROWS))
    one = one.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int"))
    return materialise(one.groupBy("dim", "shard").applyInPandas(_build, INDEX), "ann-index")


class Shard:
    """A row of the index, ready for search."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
        self.exact = np.frombuffer(row["exact"], np.float64).reshape(-1, row["dim"]) if row["exact"] else self.vectors
        members = [np.frombuffer(m, np.int32) for m in row["members"]]
        self.index = Index(self.vectors, [(m, np.frombuffer(g, np.int32).reshape(len(m), -1)) for m, g in zip(members, row["graphs"], strict=True)])
        self.ids, self.size, self.beam = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["n_ids"], np.int32), row["beam"]
        self.first = np.cumsum(self.size) - self.size

    def answer(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of the K best of each query, its own id left out."""
        found = self.index.search(queries, self.beam)
        rows, col = np.nonzero(found != LONE)
        at = found[rows, col]
        score = np.einsum("nd,nd->n", queries[rows].astype(np.float64), self.exact[at].astype(np.float64))
        per = self.size[at]
        each = np.repeat(np.arange(len(rows)), per)
        vec = self.ids[np.repeat(self.first[at] - (np.cumsum(per) - per), per) + np.arange(len(each))]
        rows, score = rows[each], score[each]
        keep = query_ids[rows] != vec
        rows, vec, score = rows[keep], vec[keep], score[keep]
        order = np.lexsort((vec, -score, rows))
        rows, vec, score = rows[order], vec[order], score[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return query_ids[rows[nth < K]], vec[nth < K], score[nth < K]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (dim, shard, lane) come together: the shard's index, then queries."""
    shard, of = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "lane")), strict=True))
        is_query = batch.column("query_id").is_valid().to_pylist()
        a = 0
        while a < len(keys):
            if not is_query[a]:
                shard, of = Shard(batch.column("index")[a].as_py() | {"dim": keys[a][0]}), keys[a]
                a += 1
                continue
            b = a
            while b < len(keys) and is_query[b] and keys[b] == keys[a]:
                b += 1
            if of == keys[a]:  # else no vector of this length is in the shard
                ids = batch.column("query_id").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                q = batch.column("embedding").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard.answer(ids, q)], ["query_id", "vec_id", "score"])
            a = b


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest found of each of `queries` (vec_id, embedding), the query's own id left out."""
    shards = index.agg(F.max("shard")).first()[0]
    q = participants(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    q = materialise(q.withColumn("dim", F.size("embedding")), "ann-queries")
    lanes = max(1, -(-q.count() // LANE))
    q = q.withColumn("lane", F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards or 0))))
    whole = F.struct("beam", "vectors", "exact", "ids", "n_ids", "members", "graphs").alias("index")
    parts = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), whole)
    rows = parts.unionByName(q, allowMissingColumns=True).select("dim", "shard", "lane", "query_id", "embedding", "index")
    keys = ["dim", "shard", "lane"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first())
    hits = rows.mapInArrow(_answers, HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest found of each row of `queries` (vec_id, embedding) among `embeddings`, the query's own id left out."""
    return search(build(embeddings), queries)
