"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character 3- to 5-grams; each gram has a vector in a hashed
table, and a word's vector is the weighted mean over its bag. A window of WINDOW words is the mean of its words'
vectors, and a two-class linear softmax scores it. A text's score is that of its highest window, and windows
begin at every word, so that neither a long text nor its place there dilutes a short passage; its average score is that of the
mean over all its words. Table and softmax are trained
jointly in numpy on a bounded sample of labelled rows. Misspelt words that training never saw
share grams with words that it saw.

Words end at Unicode spaces, punctuation, symbols and underscores. A run longer than PIECE bytes, as of a script
without spaces, counts as several words: overlapping pieces that together hold all of its grams.

Training runs in one task on the sample, which rows and bytes bound; the driver gets the vectors of the grams that were learnt.
Scoring reads each whole text once, in an Arrow UDF, without a shuffle. Null and empty texts get
the score of an empty window, which is that of the bias alone. Repeated rows score alike, and ties do not arise. Of several texts of one labelled doc_id the
shortest (then that of the least hash) trains; of several labels the toxic one holds; null ids and labels other than 0 and 1 do not train. Without labels of both classes every
text scores below 0.5. An empty table gives an empty result; other columns pass through untouched, but for one of the name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyworks.llm.textkit import U, chunks, flat, mix, shingles, span_hashes, word_spans

#: Labelled rows of each class that training takes at most, those of the lowest hashes of doc_id, as far as their texts fit SAMPLE_BYTES a class.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 3000, 24 << 20
BUCKETS, WIDTH, WINDOW, STRIDE, LEAST_WORDS, SHARPNESS = 1 << 17, 8, 16, 4, 8, 3.0
#: Pull of a vector to zero; share of the whole word in its bag.
DECAY, WHOLE = 1e-6, 0.15
#: A gram is learnt if it is in so many sample rows, and its shares of toxic and clean rows differ by this factor and by this likelihood ratio (chi-square of one degree).
LEAST_ROWS, LIFT, EVIDENCE = 3, 2.0, 6.6
STEPS, RATE = 400, 1.0
#: Share of the toxic class in the loss; clean documents that are lost weigh more than toxic ones that stay.
TOXIC_SHARE = 0.35
#: Bytes of a word that are one piece, and from one piece's begin to the next.
PIECE, PIECE_STEP = 12, 8
SPLIT = r"[\p{Z}\p{P}\p{S}\p{C}_]+"


@dataclass
class Model:
    grams: np.ndarray  # buckets of the grams that were learnt
    table: np.ndarray  # a vector of WIDTH for each
    softmax: np.ndarray  # WIDTH weights of the toxic less the clean class
    bias: float

    def gram_scores(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.grams] = self.table @ self.softmax
        return out


def pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and of every word or piece of one: start, end, row, whether its word begins with it and ends with it."""
    data, offsets = flat(pc.replace_substring_regex(pc.utf8_lower(column), SPLIT, " "))
    starts, ends, row = word_spans(data, offsets)
    many = np.maximum(-(-(ends - starts - (PIECE - PIECE_STEP)) // PIECE_STEP), 1)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    word_end, start = np.repeat(ends, many), np.repeat(starts, many) + nth * PIECE_STEP
    last = nth == np.repeat(many, many) - 1
    return data, start, np.where(last, word_end, start + PIECE), np.repeat(row, many), nth == 0, last


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram buckets of each piece, one after another, and where each one's begin. Words are padded with < and >."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts
    wide = size + first + last
    begin = np.cumsum(wide) - wide
    padded = np.full(int(wide.sum()), ord(">"), np.uint8)
    padded[begin[first]] = ord("<")
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(begin + first, size) + inside] = data[np.repeat(starts, size) + inside]
    word = [np.arange(n)]
    grams = [span_hashes(data, starts, ends)]
    for k in (3, 4, 5):
        per = np.maximum(wide - k + 1, 0)
        owner = np.repeat(np.arange(n), per)
        at = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        h = np.full(len(at), U(k), U)
        for i in range(k):
            h = h * U(0x100000001B3) + padded[at + i].astype(U)
        word.append(owner)
        grams.append(mix(h))
    word, grams = np.concatenate(word), np.concatenate(grams)
    order = np.argsort(word, kind="stable")
    return (grams[order] & U(BUCKETS - 1)).astype(np.int64), np.searchsorted(word[order], np.arange(n))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram bags of the distinct pieces and where each begins; of every piece in order, which it is, and its row."""
    data, starts, ends, row, first, last = pieces(column)
    named = span_hashes(data, starts, ends) * U(4) + first.astype(U) * U(2) + last.astype(U)
    _, one, which = np.unique(named, return_index=True, return_inverse=True)
    return *bags(data, starts[one], ends[one], first[one], last[one]), which, row


def shares(begin: np.ndarray, n: int) -> np.ndarray:
    """Share of each gram in its word's vector: WHOLE for the word itself, which comes first, and the rest for its character grams alike."""
    size = np.diff(np.append(begin, n))
    out = np.repeat((1 - WHOLE) / np.maximum(size - 1, 1), size)
    out[begin] = WHOLE
    return out


def distinct(column: pa.Array) -> np.ndarray:
    """One row of each set of near copies: texts that agree on the least and on the greatest shingle hash."""
    keys = np.zeros((len(column), 2), U)
    for a, b, part in chunks(column):
        rows, h = shingles(part)
        there, first = np.unique(rows, return_index=True)
        keys[a + there, 0], keys[a + there, 1] = h[first], h[np.append(first[1:], len(h)) - 1] if len(h) else 0
    return np.sort(np.unique(keys, axis=0, return_index=True)[1])


def telling(column: pa.Array, toxic: np.ndarray, lift: float = LIFT, evidence: float = EVIDENCE) -> np.ndarray:
    """Which buckets are in LEAST_ROWS rows and tell the classes apart."""
    rows = np.zeros((2, BUCKETS))
    for a, b, part in chunks(column):
        grams, begin, which, row = words(part)
        if len(begin):
            pair = np.unique(row * np.int64(len(begin)) + which)
            text, word = pair // len(begin), pair % len(begin)
            size = np.diff(np.append(begin, len(grams)))[word]
            spread = np.repeat(begin[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            seen = np.unique(np.repeat(text, size) * np.int64(BUCKETS) + grams[spread])
            for k in (0, 1):
                rows[k] += np.bincount(seen[toxic[a:b][seen // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
    n = np.array([[(toxic == 0).sum()], [(toxic == 1).sum()]], float)
    both, ratio = rows.sum(0), np.zeros(BUCKETS)
    for got, whole in ((rows, both), (n - rows, n.sum() - both)):
        expected = n * whole / n.sum()
        ratio += 2 * np.where(got > 0, got * np.log(np.maximum(got, 1) / np.maximum(expected, 1e-9)), 0).sum(0)
    share = (rows + 0.5) / (n + 1)
    return (both >= LEAST_ROWS) & (ratio > evidence) & (np.abs(np.log(share[1] / share[0])) > np.log(lift))


def train(texts: list[str], toxic: np.ndarray, seed: int = 7, steps: int = STEPS, rate: float = RATE, lift: float = LIFT, evidence: float = EVIDENCE, toxic_share: float = TOXIC_SHARE) -> Model:
    """Fit table, softmax and bias together by Adagrad on the pooled log-loss, the toxic class weighing `toxic_share` of it.

    Near copies train once. Grams that do not tell the classes apart keep the zero vector: they could only learn single texts by heart. Windows begin at every STRIDE words here.
    """
    rng = np.random.default_rng(seed)
    soft, bias = rng.normal(0, 1, WIDTH), -1.0
    column, toxic = pa.array(texts, pa.large_string()), np.asarray(toxic)
    one = distinct(column)
    column, toxic = column.take(pa.array(one)), toxic[one]
    none = Model(np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32), soft.astype(np.float32), bias)
    if not len(toxic) or toxic.min() == toxic.max():
        return none
    known = np.flatnonzero(telling(column, toxic, lift, evidence))
    if not len(known):
        return none
    of, gram, share, block, word, ws, we, wide, row = _gathered(column, known)
    n_words, n_blocks = int(word.max(initial=-1)) + 1, int(we.max(initial=1))
    weigh = np.where(toxic == 1, toxic_share / (toxic == 1).sum(), (1 - toxic_share) / (toxic == 0).sum())
    table = np.zeros((len(known), WIDTH))
    g_table, g_soft, g_bias = np.full(table.shape, 1e-6), np.full(WIDTH, 1e-6), 1e-6
    for _ in range(steps):
        u = np.bincount(of, (table @ soft)[gram] * share, n_words)
        sums = np.concatenate([[0.0], np.cumsum(np.bincount(block, u[word], n_blocks))])
        top, part = pool((sums[we] - sums[ws]) / wide + bias, row, len(toxic))
        d = ((1 / (1 + np.exp(-top)) - toxic) * weigh)[row] * part
        each = d / wide
        to_block = np.cumsum(np.bincount(ws, each, n_blocks + 1) - np.bincount(we, each, n_blocks + 1))
        to_gram = np.bincount(gram, np.bincount(word, to_block[block], n_words)[of] * share, len(known))
        to_soft, to_bias = to_gram @ table, float(d.sum())
        to_table = to_gram[:, None] * soft[None, :] + DECAY * table
        g_table += to_table**2
        table -= rate * to_table / np.sqrt(g_table)
        g_soft += to_soft**2
        soft = soft - 0.02 * to_soft / np.sqrt(g_soft)
        g_bias += to_bias**2
        bias -= 0.1 * to_bias / np.sqrt(g_bias)
    return Model(known, table.astype(np.float32), soft.astype(np.float32), float(bias))


def _gathered(column: pa.Array, known: np.ndarray):
    """Bags of the words that hold known grams (word, gram, share), those words' tokens (block, word), and windows (first block, end block, words, row)."""
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    bag, tokens, spans, n_words, n_blocks = [], [], [], 0, 0
    for a, b, part in chunks(column):
        grams, begin, which, row = words(part)
        n = np.bincount(row, minlength=b - a)
        blocks = np.maximum(-(-n // STRIDE), 1)
        base = np.cumsum(blocks) - blocks
        if len(begin):
            own = np.flatnonzero(place[grams] >= 0)
            held, of = np.unique(np.searchsorted(begin, own, "right") - 1, return_inverse=True)
            bag.append((n_words + of, place[grams[own]], shares(begin, len(grams))[own]))
            at = np.full(len(begin), -1)
            at[held] = n_words + np.arange(len(held))
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            there = at[which] >= 0
            tokens.append((n_blocks + (base[row] + nth // STRIDE)[there], at[which][there]))
            n_words += len(held)
        per = np.maximum(blocks - WINDOW // STRIDE + 1, 1)
        owner = np.repeat(np.arange(b - a), per)
        first = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        end = np.minimum(first + WINDOW // STRIDE, blocks[owner])
        width = np.minimum(end * STRIDE, n[owner]) - first * STRIDE
        spans.append((n_blocks + base[owner] + first, n_blocks + base[owner] + end, np.maximum(width, LEAST_WORDS), a + owner))
        n_blocks += int(blocks.sum())
    join = lambda parts, k: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * k
    return *join(bag, 3), *join(tokens, 2), *join(spans, 4)


def pool(z: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest window of each text, and each window's share in a soft maximum, by which training spreads the gradient."""
    first = np.searchsorted(row, np.arange(n))
    top = np.maximum.reduceat(z, first)
    e = np.exp(np.clip(SHARPNESS * (z - top[row]), -60, 0))
    return top, e / np.add.reduceat(e, first)[row]


def score_batch(column: pa.Array, scores: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and average score of each text: of its highest window, and of all its words."""
    tops, means = [], []
    for a, b, part in chunks(column):
        grams, begin, which, row = words(part)
        n = np.bincount(row, minlength=b - a)
        u = np.add.reduceat(scores[grams].astype(float) * shares(begin, len(grams)), begin)[which] if len(begin) else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(u)])
        end = np.cumsum(n)
        means.append((sums[end] - sums[end - n]) / np.maximum(n, 1))
        top = np.zeros(b - a)
        held = np.flatnonzero(n)
        if len(held):
            per = np.maximum(n[held] - WINDOW + 1, 1)
            first = np.repeat((end - n)[held] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            last = np.minimum(first + WINDOW, np.repeat(end[held], per))
            top[held] = np.maximum.reduceat((sums[last] - sums[first]) / np.maximum(last - first, LEAST_WORDS), np.cumsum(per) - per)
        tops.append(top)
    # rounded: a text scores alike whatever stands beside it in a batch
    chance = lambda z: 1 / (1 + np.exp(-np.clip(np.round(np.concatenate(z) if z else np.zeros(0), 9) + bias, -500, 500)))
    return chance(tops), chance(means)


def fitting(rows: list, most: int) -> list[tuple]:
    """Of rows (doc_id, toxic, bytes, hash, order) those of each class that `most` bytes hold, by order: one that does not fit is passed over. If none fits, the least of a class is there, unless `most` is 0."""
    out = []
    for kind in (0, 1):
        own, left = sorted((r for r in rows if r["toxic"] == kind), key=lambda r: (r["order"], r["doc_id"])), most
        taken = [r for r in own if r["bytes"] <= left and (left := left - r["bytes"]) >= 0]
        out += taken or sorted(own, key=lambda r: (r["bytes"], r["order"]))[: most > 0]
    return [(r["doc_id"], r["toxic"], r["bytes"], r["hash"]) for r in out]


def sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, toxic, text of the labelled rows that train: `per_class` of each class with the lowest hashes of doc_id, without those that no longer fit in `sample_bytes` of texts; a class with rows is never empty."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text").cast("long")).withColumn("hash", F.xxhash64("text"))
    picked = None
    for kind in (0, 1):
        part = usable.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sizes = texts.select("doc_id", "bytes", "hash").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("bytes", "hash")).alias("s")).select("doc_id", "toxic", "s.*")
    chosen = fitting(sizes.withColumn("order", F.xxhash64("doc_id")).collect(), sample_bytes)  # per_class rows of numbers a class at most
    sizes = documents.sparkSession.createDataFrame(chosen, sizes.schema)
    return texts.join(F.broadcast(sizes), ["doc_id", "bytes", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    table = table.sort_by("doc_id")
    m = train(table["text"].to_pylist(), table["toxic"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (m.grams.astype(np.int64), m.table, m.softmax)] + [pa.array([m.bias])], ["grams", "vectors", "softmax", "bias"])


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on the sample in one task. Only the vectors of the learnt grams reach the driver."""
    row = sample(documents, labels, per_class, sample_bytes).coalesce(1).mapInArrow(_trainer, "grams binary, vectors binary, softmax binary, bias double").first()
    if row is None:
        row = (b"", b"", np.ones(WIDTH, np.float32).tobytes(), -1.0)
    return Model(np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.float32).reshape(-1, WIDTH), np.frombuffer(row[2], np.float32), row[3])


def scorer(spark: SparkSession, model: Model):
    """An Arrow UDF: text column to a struct of score and average."""
    sent = spark.sparkContext.broadcast((model.gram_scores(), float(model.bias)))

    @F.arrow_udf("struct<score:double,average:double>")
    def toxicity(text: pa.Array) -> pa.Array:
        score, average = score_batch(text, *sent.value)
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(average, pa.float64())], ["score", "average"])

    return toxicity


def with_score(documents: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """documents with a struct column of score and average."""
    return documents.withColumn(name, scorer(documents.sparkSession, model)(F.col(text)))
