"""The prefix trie of conversations: a Cartesian tree over the longest common prefixes of sorted conversations.

1. A turn is named by 128 bits of its role and text. Conversations are sorted by their sequences of names: up to CHUNK names are a key; for longer ones, keys of CHUNK names each are sorted
   and ranked first, and the ranks are names in turn, so that a key is bounded whatever the length of a conversation. Conversations alike become one sequence.
2. The longest common prefix of each sequence with the one before it comes from one shuffle of the turns by (sequence, place).
3. All nearest smaller values of that array, to either side, are found in blocks, in parallel: by a stack within a block; what a block leaves open is answered by the nearest block
   whose minimum is less, found in the list of block minima (BLOCKS numbers at most), by its minima from that side.
4. Positions of one value and one left end are one node of the Cartesian tree: the sequences between its nearest smaller values share a prefix of that length, and no longer one.
   With the ends of sequences these are the trie's nodes that branch or end; the depths between a node and its parent are filled in.
5. Members, leaves and saved words of a node are differences of running sums over its interval, the least conversation is a minimum over it: within a block, or of a block's
   end, whole blocks, and a block's beginning.

Equal places of turns are ordered by role and text; null roles and texts are empty. Rows of a null conv_id belong to no conversation. Repeated rows are turns of their own. Turns of any
length and number, copies of one conversation and prefixes that all share are divided among tasks; a digest of very many conversations is taken of their ids as they stream by, in pieces of ENDS ids. An
empty table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galleyworks.llm.scratch import Tables
from galleyworks.operators.order import block_rows, cumulated, numbered

#: Names of a key; ids of a piece of a digest; depths that are filled in, or summed, at once.
CHUNK, ENDS, DEPTHS = 64, 1 << 12, 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = -1


def turns_of(conversations: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 1, a, b: the turn's name, words), (conv_id, n_turns)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(7), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    placed = numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", name="n", keep=["conv_id", "a", "b", "words"], write=tables.write)
    convs = tables.write(placed.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("n_turns")), "trie-conversations")
    return placed.join(convs.select("conv_id", "first"), "conv_id").select("conv_id", (F.col("n") - F.col("first") + 1).alias("pos"), "a", "b", "words"), convs.select("conv_id", "n_turns")


def rebuilt(turns: DataFrame, convs: DataFrame, heads: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each conversation's first `heads` turns (at most `most`) are replaced by as many of the conversation `base`, as far as there are."""
    of = convs.select("conv_id", heads.alias("h"), base.alias("base"), "n_turns")
    had = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("of_base"))
    of = of.join(had, "base", "left").withColumn("head", F.least("h", F.coalesce("of_base", F.lit(0))))
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    begun = first.join(of.select("base", "conv_id", "head"), "base").filter("pos <= head").select("conv_id", "pos", "a", "b", "words")
    rest = turns.join(of.select("conv_id", "h", "head"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "a", "b", "words")
    return begun.unionByName(rest), of.select("conv_id", (F.col("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))


def sequences(turns: DataFrame, convs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(idx from 0 in order, m: its least conversation, w: how many, len), (conv_id, idx) of the distinct sequences."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    names = turns.select("conv_id", "pos", F.struct("a", "b").alias("name"))
    while True:
        part = F.floor((F.col("pos") - 1) / CHUNK).cast("long")
        keys = names.groupBy("conv_id", part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("key"))
        if longest <= CHUNK:
            break
        keys = tables.write(keys, "trie-keys")
        ranks = tables.write(numbered(keys.select("key").distinct(), "key", name="rank", write=tables.write), "trie-ranks")
        names = keys.join(ranks, "key").select("conv_id", (F.col("part") + 1).alias("pos"), F.col("rank").alias("name"))
        longest = -(-longest // CHUNK)
    whole = convs.join(keys.select("conv_id", "key"), "conv_id", "left")
    whole = tables.write(whole.withColumn("key", F.coalesce("key", F.array().cast(keys.schema["key"].dataType))), "trie-wholes")
    distinct = whole.groupBy("key").agg(F.min("conv_id").alias("m"), F.count("*").alias("w"), F.max("n_turns").alias("len"))
    distinct = tables.write(numbered(distinct, "key", name="idx", write=tables.write), "trie-sequences")
    return distinct.select("idx", "m", "w", "len"), whole.join(distinct.select("key", "idx"), "key").select("conv_id", "idx")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one idx come together and in order."""
    of, h = None, None
    for batch in batches:
        out = []
        for idx, text in zip(batch.column("idx").to_pylist(), batch.column("ids").to_pylist()):
            if idx != of:
                if of is not None:
                    out.append((of, h.hexdigest()))
                of, h = idx, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["idx", "sha"])
    if of is not None:
        yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["idx", "sha"])


def digests(members: DataFrame, distinct: DataFrame, tables: Tables) -> DataFrame:
    """idx, sha: SHA-256 of the ascending conv_ids of the sequences of several conversations."""
    several = numbered(members.join(distinct.filter("w > 1").select("idx"), "idx"), "idx", "conv_id", name="n", write=tables.write)
    first = several.groupBy("idx").agg(F.min("n").alias("first"))
    pieces = several.join(first, "idx").groupBy("idx", F.floor((F.col("n") - F.col("first")) / ENDS).alias("piece"))
    pieces = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition("idx").sortWithinPartitions("idx", "piece").select("idx", "ids").mapInArrow(_digest, "idx long, sha string")


def common_prefixes(turns: DataFrame) -> DataFrame:
    """idx, lcp: turns that sequence idx shares with the one before it. turns: idx, pos, a, b."""
    both = turns.select("idx", "pos", "a", "b").unionByName(turns.select((F.col("idx") + 1).alias("idx"), "pos", "a", "b"))
    both = both.groupBy("idx", "pos").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"))
    return both.filter("n = 1 OR a != a2 OR b != b2").groupBy("idx").agg((F.min("pos") - 1).alias("lcp"))


def smaller(values: np.ndarray) -> np.ndarray:
    """Position of the nearest smaller value to the left of each, NONE where there is none."""
    out, stack = [], []
    values = values.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else NONE)
        stack.append(i)
    return np.array(out, np.int64)


def range_minima(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of values[left] to values[right], both included."""
    levels = [values]
    while 2 << len(levels) - 1 <= len(values):
        step = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.zeros(len(left), np.int64)
    height = np.frexp((right - left + 1).astype(float))[1] - 1
    for h in np.unique(height):
        at = height == h
        out[at] = np.minimum(levels[h][left[at]], levels[h][right[at] - (1 << h) + 1])
    return out


BLOCK = "idx long, left long, left_lcp long, right long, right_lcp long, lo long, pre long, suf long, block long"


def _in_block(table: pa.Table) -> pa.Table:
    """Nearest smaller values within a block, minima of m from its beginning and to its end, and over the sequences between two nearest smaller values."""
    table = table.sort_by("idx")
    idx, lcp, m = (table.column(c).to_numpy() for c in ("idx", "lcp", "m"))
    left, right = smaller(lcp), len(lcp) - 1 - smaller(lcp[::-1])[::-1]
    right[right == len(lcp)] = NONE
    known = (left != NONE) & (right != NONE)
    lo = np.zeros(len(m), np.int64)
    lo[known] = range_minima(m, left[known], right[known] - 1)
    at = lambda values, where: pa.array(values[where], pa.int64(), mask=where == NONE)
    columns = [idx, at(idx, left), at(lcp, left), at(idx, right), at(lcp, right), pa.array(lo, pa.int64(), mask=~known), np.minimum.accumulate(m), np.minimum.accumulate(m[::-1])[::-1], table.column("block")]
    return pa.table(dict(zip([c.split()[0] for c in BLOCK.split(", ")], columns)))


ANSWER = "asking long, lcp long, to_left boolean, at long, value long"


def _answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """The position of a block nearest to the asking one whose value is under lcp: the last one for a block further right, the first one else."""
    out = {c.split()[0]: [] for c in ANSWER.split(", ")}
    if len(asked):
        rows = rows.sort_by("idx")
        idx, lcp = rows.column("idx").to_numpy(), rows.column("lcp").to_numpy()
        for side in (True, False):
            part = asked.filter(pa.array(np.array(asked.column("to_left").to_pylist()) == side))
            order = np.arange(len(idx))[:: -1 if side else 1]
            falling = np.minimum.accumulate(lcp[order])
            at = order[np.searchsorted(-falling, -part.column("lcp").to_numpy(), "right")]
            for c, x in zip(out, (part.column("asking").to_pylist(), part.column("lcp").to_pylist(), [side] * len(at), idx[at].tolist(), lcp[at].tolist())):
                out[c] += x
    return pa.table({c: pa.array(x, pa.bool_() if c == "to_left" else pa.int64()) for c, x in out.items()})


def nearest_smaller(rows: DataFrame, count: int, size: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(idx, left, left_lcp, right, right_lcp: nearest smaller values, NONE in value and count in place beyond the end; lo or null; pre, suf), (block, least m of it)."""
    spark = rows.sparkSession
    rows = tables.write(rows.select("idx", "lcp", "m", F.floor(F.col("idx") / size).cast("long").alias("block")), "trie-blocks")
    found = tables.write(rows.groupBy("block").applyInArrow(_in_block, BLOCK), "trie-in-blocks")
    lows = sorted(rows.groupBy("block").agg(F.min("lcp"), F.min("m")).collect())
    minima = spark.sparkContext.broadcast(np.array([r[1] for r in lows]))

    def target(block: pa.Array, lcp: pa.Array, to_left: pa.Array) -> pa.Array:
        out, low = [], minima.value
        for b, v, side in zip(block.to_pylist(), lcp.to_pylist(), to_left.to_pylist()):
            under = np.flatnonzero(low[:b] < v) if side else b + 1 + np.flatnonzero(low[b + 1 :] < v)
            out.append(None if not len(under) else int(under[-1] if side else under[0]))
        return pa.array(out, pa.int64())

    given = found.join(rows.select("idx", "lcp"), "idx").filter("idx > 0")
    open_ = given.filter("left IS NULL").select("block", "lcp", F.lit(True).alias("to_left")).unionByName(given.filter("right IS NULL").select("block", "lcp", F.lit(False).alias("to_left"))).distinct()
    open_ = open_.select(F.col("block").alias("asking"), "lcp", "to_left", F.arrow_udf(target, "long")("block", "lcp", "to_left").alias("block")).filter("block IS NOT NULL")
    answers = tables.write(open_.groupBy("block").cogroup(rows.select(*[F.col(c).alias(c) for c in rows.columns]).groupBy("block")).applyInArrow(_answer, ANSWER), "trie-answers")
    side = lambda which, name: answers.filter(which).select(F.col("asking").alias("block"), "lcp", F.col("at").alias(f"{name}_at"), F.col("value").alias(f"{name}_value"))
    whole = given.join(side("to_left", "l"), ["block", "lcp"], "left").join(side("NOT to_left", "r"), ["block", "lcp"], "left")
    whole = whole.select(
        "idx", "lcp", F.coalesce("left", "l_at").alias("left"), F.coalesce("left_lcp", "l_value").alias("left_lcp"), F.coalesce("right", "r_at", F.lit(count)).alias("right"), F.coalesce("right_lcp", "r_value", F.lit(NONE)).alias("right_lcp"), "lo"
    )
    return tables.write(whole, "trie-nearest"), found.select("idx", "pre", "suf"), np.array([r[2] for r in lows])


def _filled(tree: DataFrame) -> DataFrame:
    """tree once for each `depth` above u, up to v; long runs in steps of DEPTHS."""
    stepped = tree.withColumn("_step", F.explode(F.sequence(F.floor((F.col("u") + 1) / DEPTHS), F.floor(F.col("v") / DEPTHS))))
    low, high = F.greatest(F.col("u") + 1, F.col("_step") * DEPTHS), F.least(F.col("v"), F.col("_step") * DEPTHS + DEPTHS - 1)
    return stepped.withColumn("depth", F.explode(F.sequence(low, high))).drop("_step")


def nodes(turns: DataFrame, convs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """A row for each node of the trie of conversations (see NODE; the node's turns are the first `depth` ones of conversation conv_id).

    turns: conv_id, pos (from 1, dense), a, b (a name of the turn), words; convs: conv_id, n_turns.
    """
    spark = convs.sparkSession
    tables = tables or Tables(spark)
    turns, convs = tables.write(turns, "trie-turns"), tables.write(convs, "trie-lengths")
    distinct, members = sequences(turns, convs, tables)
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], NODE)
    size = block_rows(count)
    sha = digests(members, distinct, tables)
    st = tables.write(turns.join(distinct.select(F.col("m").alias("conv_id"), "idx"), "conv_id").select("idx", "pos", "a", "b", "words"), "trie-distinct-turns")
    lcp = tables.write(common_prefixes(st).filter((F.col("idx") > 0) & (F.col("idx") < count)), "trie-lcp")
    rows = distinct.join(lcp, "idx", "left").join(lcp.select((F.col("idx") - 1).alias("idx"), F.col("lcp").alias("next")), "idx", "left").join(sha, "idx", "left")
    rows = tables.write(rows.select("idx", "m", "w", "len", F.coalesce("lcp", F.lit(NONE)).alias("lcp"), F.coalesce("next", F.lit(NONE)).alias("next"), F.coalesce("sha", F.sha2(F.col("m").cast("string"), 256)).alias("sha")), "trie-rows")
    nearest, ends, block_m = nearest_smaller(rows, count, size, tables)
    rows = rows.withColumn("leaf", (F.col("next") < F.col("len")).cast("long")).join(ends, "idx").join(nearest.select("idx", F.col("left").alias("of_left")), "idx", "left")
    rows = tables.write(cumulated(rows, "idx", {"w": "cum_w", "leaf": "cum_leaf"}, size), "trie-sums")

    # one node for all positions of a value between the same nearest smaller ones; the ends of sequences; the root
    joined = nearest.groupBy(F.col("left").alias("l"), F.col("lcp").alias("v")).agg((F.max("right") - 1).alias("r"), F.max(F.greatest("left_lcp", "right_lcp")).alias("u"), F.count("*").alias("joins"), F.min("lo").alias("lo"))
    ended = rows.filter(F.col("len") > F.greatest("lcp", "next")).select(F.col("idx").alias("l"), F.col("len").alias("v"), F.col("idx").alias("r"), F.greatest("lcp", "next").alias("u"), F.lit(0).cast("long").alias("joins"), F.col("m").alias("lo"))
    tree = joined.unionByName(ended)
    if nearest.filter("lcp = 0").isEmpty() and rows.filter("idx = 0 AND len = 0").isEmpty():
        tree = tree.unionByName(spark.createDataFrame([(0, 0, count - 1, NONE, 0, None)], "l long, v long, r long, u long, joins long, lo long"))
    tree = tree.withColumn("u", F.when(F.col("v") == 0, NONE).otherwise(F.greatest("u", F.lit(0))))

    def between(l: pa.Array, r: pa.Array) -> pa.Array:
        pairs = zip((l.to_numpy() // size + 1).tolist(), (r.to_numpy() // size).tolist())
        return pa.array([int(block_m[a:b].min()) if a < b else None for a, b in pairs], pa.int64())

    at_l = rows.select(F.col("idx").alias("l"), F.col("lcp").alias("l_lcp"), "of_left", F.col("len").alias("l_len"), "sha", "suf", (F.col("cum_w") - F.col("w")).alias("w_before"), (F.col("cum_leaf") - F.col("leaf")).alias("leaf_before"))
    at_r = rows.select(F.col("idx").alias("r"), "pre", "cum_w", "cum_leaf")
    # an open interval ends with its block, or in another one than it begins in: suf and pre are of its two ends
    ends_block = F.floor(F.col("l") / size) == F.floor(F.col("r") / size)
    least = F.coalesce("lo", F.when(ends_block, F.col("suf")).otherwise(F.least("suf", "pre", F.arrow_udf(between, "long")("l", "r"))))
    tree = tree.join(at_l, "l").join(at_r, "r").select(
        "l", "v", "r", "u", least.alias("conv_id"), (F.col("cum_w") - F.col("w_before")).alias("n_convs"), (F.col("cum_leaf") - F.col("leaf_before")).alias("n_leaves"), (F.col("joins") + (F.col("l_len") > F.col("v")).cast("long")).alias("n_children"),
        F.when(F.col("u") > F.col("l_lcp"), F.col("l")).otherwise(F.col("of_left")).alias("of_l"), F.when(F.col("l_len") == F.col("v"), F.col("sha")).otherwise(F.sha2(F.lit(""), 256)).alias("sha"), "l_len", F.col("sha").alias("l_sha"),
    )
    tree = tables.write(tree, "trie-tree")
    above = tree.select(F.col("l").alias("of_l"), F.col("v").alias("u"), F.col("conv_id").alias("of_conv"))
    filled = tables.write(_filled(tree.join(above, ["of_l", "u"], "left")), "trie-filled")

    # words that a node's conversations share: only nodes of several conversations have any
    shared = filled.filter("n_convs > 1").select("l", "r", "depth", "n_convs").join(st.select(F.col("idx").alias("l"), F.col("pos").alias("depth"), "words"), ["l", "depth"], "left")
    shared = tables.write(shared.select("l", "r", "depth", F.floor(F.col("depth") / DEPTHS).alias("step"), ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("t")), "trie-shared")
    later = Window.partitionBy("l").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = shared.groupBy("l", "step").agg(F.sum("t").alias("t")).select("l", "step", "t", F.coalesce(F.sum("t").over(later), F.lit(0)).alias("after"))
    steps = tables.write(steps, "trie-steps")
    totals = rows.select("idx").join(steps.groupBy(F.col("l").alias("idx")).agg(F.sum("t").alias("t")), "idx", "left").select("idx", F.coalesce("t", F.lit(0)).alias("t"))
    sums = tables.write(cumulated(tables.write(totals, "trie-totals"), "idx", {"t": "cum_t"}, size), "trie-saved")
    within = Window.partitionBy("l", "step").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    saved = shared.select("l", "r", "depth", "step", F.sum("t").over(within).alias("own")).join(steps.select("l", "step", "after"), ["l", "step"])
    saved = saved.join(sums.select(F.col("idx").alias("l"), F.col("cum_t").alias("t_l")), "l").join(sums.select(F.col("idx").alias("r"), F.col("cum_t").alias("t_r")), "r")
    saved = saved.select("l", "depth", (F.col("own") + F.col("after") + F.col("t_r") - F.col("t_l")).alias("saved"))

    inner, last = F.col("depth") < F.col("v"), F.col("depth") == F.col("v")
    out = filled.join(saved, ["l", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("u") + 1, F.col("conv_id")).otherwise(F.col("of_conv"))
    ends_here = F.when(last, F.col("sha")).when(F.col("depth") == F.col("l_len"), F.col("l_sha")).otherwise(F.sha2(F.lit(""), 256))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.when(inner, 1).otherwise(F.col("n_children")).cast("long").alias("n_children"), "n_leaves", F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), ends_here.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The trie's nodes after each conversation c begins with the first crc32(c) % `most` turns of conversation c - c % `family` (the sign of % is c's)."""
    tables = Tables(conversations.sparkSession)
    turns, convs = turns_of(conversations, tables)
    c = F.col("conv_id")
    return nodes(*rebuilt(turns, convs, F.crc32(c.cast("string")) % most, c - c % family, most - 1), tables)
