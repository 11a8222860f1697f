"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are found by three fixed patterns. Further patterns find parts that prove little alone:
identifiers, opaque strings and endpoints. Parts of one text are joined by interval: two parts are
in one scope if the gap between them is at most SCOPE code points. An opaque string is reported
only with an identifier or access id in its scope, an identifier only with a secret, an endpoint only with both;
base spans are always reported.

A regular expression function gives matches without their places, so the text is also split by the
same pattern: places are the running sums of the lengths of what is between and of the matches, both
of which follow the same leftmost matching. All happens within the row: no shuffle, no join of texts. Running sums go by blocks, and
spans look for their partners in blocks that reach into their scope, so that a text with n spans costs n times the root of n.
Null texts count as empty and have no spans; repeated rows give repeated results; spans of one start are in order of kind; an empty table gives an empty result; other columns of
the input are not read, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more: a run is taken whole, so the bound may stand in the pattern
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
OPAQUE = r"[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"(?i:https?|jdbc:[a-z]{2,12}|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:@/?&=%-]{4,}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
#: Code points between two parts of one scope, at most.
SCOPE = 400

SPAN = "array<struct<start:int,rank:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block_size(values: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")


def sums_before(values: Column) -> Column:
    """For each of an array of numbers the sum of those before it, by sums of blocks."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def by_blocks(v: Column, size: Column) -> Column:
        blocks = F.transform(F.filter(F.sequence(F.lit(0), F.size(v)), lambda j: j * size < F.size(v)), lambda j: total(F.slice(v, j * size + 1, size)))
        before = let(blocks, lambda b: F.transform(b, lambda _, j: total(F.slice(b, F.lit(1), j))))
        return let(before, lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / size).cast("int")) + total(F.slice(v, (i - i % size + 1).cast("int"), i % size))))

    return let(values, lambda v: let(block_size(v), lambda size: by_blocks(v, size)))


def found(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (start, rank of the kind, end) of the leftmost matches of pattern that `keep`(index) accepts."""
    rank = KINDS.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = keep(text) if keep else F.transform(whole, lambda _: F.lit(True))
    pairs = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), kept.alias("kept"))

    def placed(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.coalesce(x["gap"], F.lit(0)) + F.coalesce(x["size"], F.lit(0)))
        every = let(sums_before(lengths), lambda at: F.transform(p, lambda x, i: F.struct((F.get(at, i) + x["gap"]).cast("int").alias("start"), F.lit(rank).alias("rank"), (F.get(at, i) + x["gap"] + x["size"]).cast("int").alias("end"), x["kept"].alias("kept"))))
        return F.transform(F.filter(every, lambda x: F.coalesce(x["kept"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    long_value = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    return {"assign": found(text, ASSIGN, "assign", long_value), "access": found(text, ACCESS, "access"), "hex": found(text, HEX, "hex")}


def together(a: Column, b: Column) -> Column:
    """Whether the gap between two spans is at most SCOPE and they are not one within the other's own text."""
    return (a["start"] <= b["end"] + SCOPE) & (b["start"] <= a["end"] + SCOPE) & ((a["end"] <= b["start"]) | (b["end"] <= a["start"]))


def in_blocks(spans: Column) -> Column:
    """Spans in order of start, in blocks with their reach."""

    def cut(s: Column, size: Column) -> Column:
        items = F.transform(F.filter(F.sequence(F.lit(0), F.size(s)), lambda j: j * size < F.size(s)), lambda j: F.slice(s, j * size + 1, size))
        return F.transform(items, lambda b: F.struct(b.alias("spans"), F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end")))

    return let(F.array_sort(spans), lambda s: let(block_size(s), lambda size: cut(s, size)))


def near(x: Column, blocks: Column, test) -> Column:
    """Whether a span of in_blocks within SCOPE of x passes test(x, span)."""
    return F.exists(blocks, lambda b: (b["start"] <= x["end"] + SCOPE) & (x["start"] <= b["end"] + SCOPE) & F.exists(b["spans"], lambda y: test(x, y)))


def linked(weak: Column, *needs: Column) -> Column:
    """Weak spans that share their scope with a span of each of `needs`."""

    def holding(w: Column, blocks: list[Column], rest: tuple[Column, ...]) -> Column:
        if rest:
            return let(in_blocks(rest[0]), lambda b: holding(w, [*blocks, b], rest[1:]))

        def holds(x: Column) -> Column:
            out = F.lit(True)
            for b in blocks:
                out = out & near(x, b, together)
            return out

        return F.filter(w, holds)

    return F.when(F.size(weak) > 0, holding(weak, [], needs)).otherwise(weak)


def rendered(spans: Column) -> Column:
    """kind:start:end of spans in order of start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, spans by kind (arrays of start, rank, end) of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.select("doc_id", text.alias("text"))
    df = df.select("doc_id", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], found(F.col("text"), IDENT, "ident").alias("ident"), found(F.col("text"), OPAQUE, "opaque").alias("opaque_all"), found(F.col("text"), ENDPOINT, "endpoint").alias("endpoint"))
    # a long hex string or assigned value is a base span already
    known = F.concat("assign", "access", "hex")
    apart = let(in_blocks(known), lambda b: F.filter("opaque_all", lambda x: ~near(x, b, lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"]))))
    df = df.withColumn("opaque", F.when(F.size("opaque_all") > 0, apart).otherwise(F.col("opaque_all"))).drop("opaque_all")
    who = F.concat("access", "ident")
    df = df.withColumn("opaque", linked(F.col("opaque"), who))
    secret = F.concat("assign", "hex", "opaque")
    return df.withColumn("endpoint", linked(F.col("endpoint"), who, secret)).withColumn("ident", linked(F.col("ident"), secret))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    df = scan(documents)
    return df.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(rendered(F.concat(*KINDS[:3])), 256).alias("base_sha256"),
        rendered(F.concat(*KINDS)).alias("spans"),
    )
