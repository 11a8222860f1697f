"""A page as a table of its elements: one parse gives every element's interval; selection, clean-up and children are queries on the intervals."""

from __future__ import annotations

import html as hypertext
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from galleyworks.functions import markup as M
from galleyworks.session import small_batches

# Names of elements by the rules of HTML, and those that a clean-up removes or looks for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TEXT = frozenset(("script", "style", "title", "textarea"))
UNSEEN = frozenset(("script", "style", "noscript", *M.WIDGETS))
MEDIA = frozenset(("img", "video", "iframe"))
EMPTIED = ("section", "p", "div")
#: Elements that the opening of another ends, if nothing but inline elements is open within them; a p is ended by every block.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}

_TOKEN = re.compile(r"""(?s)<!--.*?-->|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>""")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

NODES = "array<struct<name:string,tag:string,attributes:map<string,string>,start:int,inner:int,inner_end:int,end:int,depth:int,parent:int,texts:int,media:int>>"
_INTS = ("start", "inner", "inner_end", "end", "depth", "parent", "texts", "media")
_NODES = pa.list_(pa.struct([("name", pa.string()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), *((n, pa.int32()) for n in _INTS)]))
PARTS = "array<struct<html:string,nth:int>>"
_PARTS = pa.list_(pa.struct([("html", pa.string()), ("nth", pa.int32())]))
#: Bytes of markup of which a worker holds the elements as Python's objects at once, and rows of them; a longer page is alone.
PIECE, PIECE_ROWS = 1 << 20, 512


def _attributes(inside: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(inside):
        value = m[2] or ""
        found[m[1].lower()] = hypertext.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def _ends(opened: str, name: str) -> bool:
    """Whether the opening of `name` ends an open element."""
    return name in BLOCKS if opened == "p" else name in ENDED_BY.get(opened, ())


def _parsed(html: str) -> list[dict]:
    nodes, open_, texts, media, unseen, at = [], [], 0, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal texts
        texts += not unseen and bool(hypertext.unescape(piece).strip())

    def close(to: int, inner_end: int, end: int) -> None:
        """The open elements from place `to` end; only that one has a closing tag of its own."""
        nonlocal unseen
        while len(open_) > to:
            i = open_.pop()
            n = nodes[i]
            n |= {"inner_end": inner_end, "end": inner_end if len(open_) > to else end, "texts": texts - n["texts"], "media": media - n["media"]}
            unseen -= n["name"] in UNSEEN

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            for place in range(len(open_) - 1, -1, -1):
                opened = nodes[open_[place]]["name"]
                if opened == name:
                    close(place, m.start(), at)
                    break
                if opened in BLOCKS and name not in BLOCKS:  # an inline element's end does not reach out of a block
                    break
            continue
        for place in range(len(open_) - 1, -1, -1):
            opened = nodes[open_[place]]["name"]
            if _ends(opened, name):
                close(place, m.start(), m.start())
                break
            if opened in BLOCKS:
                break
        node = {"name": name, "tag": m[0], "attributes": _attributes(m[3]), "start": m.start(), "inner": at, "depth": len(open_), "parent": open_[-1] if open_ else -1, "texts": texts, "media": media}
        nodes.append(node)
        media += not unseen and name in MEDIA
        open_.append(len(nodes) - 1)
        unseen += name in UNSEEN
        if name in VOID or m[0].endswith("/>"):
            close(len(open_) - 1, at, at)
        elif name in RAW_TEXT:
            end = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>").search(html, at)
            to, at_end = (end.start(), end.end()) if end else (len(html), len(html))
            text(html[at:to])
            close(len(open_) - 1, to, at_end)
            at = at_end
    text(html[at:])
    close(0, len(html), len(html))
    return nodes


def nodes(html: Column) -> Column:
    """The elements of a page in the order of their opening tags: name (lower case), tag (the opening one), attributes (decoded, the last of a name wins), start and end of the element, inner and
    inner_end of what it holds (code points from 0), depth, parent (place in the array, -1 at the top), texts (text pieces in it that are not blank) and media (pictures, videos and frames in it, itself included).

    Scripts, styles, noscripts and widgets count no text or media. An element that is never closed ends where its parent does; a p ends where a block begins, list items and cells where the next does; closing tags without an
    opening one are passed over. Null for null, an empty array for a page without elements. One pass over the page; the work grows with its length, times the depth of what stays open where tags are wrongly nested.
    """
    return F.arrow_udf(_parsed_batches, NODES)(html)


def with_nodes(df: DataFrame, html: str, name: str) -> DataFrame:
    """df with the elements of a column's pages; later steps can mention them often, they are made once."""
    return _added(df, (html,), name, NODES, _parsed_column)


def _parsed_column(column: pa.Array) -> pa.Array:
    typed = lambda n: n | {"attributes": list(n["attributes"].items())}
    return pa.array([None if h is None else [typed(n) for n in _parsed(h)] for h in column.to_pylist()], _NODES)


def pieces(markup: pa.Array) -> Iterator[slice]:
    """A batch's rows in pieces that bound what is made of each, whatever the number and the length of its pages."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(markup).to_pylist()):
        if i > start and (held + (n or 0) > PIECE or i - start == PIECE_ROWS):
            yield slice(start, i)
            start, held = i, 0
        held += n or 0
    if start < len(markup):
        yield slice(start, len(markup))


def _parsed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        for p in pieces(column):
            yield _parsed_column(column[p])


def _added(df: DataFrame, inputs: tuple[str, ...], name: str, kind: str, make: Callable[..., pa.Array]) -> DataFrame:
    """df with a column that `make` makes of the input columns' arrays, the first of which is markup; piece by piece, of small batches."""
    small_batches(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(inputs[0])):
                own = batch[p]
                made = make(*[own.column(n) for n in inputs])
                yield pa.RecordBatch.from_arrays([*own.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def inside(html: Column, node: Column) -> Column:
    """What an element holds."""
    return F.substring(html, node["inner"] + 1, node["inner_end"] - node["inner"])


def matches(node: Column, step: str) -> Column:
    """Whether an element is one that a step of a selector means: a name, .class, #id or [attribute=value]."""
    value = lambda name: F.coalesce(node["attributes"][name], F.lit(""))
    if step.startswith("."):
        return F.array_contains(F.split(value("class"), r"\s+"), step[1:])
    if step.startswith("#"):
        return value("id") == step[1:]
    if step.startswith("["):
        name, word = step[1:-1].split("=")
        return value(name) == word
    return node["name"] == step


def select(found: Column, selector: str) -> Column:
    """Elements that a selector means, in their order; of several steps, each lies anywhere within one that the step before it means."""
    *outer, last = selector.split(" ")
    own = lambda n: matches(n, last)
    if not outer:
        return F.filter(found, own)
    within = lambda n, o: (o["start"] < n["start"]) & (n["end"] <= o["end"])
    return M.let(select(found, " ".join(outer)), lambda around: F.filter(found, lambda n: own(n) & F.exists(around, lambda o: within(n, o))))


def select_one(found: Column, selector: str) -> Column:
    """The first element that a selector means, or null."""
    return F.try_element_at(select(found, selector), F.lit(1))


def meta_content(found: Column, *selectors: tuple[str, str]) -> Column:
    return M.first_content(F.transform(F.filter(found, lambda n: n["name"] == "meta"), lambda n: n["attributes"]), *selectors)


def is_empty_block(node: Column) -> Column:
    return node["name"].isin(*EMPTIED) & (node["texts"] == 0) & (node["media"] == 0)


def _edit(start: Column, end: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def _rewritten(node: Column, base: Column) -> Column:
    """The edits that clean an element: none, one of its opening tag or of all of it, or of both of its tags."""
    values = node["attributes"]
    none = F.create_map().cast("map<string,string>")
    shown = lambda v: F.map_filter(v, lambda k, _: k != "hidden")
    image = lambda v: F.map_concat(v, F.when(M.image_source(v).isNotNull(), F.create_map(F.lit("src"), M.joined_url(base, M.image_source(v)))).otherwise(none))
    image_tag = M.let(M.let(shown(values), image), lambda v: M.opening_tag("img", M.image_attributes(v), "/"))
    link_tag = M.let(shown(values), lambda v: M.opening_tag("a", F.map_concat(v, F.create_map(F.lit("href"), M.joined_url(base, v["href"])))))
    opened = lambda text: F.array(_edit(node["start"], node["inner"], text))
    wrapper = (node["name"] == "a") & F.arrays_overlap(F.split(F.coalesce(values["class"], F.lit("")), r"\s+"), F.array(*[F.lit(c) for c in M.LINK_CLASSES.split("|")]))
    return (
        F.when(node["name"].isin(*sorted(UNSEEN)) | is_empty_block(node), F.array(_edit(node["start"], node["end"], "")))
        .when(wrapper, F.array(_edit(node["start"], node["inner"], ""), _edit(node["inner_end"], node["end"], "")))
        .when(node["name"] == "img", opened(image_tag))
        .when((node["name"] == "a") & F.map_contains_key(values, "href"), opened(link_tag))
        .when(F.map_contains_key(values, "hidden"), opened(M.shown(node["tag"])))
        .otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
    )


def _within(found: Column, start: Column, end: Column) -> Column:
    return F.filter(found, lambda n: (n["start"] >= start) & (n["end"] <= end))


def cleaning(found: Column, base: Column, start: Column, end: Column) -> Column:
    """Edits that clean what lies between two places: scripts, styles, noscripts, widgets and blocks without text and media go, links that wrap mini-programs are unwrapped, nothing is hidden, images are completed, addresses absolute."""
    return F.array_sort(F.flatten(F.transform(_within(found, start, end), lambda n: _rewritten(n, base))))


def emptying(found: Column, start: Column, end: Column) -> Column:
    """Edits that remove the blocks without text and media."""
    return F.transform(F.filter(_within(found, start, end), is_empty_block), lambda n: _edit(n["start"], n["end"], ""))


def _edited(html: str, start: int, end: int, edits: list[dict], tops: list[dict]) -> list[dict]:
    out, edit = [], iter(edits)
    e = next(edit, None)

    def piece(at: int, to: int) -> str:
        nonlocal e
        made = []
        while e is not None and e["start"] < to:
            if e["start"] >= at:  # else it lies in what is gone
                made += (html[at : e["start"]], e["text"])
                at = e["end"]
            e = next(edit, None)
        return "".join((*made, html[at:to]))

    for nth, top in enumerate(tops):
        out.append({"html": piece(start, top["start"]), "nth": None})
        out.append({"html": piece(top["start"], top["end"]), "nth": nth})
        start = top["end"]
    out.append({"html": piece(start, end), "nth": None})
    return [x for x in out if x["html"]]


def edited(html: Column, start: Column, end: Column, edits: Column, tops: Column) -> Column:
    """The markup between two places after edits (start, end, text; in order; those within one that removes their place are passed over), as the elements `tops` (start, end; in order, none within another) with their
    numbers `nth` and what stands between them (nth null). Null if any argument is; what is left empty is no part."""
    return F.arrow_udf(_edited_batches, PARTS)(html, start, end, edits, spans(tops))


def with_edited(df: DataFrame, columns: tuple[str, str, str, str, str], name: str) -> DataFrame:
    """df with the parts that `edited` makes of five of its columns, the last one by `spans`."""
    return _added(df, columns, name, PARTS, _edited_columns)


def spans(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: F.struct(n["start"].alias("start"), n["end"].alias("end")))


def _edited_columns(*columns: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return pa.array([None if any(v is None for v in row) else _edited(*row) for row in rows], _PARTS)


def _edited_batches(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in batches:
        for p in pieces(columns[0]):
            yield _edited_columns(*[c[p] for c in columns])


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["html"]), "")


def cleaned(html: Column, base: Column) -> Column:
    """A whole piece of markup, cleaned (see `cleaning`)."""
    found, end = nodes(html), F.length(html)
    return joined(edited(html, F.lit(0), end, cleaning(found, base, F.lit(0), end), F.filter(found, lambda n: n["depth"] < 0)))


def without_empty_blocks(html: Column) -> Column:
    """html without sections, paragraphs and divisions that hold neither text nor a picture, video or frame; also those that become empty by it."""
    found, end = nodes(html), F.length(html)
    return joined(edited(html, F.lit(0), end, emptying(found, F.lit(0), end), F.filter(found, lambda n: n["depth"] < 0)))
