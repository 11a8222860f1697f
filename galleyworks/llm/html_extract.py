"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of elements (tag, class, id and role, place among such siblings, below the same
elements). A first pass over all pages gives, for every element, on how many distinct pages it has each presentation
(its row of child elements) and each content (its own text, digits masked unless they are most of it). From these come importances: an element that looks
the same wherever it occurs has a low presentation importance, a text that comes again and again a low content
importance (entropies to the base of the number of pages). The importance of a branch joins its own with
that of the branches below, level by level from the leaves up. A second pass parses each page again and removes branches of low importance.

Marks move an importance before it is held against LEAST_IMPORTANCE: being inside an article raises it, being outside on a page that has one lowers it, and so does a class of which
some words are those of boilerplate, or, inside an article, all of them. Elements of fewer than LEAST_PAGES pages have no importance of their own, and what is not certain stays: they get UNKNOWN, which all marks
together do not bring under LEAST_IMPORTANCE, as they shift by LEAST_SHIFT at most. Beyond
the tree, whatever their importance, go: elements that by tag or role are no text of an article (navigation, footers, forms, hidden ones), and
those of a class or id all of whose words name boilerplate, unless the article is in them; inside an article only those of which a word is in ALWAYS (adverts and reader comments differ on every page, so that no entropy can tell them from text).

Only numbers leave the first pass. The importances of a host's elements form one list, which reaches the pages by a broadcast if all lists together
are small and otherwise by a join on the host and a salt, so that a host of very many pages is dealt over SALTS tasks.

Null and empty html give an empty text; broken markup is read as far as it goes; copies of a page count once in the tree and are
treated alike, as are repeated rows; ties do not arise; null urls are one host; an empty table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyworks.llm.scratch import materialise

GAMMA, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.3, 3
#: Importance of elements that too few pages have; what marks add: inside an article, outside of the page's article, a class that partly names boilerplate.
UNKNOWN, INSIDE, OUTSIDE, PARTLY, LEAST_SHIFT = 1.0, 0.25, -0.45, -0.5, -0.6
#: Siblings alike that have a place of their own, at each end; depth below which elements count as their ancestor.
EDGE, DEEPEST = 2, 48
#: Bytes of all hosts' lists up to which they are broadcast; parts in which a host's pages are dealt otherwise.
SMALL, SALTS = 32 << 20, 64

# Groups of tags, roles and words in classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg canvas select option audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul button".split()
)
DROPPED = frozenset("head nav footer aside form dialog menu button search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NOISE = frozenset(
    "nav navbar navigation menu submenu topbar breadcrumb breadcrumbs sidebar sidenav widget widgets footer masthead ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing sharebar social related recommended recommendations pagination pager skip toolbar copyright disclaimer".split()
)
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments commentlist disqus respond replies".split())
HEADERS = frozenset("header".split())
#: Words that say nothing about what is in a class or id.
PLAIN = frozenset("box block container wrapper wrap inner outer content section area item items list row col column top bottom left right middle center first last main site page global large small mobile desktop js is has the for and of on in".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']+|"[^"<]*"|'[^'<]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|["'])*+)(?:>|(?=<)|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_WORDS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"})}
_ENDS: dict[str, re.Pattern] = {}
_keys: dict[tuple, int] = {}


def key_of(above: int, tag: str, signature: str) -> int:
    """A 63-bit name of the element below `above`."""
    k = (above, tag, signature)
    if (found := _keys.get(k)) is None:
        if len(_keys) > 200_000:
            _keys.clear()
        found = _keys[k] = xxhash.xxh64_intdigest(f"{above}/{tag}{signature}") >> 1
    return found


class Page:
    """The block elements of a page in order (tag, signature, parent, marks) and its blocks of text (element, text)."""

    __slots__ = ("tag", "signature", "up", "noise", "main", "head", "blocks")

    def __init__(self, html: str):
        self.tag, self.signature, self.up, self.noise, self.main, self.head = ["#page"], [""], [-1], [0], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block element that they are, or are in
        words: list[str] = []
        at, n = 0, len(html)

        def flush() -> None:
            if words:
                text = " ".join(entities.unescape("".join(words)).split())
                words.clear()
                if text:
                    self.blocks.append((stack[-1][1], text))

        def close(to: int) -> None:
            flush()
            del stack[to:]

        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                words.append(html[at:])
                break
            if m.start() > at:
                words.append(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "p" and not any(t == "p" for t, _ in stack):
                    flush()
                elif name in ("body", "html"):
                    flush()
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            close(i) if name in BLOCK or any(t in BLOCK for t, _ in stack[i + 1 :]) else stack.pop(i)
                            break
                continue
            if name in RAW:
                if name not in _ENDS:
                    _ENDS[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
                end = _ENDS[name].search(html, at) if not html.startswith("/>", at - 2) or name in ("script", "style") else None
                at = end.end() if end else (n if name in ("script", "style", "template", "textarea", "title", "noscript") else at)
                words.append(" ")
                continue
            if name == "body" and any(t == "head" for t, _ in stack):
                close(1)
            if name in VOID or name not in BLOCK:
                if name == "br":
                    words.append(" ")
                elif name == "hr":
                    flush()
                elif name not in VOID:
                    stack.append((name, stack[-1][1]))
                continue
            if name in ("html", "body"):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            if name in _CLOSES:
                ends, bounds = _CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in ends:
                        close(i)
                        break
            flush()
            stack.append((name, self._open(name, m[3], stack[-1][1])))
        flush()

    def _open(self, name: str, attributes: str, above: int) -> int:
        signature, noise, main, hidden, whole, part = "", 0, name in ("article", "main"), False, False, False
        inside = self.main[above]
        if "=" in attributes or "hidden" in attributes:
            for k, a, b, c, bare in _ATTRIBUTE.findall(attributes):
                k, v = (k or bare).lower(), (a or b or c).lower()
                if k in ("class", "id"):
                    signature += f" {k}={_DIGITS.sub('0', v)}"
                    for label in v.split():
                        words = [w for w in _WORDS.findall(label) if not w.isdigit()]
                        bad = [w in NOISE or (w in HEADERS and not inside) for w in words]
                        if any(bad):
                            whole |= all(n or w in PLAIN for n, w in zip(bad, words, strict=True)) and (not inside or not ALWAYS.isdisjoint(words))
                            part = True
                elif k == "role":
                    signature += f" role={v}"
                    noise |= 2 * (v in ROLES)
                    main |= v in ("main", "article")
                elif k == "itemprop":
                    main |= v == "articlebody"
                elif (k == "hidden") or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", "")):
                    hidden = True
            noise |= 1 if whole else 4 if part else 0
        if name in DROPPED or (name == "header" and not inside) or hidden:
            noise |= 2 if name != "form" else 1
        self.tag.append(name)
        self.signature.append(signature)
        self.up.append(above)
        self.noise.append(noise)
        self.main.append(main or inside)
        self.head.append(name == "h1" or (main and not noise))
        return len(self.tag) - 1

    def held(self) -> list[bool]:
        """Which elements have a headline or the article below."""
        out = list(self.head)
        for i in range(len(out) - 1, 0, -1):
            if out[i] and not self.noise[i] & 2:
                out[self.up[i]] = True
        return out

    def keys(self, host: int) -> tuple[list[int], list[int]]:
        """Name of each element in its host's tree, and its depth there."""
        alike: dict[tuple, list[int]] = {}
        for i in range(1, len(self.tag)):
            alike.setdefault((self.up[i], self.tag[i], self.signature[i]), []).append(i)
        place = [""] * len(self.tag)
        for row in alike.values():
            for k, i in enumerate(row):
                place[i] = f"#{k}" if k < EDGE else f"#-{len(row) - k}" if len(row) - k <= EDGE else "#"
        key, depth = [host], [0]
        for i in range(1, len(self.tag)):
            above = self.up[i]
            deep = depth[above] >= DEEPEST
            key.append(key[above] if deep else key_of(key[above], self.tag[i], self.signature[i] + place[i]))
            depth.append(depth[above] + (not deep))
        return key, depth

    def features(self, host: int, page: int) -> set[tuple[int, int, int, int]]:
        """(element, kind, feature, page): kind 0 a presentation, 1 a content, 2 the element above (page: depth), 3 the host (page: 0)."""
        key, depth = self.keys(host)
        children: dict[int, list[int]] = {}
        gone = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            gone[i] = gone[self.up[i]] or bool(self.noise[i] & 2)
            row = children.setdefault(self.up[i], [])
            if not row or row[-1] != key[i]:
                row.append(key[i])
        own: dict[int, list[str]] = {}
        for i, t in self.blocks:
            own.setdefault(i, []).append(t)
        out: set[tuple[int, int, int, int]] = set()
        for i in range(1, len(self.tag)):
            if gone[i]:
                continue
            out.add((key[i], 2, key[self.up[i]], depth[i]))
            out.add((key[i], 3, host, 0))
            if i in children:
                out.add((key[i], 0, xxhash.xxh64_intdigest(repr(children[i])) >> 1, page))
            if i in own:
                out.add((key[i], 1, xxhash.xxh64_intdigest(masked(" ".join(own[i]))) >> 1, page))
        return out

    def text(self, host: int = 0, importances: dict[int, float] | None = None) -> str:
        """The blocks of the branches that stay."""
        held, known = self.held(), importances or {}
        key = self.keys(host)[0] if known else [0] * len(self.tag)
        has_main = any(m and not n & 3 for m, n in zip(self.main, self.noise, strict=True))
        kept = [True] * len(self.tag)
        for i in range(1, len(self.tag)):
            weight = known.get(key[i], UNKNOWN) + max(LEAST_SHIFT, PARTLY * bool(self.noise[i] & 4) + (INSIDE if self.main[i] else OUTSIDE if has_main else 0))
            weak = self.noise[i] & 1 or weight < LEAST_IMPORTANCE
            kept[i] = kept[self.up[i]] and not self.noise[i] & 2 and not (weak and not held[i])
        # text that no block element holds is outside of any article
        kept[0] = not has_main
        return "\n".join(t for i, t in self.blocks if kept[i])


def masked(text: str) -> str:
    """Text with its digits masked: counts and years do not make notices different. What is digits for the most part is its digits."""
    return _DIGITS.sub("0", text) if 2 * sum(map(len, _DIGITS.findall(text))) <= len(text) else text


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[tuple[int, int, int, int]] = set()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            seen |= Page(html).features(host, xxhash.xxh64_intdigest(html) >> 1)
        columns = list(zip(*seen, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["element", "kind", "feature", "page"])


def importances(pages: DataFrame) -> DataFrame:
    """host, element, importance of every element that LEAST_PAGES distinct pages have; pages: host, html."""
    seen = materialise(pages.mapInArrow(_features, "element long, kind int, feature long, page long").distinct(), "style-features")
    counts = seen.filter("kind < 2").groupBy("element", "kind", "feature").agg(F.count("*").alias("n"))
    by_kind = counts.groupBy("element", "kind").agg(F.sum("n").alias("m"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("spread"))
    # entropy of the features to the base m
    own = F.when(F.col("m") > 1, 1 - F.col("spread") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    nodes = by_kind.groupBy("element").agg(of(0, own).alias("look"), of(0, F.col("styles")).alias("styles"), of(1, own).alias("content"), F.max("m").alias("m"))
    places = seen.filter("kind >= 2").groupBy("element").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(n) for k, c, n in ((2, "feature", "above"), (2, "page", "depth"), (3, "feature", "host"))])
    nodes = materialise(nodes.filter(F.col("m") >= LEAST_PAGES).join(places, "element"), "style-nodes")
    below, levels = None, []
    for depth in range(int(nodes.agg(F.max("depth")).first()[0] or 0), 0, -1):
        level = nodes.filter(F.col("depth") == depth)
        level = level.join(below, level["element"] == below["up"], "left") if below is not None else level.withColumn("deep", F.lit(None).cast("double"))
        share = F.pow(F.lit(GAMMA), F.least("styles", F.lit(64)))
        branch = (1 - share) * F.col("look") + share * F.coalesce("deep", "look")
        level = materialise(level.select("host", "element", "above", "m", F.greatest(branch, F.col("content")).alias("importance")), "style-level")
        levels.append(level)
        below = level.groupBy(F.col("above").alias("up")).agg((F.sum(F.col("importance") * F.col("m")) / F.sum("m")).alias("deep"))
    out = nodes.select("host", "element", F.lit(0.0).alias("importance")).filter("false")
    for level in levels:
        out = out.unionByName(level.select("host", "element", "importance"))
    return out


def style_trees(pages: DataFrame) -> DataFrame:
    """host, elements, weights (importances in hundredths): a row for each host that has any; pages: host, html."""
    lists = importances(pages).groupBy("host").agg(F.collect_list(F.struct("element", F.floor(F.col("importance") * 100).cast("int").alias("weight"))).alias("all"))
    return materialise(lists.select("host", F.col("all.element").alias("elements"), F.col("all.weight").alias("weights")), "style-trees")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, dict[int, float]] = {}
    for batch in batches:
        out = []
        hosts, html = batch.column("host").to_pylist(), batch.column("html").to_pylist()
        for i, (host, page) in enumerate(zip(hosts, html, strict=True)):
            if host not in known:
                if len(known) > 100:
                    known.clear()
                elements, weights = batch.column("elements")[i].as_py(), batch.column("weights")[i].as_py()
                known[host] = {e: w / 100 for e, w in zip(elements or (), weights or (), strict=True)}
            out.append(Page(page).text(host, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    url = F.col("url").cast("string")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.abs(F.xxhash64(host_of(url))).alias("host"))
    trees = style_trees(pages.select("host", "html"))
    size = trees.agg(F.sum(F.size("elements") * 12 + 32)).first()[0] or 0
    if size <= SMALL:
        joined = pages.join(F.broadcast(trees), "host", "left")
    else:
        salted = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "host", "elements", "weights").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
