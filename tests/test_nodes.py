import time
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from galleyworks.functions import extract as X
from galleyworks.functions import nodes as N
from galleyworks.session import BATCH, prepare
from tests.test_archive import values


def parsed(spark, html):
    prepare(spark)
    return spark.createDataFrame([(html,)], "html string").select(N.nodes(F.col("html"))).first()[0]


def shapes(spark, html):
    """(name, what it holds, depth) of every element."""
    return [(n.name, html[n.inner : n.inner_end], n.depth) for n in parsed(spark, html)]


def test_intervals(spark):
    assert parsed(spark, None) is None and parsed(spark, "") == [] and parsed(spark, "a < b & <!-- <p> --> <!doctype html>") == []
    # a p ends where a block begins, also through inline elements; a br holds nothing; what stays open ends with its parent
    assert shapes(spark, "<div><p><b>x<br><p>y</div>z") == [("div", "<p><b>x<br><p>y", 0), ("p", "<b>x<br>", 1), ("b", "x<br>", 2), ("br", "", 3), ("p", "y", 1)]
    assert shapes(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", "<li>a<li>b<ul><li>c</ul><li>d", 0), ("li", "a", 1), ("li", "b<ul><li>c</ul>", 1), ("ul", "<li>c", 2), ("li", "c", 3), ("li", "d", 1)]
    # ends without a beginning are passed over; an inline end does not leave its block
    assert shapes(spark, "</p><b><div>x</b>y</div></b></i>z") == [("b", "<div>x</b>y</div>", 0), ("div", "x</b>y", 1)]
    # tags in scripts and titles are none; an element that is never closed reaches to the end
    assert shapes(spark, "<title>a<b></TITLE ><script>'</p><p>'</script><x-y/>é<SECTION>q") == [("title", "a<b>", 0), ("script", "'</p><p>'", 0), ("x-y", "", 0), ("section", "q", 0)]
    n = parsed(spark, "<a  CLASS='p \"q' title=\"x > y\" hidden href=/z?a=1&amp;b id=one id=two>t")[0]
    assert (n.attributes, n.start, n.parent) == ({"class": 'p "q', "title": "x > y", "hidden": "", "href": "/z?a=1&b", "id": "two"}, 0, -1)
    assert [n.tag for n in parsed(spark, "<p title='never closed>x<b>y</b>")] == ["<p title='never closed>", "<b>"]


def test_counts(spark):
    got = parsed(spark, "<div>a<p>&nbsp; </p><noscript><img>n</noscript><section><img><i>b</i></section><mp-style-type>w</mp-style-type></div>")
    assert [(n.name, n.texts, n.media) for n in got if n.name not in ("i", "mp-style-type")] == [("div", 2, 1), ("p", 0, 0), ("noscript", 0, 0), ("img", 0, 0), ("section", 1, 1), ("img", 0, 1)]


def test_selectors(spark):
    html = "<article id=1></article><main><div><article id=2 class='a bb'></article></div></main><main><article id=3 class='b'></article></main><p itemprop=articleBody id=4>"
    df = spark.createDataFrame([(html,)], "html string").select(N.nodes(F.col("html")).alias("n"))
    ids = lambda s: [r.attributes["id"] for r in df.select(N.select(F.col("n"), s)).first()[0]]
    assert [ids(s) for s in ("article", "main article", ".b", ".bb", "#3", "[itemprop=articleBody]", "main div article", "nav article")] == [["1", "2", "3"], ["2", "3"], ["3"], ["2"], ["3"], ["4"], ["2"], []]
    assert df.select(N.select_one(F.col("n"), "nav")).first()[0] is None


def cleaned(spark, html):
    return values(spark, lambda c: N.cleaned(c, F.lit("http://h/p/x")), [html])[0]


def test_clean_up(spark):
    prepare(spark)
    # nested widgets go whole; a > within an attribute ends no tag; comments stay
    assert cleaned(spark, '<p>a<mp-sponsor-ad>1<mp-sponsor-ad>2</mp-sponsor-ad>3</mp-sponsor-ad></p><p title="x > y" hidden>b</p><!-- <p></p> -->') == '<p>a</p><p title="x > y">b</p><!-- <p></p> -->'
    # what holds only a widget or a script is empty; a block in an empty block goes with it; pictures keep theirs
    assert cleaned(spark, "<div><section><mp-style-type>x</mp-style-type></section><p><script>x</script></p><div><div>&#160;</div></div>k</div><section><p><video></video></p></section>") == "<div>k</div><section><p><video></video></p></section>"
    # unwrapped links keep what they hold, with its own edits; a link in a removed block is passed over
    assert cleaned(spark, "<a class='y weapp_image_link'><img src=i.png alt=q loading=eager></a><p><a href=z></a></p><a name=n>m</a>") == '<img src="http://h/p/i.png" alt="q" loading="eager"/><a name=n>m</a>'
    assert cleaned(spark, "") == "" and cleaned(spark, None) is None and cleaned(spark, "no markup & none") == "no markup & none"


def test_articles_by_nodes(spark):
    prepare(spark)
    rows = [("https://a.com/x", h, i, "t") for i, h in enumerate([None, "", "<article>" + "long " * 20, f"<main><p>x</p></main><main><article hidden>{'word ' * 20}</article></main>", f"<article><p>{'𝄞é ' * 40}<p></p><p>end</article>tail"])]
    df = spark.createDataFrame(rows, "url string, html string, _nodes int, title string")  # names that clash with inner and made columns
    got = sorted(X.articles(df).collect(), key=lambda r: r._nodes)
    assert [r.success for r in got] == [False, False, True, True, True] and [r.title for r in got] == [X.UNTITLED] * 5
    assert got[3].content_html == f"<article>{'word ' * 20}</article>"
    assert got[4].content_html == f"<article><p>{'𝄞é ' * 40}<p>end</article>" and got[4].content_text.endswith("é end")


def test_long_and_hostile_pages(spark):
    prepare(spark)
    began = time.perf_counter()
    deep, wide, quotes = "<div>" * 20_000 + "x", "<p>a" * 200_000, "<a '" * 20_000
    assert len(parsed(spark, deep)) == 20_000 and len(parsed(spark, wide)) == 200_000 and parsed(spark, quotes) is not None
    assert cleaned(spark, "<section>" * 3000 + "</section>" * 3000) == ""
    assert time.perf_counter() - began < 60


def test_batches_are_cut_by_bytes_and_rows():
    pages = ["<p>a</p>"] * 1200 + [None, "", "<b>" + "x" * 2 * N.PIECE + "</b>", "<i>y</i>"]
    column = pa.array(pages, pa.string())
    cut = list(N.pieces(column))
    assert [i for p in cut for i in range(p.start, p.stop)] == list(range(len(pages))) and list(N.pieces(column[:0])) == []
    assert all(p.stop - p.start <= N.PIECE_ROWS and (p.stop - p.start == 1 or pc.sum(pc.binary_length(column[p])).as_py() <= N.PIECE) for p in cut)
    made = list(N._parsed_batches(iter([column, column[:1]])))
    assert len(made) == len(cut) + 1 and pa.concat_arrays(made[:-1]).equals(N._parsed_column(column))


def test_what_a_worker_holds_does_not_grow_with_its_batch():
    """Both steps of without_empty_blocks, over a full batch of Spark's and one a tenth as long."""
    page, empty = "<div><section><div> <p>&nbsp;</p></div></section><p>x</p><p><b> </b></p></div>", [{"start": 5, "end": 49, "text": ""}, {"start": 57, "end": 72, "text": ""}]

    def peak(step, columns):
        tracemalloc.start()
        try:
            rows = sum(len(made) for made in step(iter([columns])))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    for step, of in ((N._parsed_batches, lambda n: pa.array([page] * n)), (N._edited_batches, lambda n: tuple(pa.array([v] * n) for v in (page, 0, len(page), empty, empty[:1])))):
        (few, small), (many, large) = peak(step, of(1_000)), peak(step, of(10_000))
        assert (few, many) == (1_000, 10_000) and large < 2 * small
    columns = tuple(pa.array([v] * 1_200) for v in (page, 0, len(page), empty, empty[:1]))
    made = list(N._edited_batches(iter([columns])))
    assert pa.concat_arrays(made).equals(N._edited_columns(*columns)) and "".join(x["html"] for x in made[-1][-1].as_py()) == "<div><p>x</p></div>"


def test_workers_get_small_batches_of_pages(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    page = F.concat(F.lit("<article><p>"), F.repeat(F.lit("long text "), 10_000), F.col("id").cast("string"), F.lit("</p></article>"))
    pages = spark.range(200, numPartitions=1).select("id", F.lit("https://h.example/a").alias("url"), page.alias("html"))
    try:
        made = X.articles(pages).select("id", "html", "content_text")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

        got = made.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 200 and max(r.bytes for r in got) < BATCH + 1_000_000
        assert {r.n for r in made.select(F.length("content_text").alias("n")).collect()} <= {100_001, 100_002, 100_003}
    finally:
        spark.conf.unset(limit)
