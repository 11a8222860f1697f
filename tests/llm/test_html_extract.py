import math
import re
from collections import Counter

from llm_cases import clashing

from galleyworks.llm import html_extract
from galleyworks.llm.html_extract import Page

WORDS = lambda i, n=40: " ".join(f"w{(i * 7919 + k * k) % 10007}" for k in range(n))


def extracted(spark, bodies, host="a.com", more=()):
    rows = [(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)] + list(more)
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_one_page():
    page = Page("<nav>m</nav><article><h1>T &amp; u</h1><p>a <b>b</b>\n c<p>d<br>e</p><div class=ad>x</div><form>f</form></article><div class=comments><p>c</p></div><script>'</p>'</script><footer>z")
    assert page.text() == "T & u\na b c\nd e"
    assert Page("<div class='ad-box'>x</div><div class='social-history'><p>y</p></div><p>z <math>1</math></p>").text() == "y\nz 1"  # what is not certain stays
    assert Page("<p>" + "long " * 200_000 + "</p>").text() == ("long " * 200_000).strip()
    assert Page("<div>" * 3000 + "deep" + "</div>" * 3000).text() == "deep"


def test_unmarked_boilerplate_goes_and_text_in_odd_classes_stays(spark):
    """The tree decides where nothing is marked: repeated branches go, those that differ stay, whatever their class partly says."""
    body = lambda i: f"<div>Welcome to our site since {1990 + i}</div><div class='social-history'><p>{WORDS(i)}</p><p>more {WORDS(i + 500, 9)}</p></div><div><p>All rights kept</p></div>"
    got = extracted(spark, [body(i) for i in range(30)], more=[(100, None, None), (101, "", ""), (102, "http://b.com/", body(7)), (102, "http://b.com/", body(7))])
    assert got[100] == got[101] == ""
    for i in range(30):
        assert got[i] == f"{WORDS(i)}\nmore {WORDS(i + 500, 9)}"
    # one page alone has no tree: what is not certain stays
    assert got[102] == f"Welcome to our site since 1997\n{WORDS(7)}\nmore {WORDS(507, 9)}\nAll rights kept"


def test_small_hosts_keep_their_stories(spark):
    """The story stays on hosts of any size, and what all pages share goes from three pages on."""
    body = lambda i: f"<div>Welcome to our site</div><div class='social-history'><p>{WORDS(i)}</p></div><article><p>{WORDS(i + 50)}</p></article>"
    for n in (1, 2, 3, 4, 9):
        got = extracted(spark, [body(i) for i in range(n)], host=f"h{n}.com")
        for i in range(n):
            story = f"{WORDS(i)}\n{WORDS(i + 50)}"
            assert got[i] in (story, f"Welcome to our site\n{story}") and (n < 3 or got[i] == story)


def test_words_for_boilerplate_inside_an_article():
    """Share, related and alert can be what an article is about; adverts and comments cannot."""
    page = Page("<article><p>a</p><div class=share><p>Market share rose</p></div><div class=related><p>b</p></div><section id=alert><p>c</p></section><div class='ad box'>x</div><div class=comments><p>y</p></div></article><div class=share><p>z</p></div>")
    assert page.text() == "a\nMarket share rose\nb\nc"


def test_removal_equals_a_plain_tree(spark):
    """Which blocks of a small host stay, from importances of whole paths."""
    bodies = [f"<article><div class=x><p>{WORDS(i)}</p><p>Read more about this every day</p></div></article><div class=t><p>{'Same words here' if i % 2 else 'Other words here'}</p></div><div class=u><p>{WORDS(i + 30)}</p></div>" for i in range(12)]
    texts = {}
    for b in bodies:
        for path, t in zip(("x1", "x2", "t", "u"), re.findall("<p>(.*?)</p>", b)):
            texts.setdefault(path, []).append(t)
    spread = {p: -sum(n / 12 * math.log(n / 12, 12) for n in Counter(t).values()) for p, t in texts.items()}
    shift = {"x1": html_extract.INSIDE, "x2": html_extract.INSIDE, "t": html_extract.OUTSIDE, "u": html_extract.OUTSIDE}
    stay = [p for p in texts if spread[p] + shift[p] >= html_extract.LEAST_IMPORTANCE]
    got = extracted(spark, bodies)
    assert stay == ["x1", "u"] and all(got[i] == "\n".join(texts[p][i] for p in stay) for i in range(12))


def test_attributes_and_inline_elements():
    assert Page('<p title="x < y">hello</p>').text() == "hello" and Page("<p title='a <b> c' class=k>hello</p>").text() == "hello"
    assert Page('<p title="x>hello</p><a href="y">z</a>').text() == "hello\nz" and Page("<p>foo<img src=a>bar<br>baz</p>").text() == "foobar baz"


def test_repeated_notice_in_an_article_goes_and_story_outside_stays(spark):
    body = lambda i: f"<article><p>Read this notice first</p><p>{WORDS(i)}</p></article><div><p>the story {WORDS(i + 99)}</p></div><div><p>Call us at any time</p></div>"
    got = extracted(spark, [body(i) for i in range(20)])
    assert all(got[i] == f"{WORDS(i)}\nthe story {WORDS(i + 99)}" for i in range(20))


def test_copies_of_a_page_count_once(spark):
    """A host that mostly repeats one page keeps that page's text."""
    body = lambda i: f"<div><p>{WORDS(i)}</p></div>"
    got = extracted(spark, [body(0)] * 60 + [body(i) for i in range(1, 8)])
    assert all(got[i] == WORDS(0) for i in range(60)) and got[63] == WORDS(4)


def test_importances_against_brute_force(spark):
    bodies = [f"<div class=x><p>{WORDS(i % 5)}</p><ul><li>same</li><li>{i % 3}b</li></ul></div><div>{'ab'[i % 2]} tail</div>" + ("<p>rare</p>" if i < 3 else "") for i in range(24)]
    rows = [(7, b) for b in bodies]
    got = {r.element: r.importance for r in html_extract.importances(spark.createDataFrame(rows, "host long, html string")).collect()}
    looks, contents, above, depth = {}, {}, {}, {}
    for b in dict.fromkeys(bodies):
        for e, kind, f, p in Page(b).features(7, hash(b)):
            if kind == 2:
                above[e], depth[e] = f, p
            elif kind < 2:
                (looks, contents)[kind].setdefault(e, Counter())[f] += 1

    def entropy(c):
        m = sum(c.values())
        return -sum(n / m * math.log(n / m, m) for n in c.values()) if m > 1 else 1.0

    known = {e for e in above if max(sum(looks.get(e, Counter()).values()), sum(contents.get(e, Counter()).values())) >= html_extract.LEAST_PAGES}
    want = {}
    for e in sorted(known, key=lambda e: -depth[e]):
        parts = []
        if e in looks:
            under = [(want[k], max(sum(looks.get(k, Counter()).values()), sum(contents.get(k, Counter()).values()))) for k in want if above[k] == e]
            look, g = entropy(looks[e]), html_extract.GAMMA ** len(looks[e])
            parts.append((1 - g) * look + g * (sum(v * m for v, m in under) / sum(m for _, m in under) if under else look))
        if e in contents:
            parts.append(entropy(contents[e]))
        want[e] = max(parts)
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-9 for e in want) and len(want) > 5


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    body = lambda i: f"<div>Welcome</div><div><p>{WORDS(i)}</p></div>"
    rows = [(i, f"http://h{i % 3}.com/{i}", body(i)) for i in range(40)] + [(None, None, "<p>x</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "elements", "weights", "salt", "text")
    key = lambda r: (-1 if r.page_id is None else r.page_id, r.text)
    a = sorted(html_extract.main_text(df).collect(), key=key)
    monkeypatch.setattr(html_extract, "SMALL", 0)
    assert a == sorted(html_extract.main_text(df).collect(), key=key) and a[1].text == WORDS(0) and a[0].text == "x"
    none = html_extract.main_text(df.filter("false"))
    assert none.columns == ["page_id", "url", "text", "n_chars"] and none.isEmpty()
