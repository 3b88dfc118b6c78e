"""Main text of pages: the block reader, template classes and odd pages."""

import re
from html import unescape

from pyspark.sql import functions as F

from vertexloom.llm import op1_html_text as op1
from vertexloom.llm.markup import blocks

PAGES = "page_id long, url string, html string, host string, main string, text string"


def texts(html):
    return [t for _, t in blocks(html)[0]]


def test_blocks():
    assert texts(None) == texts("") == []
    assert texts("a <b>b</b>\n c") == ["a b c"]
    assert texts("<p>one<br>two<p>three <i>x</i></p>tail") == ["one two", "three x", "tail"]
    assert texts("<p>a &amp; b &lt;p&gt; &#233;&eacute; &nbsp;x</p>") == ["a & b <p> éé x"]
    assert texts('<script>var t="</p><p>no</p>";</script><style>p{}</style><p>yes</p><script>open') == ["yes"]
    assert texts("<!-- <p>no</p> --><p>yes<!-- open <p>no") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert texts("1 < 2 and 3 > 2 <p>x</div></p>") == ["1 < 2 and 3 > 2", "x"]
    assert texts('<p title="a > b">x</p><p class=\'y>\'>z') == ["x", "z"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>x" * 3000)[:2] == ["x", "x"]
    assert len(texts("<div>" * 3000 + "deep")) == 1
    assert blocks('<div class="b a 12" id=c7><p hidden>x')[0] == [("/div.0.a.b.c0/p.hidden", "x")]


def test_inline_parts_and_split_references():
    skipped = lambda html: [t for _, t in blocks(html, op1.INLINE_SKIPPED)[0]]
    assert skipped('<p>a <span class="ad">buy <b>now</b></span> b <i hidden>c</i><span>d</span>') == ["a b d"]
    assert skipped('<p>a <span class="ad">buy<p>b</span>c') == ["a", "bc"]
    assert texts("<p>x &am<b></b>p; y &lt<i>;</i>") == ["x &amp; y <;"]


def test_names_of_the_page_and_above_an_article():
    assert op1.main_text('<html><body class="sidebar-right"><div class=x><p>text</div></body>', None) == "text"
    assert op1.main_text('<body class="menu-open"><nav>menu</nav><article class=p1><p>text</article>', None) == "text"
    layout = '<body><div class="sidebar-left"><article><h1>T</h1><p>a long enough text</article></div><div class=x>note</div>'
    assert op1.main_text(layout, None) == "T\na long enough text"
    teaser = '<body><div class=x><p>The text of this page itself</div><div class="related"><article>short</article></div>'
    assert op1.main_text(teaser, None) == "The text of this page itself"
    assert op1.main_text("<article><p>so <math><mi>x</mi></math> is it", None) == "so\nx\nis it"


SITE = """<html><head><title>t {i}</title></head><body><div class="cookie-notice">We use cookies {i}</div>
<header><h2>Site {i}</h2></header><nav><ul><li>Home<li>More {i}</ul></nav><div class="wrap with-sidebar">
<article><header><h1>Title {i}</h1></header><p>First {i}.<div class="share-buttons">Share</div><p>Second &amp; {i}
<form><input name=q>Send {i}</form><aside>By the way {i}</aside><blockquote>Quoted {i}</blockquote></article>
<aside class="sidebar">Links {i}</aside><section id="comments"><article class="comment">Nice {i}</article></section></div>
<footer>&copy; {i}</footer></body></html>"""


def extracted(spark, rows, **more):
    frame = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)
    found = op1.extract(frame, **more).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    return {r.page_id: r.text for r in found}


def test_article_of_a_site(spark):
    rows = [(i, f"http://a.org/{i}", SITE.replace("{i}", f"no{'x' * i}")) for i in range(6)]
    expected = {i: "Title {i}\nFirst {i}.\nSecond & {i}\nQuoted {i}".replace("{i}", f"no{'x' * i}") for i in range(6)}
    assert extracted(spark, rows) == expected
    assert extracted(spark, rows, broadcast_bytes=0) == expected
    assert extracted(spark, rows[:1]) == {0: expected[0]}


def test_site_without_an_article_element(spark):
    page = "<body><div id=top><p>menu</div><div class=x1><div class=x2><h1>T{i}</h1><p>{i} long text here</div></div><div class=footer>f"
    rows = [(i, "http://b.org/", page.replace("{i}", "a" * i)) for i in range(1, 5)]
    found = extracted(spark, rows)
    assert all(f"T{'a' * i}\n{'a' * i} long text here" in found[i] for i in found)
    assert not any("\nf" in t for t in found.values())


NEUTRAL = """<body>{notice}<div class=x1><ul><li>Home<li>Contact us</ul></div><div class=x2><div class=x3><h1>T{i}</h1>
<p>{i} is told here at some length</div><div class=x4><p>Buy our tea today</div></div><div class=x5>All rights reserved</div>"""


def test_classes_tell_the_template_where_names_do_not(spark):
    notice = "<div class=xn><p>We have moved</div>"
    words = ["one", "two", "three", "four", "five", "six"]
    rows = [(i, "http://n.org/", NEUTRAL.replace("{i}", w).replace("{notice}", notice * (i % 2))) for i, w in enumerate(words)]
    expected = {i: f"T{w}\n{w} is told here at some length" for i, w in enumerate(words)}
    assert extracted(spark, rows) == expected
    assert extracted(spark, rows, broadcast_bytes=0) == expected
    # Pages that copy one another but for a small part keep their text.
    near = [(i, "http://m.org/", f"<body><div class=x1><p>One long story that every page has.</div><div class=x2><p>{w}</div>") for i, w in enumerate(words)]
    assert extracted(spark, near) == {i: f"One long story that every page has.\n{w}" for i, w in enumerate(words)}


def test_classes_are_valid_or_not_as_a_whole():
    of = {"/a": 0, "/a/b": 0, "/a/c": 0, "/a/d": 1, "/a/d/e": 2, "/a/d/f": 3, "/a/b/g": 3, "/a/b/h": 4}
    place = {p: (k, k, 6 * k) for k, p in enumerate(of)}
    assert op1.valid_classes(of, place) == {0, 1, 2, 3, 4}
    moved = {p: (k, k + 1, 6 * k + 3) for k, p in enumerate(of)}  # after one that is on half of the pages
    assert op1.valid_classes(of, moved) == {0, 1, 2, 3, 4}
    swapped = place | {"/a/b": (0, 1, 3), "/a/c": (0, 1, 3)}
    assert op1.valid_classes(of, swapped) == set()
    assert op1.valid_classes(of | {"/a/b": 5, "/a/c": 5}, swapped) == {0, 1, 2}


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>x</p>"), (2, "no host", None), (3, "http://c.org", ""), (4, "http://c.org", "plain words"),
        (5, "http://c.org", "<article>" + "<p>many</p>" * 20_000), (6, "http://c.org", "<nav>only menu</nav>"),
    ]
    found = extracted(spark, rows)
    assert found == {1: "x", 2: "", 3: "", 4: "plain words", 5: "\n".join(["many"] * 20_000), 6: ""}
    assert extracted(spark, []) == {}
    twice = spark.createDataFrame([(1, "http://d.org", "<article><p>a</article>", "", "", "")] * 2, PAGES)
    assert [r.text for r in op1.extract(twice).collect()] == ["a", "a"]


def test_classes_have_equal_occurrence_vectors(spark):
    html = ["<body><nav><p>a<p>b</nav><article><p>c", "<body><nav><p>a<p>b</nav><article><p>c<p>d", "<body><article><p>c"]
    pages = spark.createDataFrame([("h", i, h) for i, h in enumerate(html)], "host string, page long, html string")
    found = {}
    for r in op1.classes(pages).collect():
        found.setdefault(r["class"], set()).add(r.path)
    vectors = {}
    counts = [{p: n for p, n, _, _ in op1.page_tokens(h)} for h in html]
    for path in set().union(*counts):
        vectors.setdefault(tuple(c.get(path, 0) for c in counts), set()).add(path)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, vectors.values()))


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    found = {r.page_id: r.text for r in op1.op1_html_text(spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").select("page_id", F.col("html")).collect()
    assert len(found) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert found[page.page_id] == "\n".join(p for p in parts if p)


def test_names_within_an_article_are_its_own():
    kept = ['<section id="related-work">a</section>', '<div class="note alert-box">b</div>', '<p class="search">c</p>', '<div class="search-results">d</div>', '<div class="comments-policy">e</div>', '<ul class="menu-items-of-1900"><li class="form">f</li></ul>']
    gone = ['<div class="comments">x</div>', '<section class="comment-list">x</section>', '<div class="cookie-notice">x</div>', '<div class="ad">x</div>', '<p class="advert">x</p>', '<nav>x</nav>', '<form>x</form>', '<aside>x</aside>', '<footer>x</footer>', '<div class="share-bar">x</div>', '<div hidden>x</div>']
    html = "<body><div class='menu'>menu</div><article><h1>T</h1>" + "".join(kept + gone) + "</article><div class='footer'>end</div></body>"
    assert op1.main_text(html, None) == "T\na\nb\nc\nd\ne\nf"


def test_a_host_of_two_pages(spark):
    page = "<body><div><ul><li>Home</li><li>News</li></ul></div><div><p>{}</p><p>{}</p></div><div><b>All rights reserved</b></div></body>"
    rows = [(i, f"http://two.example/{i}", page.format(f"First words of page {i} that are its own", f"and {i} more of them")) for i in range(2)]
    found = {r.page_id: r.text for r in op1.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"First words of page {i} that are its own\nand {i} more of them" for i in range(2)}
