"""op6: extraction by example, alignment against the table of all subsequences."""

import random

import pytest

from brightloom.llm import html


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(1500):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html.common_lines(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a  &amp;\n b</p><p> </p><p>c<br>d", ["a & b", "c d"]),
        ("<style>p{}</style><script>var t='<p>x</p>'</script><p>y</p><!-- <p>z</p> -->", ["y"]),
        ("<p>one<b>two</b>three</p>", ["onetwothree"]),
        ("<p>x &lt;b&gt; &#233; &eacute; &nbsp;y</p>", ["x <b> é é y"]),
        ("<p>a < b</p>", ["a < b"]),
        ("", []),
        ("plain text", ["plain text"]),
    ],
)
def test_lines(page, want):
    assert [t for t, _ in html.lines(page)] == want


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post comments-open'>{}</article>",
        "<main class='with-sidebar'>{}</main>",
        "<div class='elementor-widget'>{}</div>",
        "<section id='social-contract'>{}</section>",
        "<p class='legal'>{}</p><p>and more of it</p>",
        "<div class='sidebar-left'><main>{}</main></div>",
        "<div id='promo'>{}</div><p>less</p>",
        "<main><p>{}</p><div class='ads'><article>x</article></div></main>",
        "<form id='aspnetForm' action='x'><div><article><p>{}</p></article></div></form>",
        "<form><div><p>{}</p></div></form><p>less</p>",
        "<div role='complementary'><main>{}</main></div>",
    ],
)
def test_class_or_id_takes_no_article(page):
    got = html.lines(page.format("Text of the page"))
    assert "Text of the page" in [t for t, p in got if p != "boilerplate"] and all(p != "boilerplate" for _, p in got)


def test_forms_still_go_beside_what_they_do_not_hold(spark):
    page = "<form id=all><article><p>Real text</p><form><p>Mail</p></form></article><div role='search'>Look for</div></form>"
    assert html.lines(page) == [("Real text", "article"), ("Mail", "boilerplate"), ("Look for", "boilerplate")]
    (row,) = html.main_text(spark.createDataFrame([("u", page)], "url string, html string")).collect()
    assert (row.text, row.n_shared, row.n_marked) == ("Real text", 0, 2)


def test_lines_that_markup_takes_are_not_the_neighbours(spark):
    page = "<nav>Home</nav><p>Site of the host</p><div><p>Text {}</p></div><footer>(c)</footer>"
    rows = spark.createDataFrame([(f"http://h/{i}", page.format(i)) for i in range(3)], "url string, html string")
    assert {(r.text, r.n_shared, r.n_marked) for r in html.main_text(rows).collect()} == {(f"Text {i}", 1, 2) for i in range(3)}


@pytest.mark.parametrize("mark", ["class='sidebar'", "class='cookie-notice'", "id='acme-footer'", "class='x share-buttons'", "id='adTop'", "class='comments'", "role='navigation'", "style='display:none'"])
def test_marked_containers_still_go(mark):
    assert html.lines(f"<article><p>Text of the page</p><div {mark}>Other</div></article>") == [("Text of the page", "article"), ("Other", "boilerplate")]


def test_comments_that_are_articles_within_the_article_go():
    assert html.lines("<article><p>Text of the page</p><div id='comments'><article>First!</article></div></article>")[1] == ("First!", "boilerplate")


def test_math_is_text_of_its_line():
    assert html.lines("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='t'>x = 1</annotation></math> holds</p>") == [("So x=1 holds", "")]


def test_voided_inline_mark_splits_no_line():
    assert html.lines("<p>a <span class='ad'>most of the text</span> b</p>") == [("a most of the text b", "")]


@pytest.mark.parametrize(
    "page",
    [
        "<article><p class=ad>Buy<p>Real 1<p>Real 2</article>",
        "<article><ul><li class=ad>Buy<li>Real 1<li>Real 2</ul></article>",
        "<article><dl><dt class=ad>Buy<dd>Real 1<dt>Real 2</dl></article>",
        "<article><table><tr class=ad><td>Buy<tr><td>Real 1<td>Real 2</table></article>",
        "<article><table><tbody><tr><td class=ad>Buy<th>Real 1<tbody><tr><td>Real 2</table></article>",
        "<article><p class=ad>Buy<h2>Real 1</h2><div>Real 2</div></article>",
        "<article><div><p class=ad>Buy</div><div>Real 1</div>Real 2</article>",
        "<article><div><ul><li class=ad>Buy<ul><li>this</ul></ul>Real 1<p>Real 2</div></article>",
        "<article><p><span class=ad>Buy</p><p>Real 1<p>Real 2</article>",
        "<head><title>T</title><body><article><p class=ad>Buy</p><p>Real 1<p>Real 2</article>",
    ],
)
def test_implied_ends_restore_the_place(page):
    got = html.lines(page)
    assert [x for x in got if x[1] == "article"] == [("Real 1", "article"), ("Real 2", "article")]
    assert [t for t, p in got if p != "article"] in (["Buy"], ["Buy", "this"])


def test_nothing_implied_reaches_out_of_its_container():
    page = "<article><div class=sidebar><p>Side<table><tr><td><p>cell<p>more</table><p>too</div><p>Text of the page, and more of the text of the page</article>"
    assert [t for t, p in html.lines(page) if p == "article"] == ["Text of the page, and more of the text of the page"]


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{t}</h1><p>{p}</p><div class="share-buttons">Share</div>
<aside>Related</aside><form><p>Mail</p></form><section id="comments"><p>First!</p></section><p>End {t}</p></article>
<div class="sidebar"><p>Side</p></div><div id="ad-top">Buy</div><footer>(c)</footer></body></html>"""


def texts(spark, rows):
    return {r.row.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_article(spark):
    got = texts(spark, [(i, f"http://h.example/a/{i}", PAGE.format(t=f"T{i}", p="same words")) for i in range(3)])
    assert got == {i: f"T{i}\nsame words\nEnd T{i}" for i in range(3)}


def test_lines_that_neighbours_share_go(spark):
    page = "<div><p>Site menu line</p><p>Own {0}</p><p>Also {0}</p><p>All about us</p></div>"
    rows = [(1, "https://h.example/x/1", page.format(1)), (2, "http://h.example/x/2.html?q=1#top", page.format(2)), (3, "http://other.example/x/3", page.format(3)), (4, "http://h.example/x/1?again", page.format(1))]
    got = texts(spark, rows)
    assert got[1] == "Own 1\nAlso 1" and got[2] == "Own 2\nAlso 2" and got[4] == got[1]
    assert got[3] == "Site menu line\nOwn 3\nAlso 3\nAll about us"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("size", [3, 50_000])
def test_whole_operator_equals_brute_force(spark, monkeypatch, size):
    """Pages without an article, of classes that say nothing: the nearest page decides on every line."""
    monkeypatch.setattr(html, "parts", lambda spark, rows, per: -(-rows // size))
    rnd = random.Random(size)
    pages = {}
    for i in range(60):
        host, path = rnd.choice(["a.example", "b.example"]), "/".join(rnd.choice(["x", "y", "yy", "z"]) for _ in range(rnd.randrange(1, 4))) + f"/{i}"
        common = [f"{host} line {k}" for k in range(12) if rnd.random() < 0.5]
        rnd.shuffle(common)
        lines = common + [f"page {i} line {k}" for k in range(rnd.randrange(4))]
        rnd.shuffle(lines)
        pages[i] = (host, f"/{path}", lines)
    rows = [(i, f"https://{host}{path}", "".join(f"<div class='c{k % 3} box'>{x}</div>" for k, x in enumerate(lines))) for i, (host, path, lines) in pages.items()]
    got = {r.row.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == set(pages)
    deleted = 0
    for i, (host, path, lines) in pages.items():
        same = sorted((p, j) for j, (h, p, x) in pages.items() if h == host and x)
        at = [j for _, j in same].index(i) if lines else 0
        around = [same[k] for k in (at - 1, at + 1) if 0 <= k < len(same)] if lines else []
        other = max(around, key=lambda x: html.nearness(x[0], path))[1] if around else None
        kept = got[i].text.split("\n") if got[i].text else []
        gone = [x for x in lines if x not in kept]
        assert [x for x in lines if x not in gone] == kept
        rest = iter(pages[other][2] if other is not None else [])
        assert len(gone) == (longest(lines, pages[other][2]) if other is not None else 0) == got[i].n_shared and all(x in rest for x in gone)
        assert got[i].n_marked == 0
        deleted += len(gone)
    assert deleted > 100


def test_any_column_names(spark):
    names = ["my col", "a-b", "a.b", "_", "row", "text ", "lines", "host"]
    pages = spark.createDataFrame([(1, "http://h/1", "<p>x</p>", *names)], ["page_id", "url", "html", *names])
    (row,) = html.main_text(pages).collect()
    assert tuple(row.row) == (1, "http://h/1", "<p>x</p>", *names) and row.text == "x"


@pytest.mark.parametrize("size", [1, 50_000])
def test_neighbours_across_partitions(spark, monkeypatch, size):
    monkeypatch.setattr(html, "parts", lambda spark, rows, per: -(-rows // size))
    page = "<p>Top</p><p>Text {0}</p><p>Bottom</p>"
    got = texts(spark, [(i, f"http://h.example/{i:03d}", page.format(i)) for i in range(40)])
    assert got == {i: f"Text {i}" for i in range(40)}


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(20_000)) + "</article>"
    got = texts(spark, [(1, None, None), (2, None, "<p>x</p>"), (3, "not a url", ""), (4, "http://h/1", long), (5, "http://h/2", "<p>unclosed <div <b"), (6, "http://h/3", "<article><p>a</article></p></div>")])
    assert got[1] == "" and got[3] == "" and got[2] == "x" and got[4].count("\n") == 19_999 and got[6] == "a"
    schema = "page_id long, url string, html string, text string, host string"
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = html.main_text(spark.createDataFrame([(None, "http://h/1", "<p>x</p>", "t", "o")] * 2, schema)).collect()
    assert [(r.row.text, r.row.host, r.text) for r in rows] == [("t", "o", "x")] * 2


def test_addresses():
    assert html.address("HTTPS://u@Host.Example:80/a/b/index.html?x#y") == ("host.example", "/a/b")
    assert html.address("http://h/a/") == ("h", "/a") == html.address("//h/a.php")
    assert html.address(None) == ("", "")


def test_query(spark, sf_dir):
    import re
    from html import unescape

    out = {r.page_id: r for r in html.op6_html_extraction(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert out[p.page_id].text == "\n".join(filter(None, blocks)) and out[p.page_id].n_chars == len(out[p.page_id].text)
