"""Operator 3: wrappers and main texts."""

import html as std
import re
import time

from corpusloom.llm import html as H


def test_main_texts_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = " ".join(" ".join(std.unescape(x) for x in re.split(r"</?(?:h1|p|br)>", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


PAGE = """<html><head><title>T</title><style>a{}</style><script>if (a<b) "</p>"</script></head><body>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><ul id=menu><li><a href="/">Home</a></ul>
<div class="post main-col"><h2>Head &amp; line</h2><p>One <b>two</b>three<br>four &#233;&nbsp;x<form><input>go</form>
<aside>side</aside><p>Last 1 &lt; 2 <!-- no > --> end</div><div id="comments"><p>nice</div><footer>f</footer></body></html>"""


def test_a_page_without_article():
    assert H.extract(PAGE) == "Head & line One twothree four é x Last 1 < 2 end"


def test_odd_pages():
    assert H.extract("") == "" and H.extract("plain < text") == "plain < text"
    assert H.extract("<article><p>cut <b>off") == "cut off"
    assert H.extract("</div></p>ends <nav>only") == "ends"
    assert H.extract("<article>a&amp</article>b") == "a&"
    assert H.extract("<article><header><h1>T</h1></header>x<script>never closed") == "T x"
    assert H.extract('<p title="a > b">q</p><p title=\'"\'>r</p>') == "q r"


def page(title, words, extra=""):
    return f"<html><body><div class='top'>Site name</div><div class='body'><h1>{title}</h1>{''.join(f'<p>{w}</p>' for w in words)}{extra}</div><div class='end'>fixed words at the end</div></body></html>"


def test_wrapper_of_a_host():
    pages = [page("A", ["x y"] * 3), page("B", ["z"] * 5, "<table>t</table>"), page("C", ["q", "r"])]
    made = H.infer(pages)
    shown = H.expression(made)
    assert "(p #" in shown and ")+" in shown and "(table)?" in shown and "'Site name'" in shown and "h1 # /h1" in shown
    assert H.main_element(made) == "div.body"
    assert H.extract(pages[1], "div.body") == "B z z z z z t"


def test_the_wrapper_decides(spark):
    """Neither article nor class names tell here: the element and its fixed line are learnt from the other pages."""
    fixed = "<div class='tail'>Filed under stories</div>"
    html = [page(f"Title {i}", [f"words of page {i} {j}" for j in range(3 + i)], fixed) for i in range(5)]
    other = "<section><div class='lone'>Filed under stories</div></section>"
    rows = [(i, f"http://a.example/{i}", h) for i, h in enumerate(html)] + [(9, "http://a.example/9", other), (10, "http://b.example/1", html[0])]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"Title {i} " + " ".join(f"words of page {i} {j}" for j in range(3 + i))
        assert H.extract(html[i]) == f"Site name {got[i]} Filed under stories fixed words at the end"
    # One page of a template has no wrapper.
    assert got[9] == "Filed under stories" and got[10] == H.extract(html[0])


def test_copies_are_not_a_template():
    copies = [page("Same", ["all words are the same here"] * 2, f"<div class='n'>{i}</div><div class='m'>long text that all pages have</div>") for i in range(4)]
    made = H.infer(copies)
    assert H.fixed_texts(made, "div.body", 4) == []


def test_two_templates_of_a_host(spark):
    a = [page(f"A{i}", [f"first kind {i} {j}" for j in range(3)]) for i in range(40)]
    b = [f"<html><body><ul class='links'><li>Menu one<li>Menu two</ul><section class='story'><h2>B{i}</h2>second kind {i}</section></body></html>" for i in range(2)]
    rows = [(i, "http://a.example/x", h) for i, h in enumerate(a + b)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[40] == "B0 second kind 0" and got[41] == "B1 second kind 1" and got[0] == "A0 first kind 0 0 first kind 0 1 first kind 0 2"


def test_groups_of_any_length_and_whole_streams():
    def long_page(seed, n):
        record = "".join(f"<h3>k{k}</h3><pre class='c{k}'>v{seed} {k}</pre>" for k in range(20))
        menu = "".join(f"<div class='m'><span>item {k}</span></div><hr>" for k in range(3000))
        return f"<html><body><div class='menu-x'>{menu}</div><div class='col'>{record * n}</div></body></html>"

    made = H.infer([long_page("a", 2), long_page("b", 1), long_page("c", 5)])
    groups = [x["shape"] for x in made if x["shape"].startswith("(h3")]
    assert len(groups) == 1 and groups[0].count("/pre") == 20 and not any(x["optional"] for x in made)
    assert H.main_element(made) == "div.col"


def test_large_odd_pages_in_linear_time():
    began = time.time()
    deep = "<div>x" * 50_000
    assert H.extract(deep) == " ".join(["x"] * 50_000)
    made = H.infer([deep, deep.replace("x", "y") + "</div>" * 50_000, "</div>" * 50_000])
    assert H.main_element(made) == "div" and H.fixed_texts(made, "div", 3) == []
    mixed = ["".join(f"<{'uvwxyz'[(i * i + k) % 6]}x>{i}</{'uvwxyz'[(i * i + k) % 6]}x><hr>" for i in range(50_000)) for k in range(3)]
    H.infer(mixed)
    assert time.time() - began < 60


def test_columns_with_clashing_names_and_copies(spark):
    rows = [(i, "http://a.example/1", page("T", ["one", "two"]), 1, "x", "y", 2) for i in range(30)] + [(None, "http://a.example/1", page("T", ["three"]), 1, "x", "y", 2)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host int, template string, element string, _n int")
    got = [(r.page_id, r.text) for r in H.main_texts(frame).collect()]
    assert len(got) == 32 and got.count((None, "T three")) == 2 and all((i, "T one two") in got for i in range(30))


def test_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.main_texts(none).count() == 0
    odd = spark.createDataFrame([(1, None, None), (2, "nonsense", "<p>a</p>"), (2, "nonsense", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in H.main_texts(odd).collect()) == [(1, ""), (2, "a"), (2, "a")]


def test_words_of_the_subject_stay_inside_an_article():
    page = '<body><div class="menu">Home About</div><article><p>First.</p><div class="search-results">Found it.</div><section class="menu">soup and bread</section><div class="notice-board">Pinned.</div><table class="share-price"><tr><td>12</td></tr></table><nav>Top</nav><div class="ad-slot">Buy</div><div id="comments">I agree</div><form>Mail</form></article><div class="related">More</div></body>'
    assert H.extract(page) == "First. Found it. soup and bread Pinned. 12"


def test_every_page_of_a_template_counts(spark):
    """A line that some of 300 pages lack is not fixed, whichever pages they are; one that all of them have is."""
    def html(i):
        tail = f"Filed under stories of {i}" if i % 60 == 7 else "Filed under stories"
        return page(f"Title {i}", [f"words of page {i} {j} and some more of them" for j in range(3)], f"<div class='tail'>{tail}</div><div class='sign'>Our house</div>")

    rows = [(i, "http://a.example/x", html(i)) for i in range(300)] * 2 + [(300 + i, "http://b.example/x", html(1)) for i in range(50)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.main_texts(frame).collect()}
    for i in range(300):
        words = " ".join(f"words of page {i} {j} and some more of them" for j in range(3))
        assert got[i] == f"Title {i} {words} Filed under stories" + (f" of {i}" if i % 60 == 7 else "")
    found = H.wrappers(frame).collect()
    assert [(r.host, r.element, r.fixed, r.n_pages) for r in found] == [("a.example", "div.body", ["div.sign Our house"], 300)]


def test_parts_say_what_one_wrapper_says(spark, monkeypatch):
    """A template dealt into parts, of one page at the least, against the wrapper of all its pages."""
    pages = [page(f"T{i}", [f"own words {i} {j}" * 3 for j in range(2 + i % 3)], "<div class='tail'>Filed</div>" + "<table>t</table>" * (i % 4 == 1)) for i in range(24)]
    frame = spark.createDataFrame([(i, "http://a.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    made = H.infer([h for i, h in enumerate(pages) if i % 4 != 1])
    want = (H.main_element(made), H.fixed_texts(made, "div.body", 18))
    assert want == ("div.body", ["div.tail Filed"])
    for n in (1, 5, 100):
        monkeypatch.setattr(H, "PART_PAGES", n)
        found = {r.n_pages: (r.element, r.fixed) for r in H.wrappers(frame).collect()}
        assert found == {18: want, 6: (want[0], [*want[1], "table t"])}
