import time

import numpy as np
import pytest

from tidemark.llm import html_extract


@pytest.mark.parametrize("html,lines,text", [
    ("", [], ""),
    ("<p>one<p>two", ["one", "two"], "one\ntwo"),
    ("<nav>menu</nav><article><header><h1>T &amp; t</h1></header><p>a<br>b</p><aside>x</aside>c</article><footer>f</footer>", ["menu", "T & t", "a b", "x", "c", "f"], "T & t\na b\nc"),
    ("<main><div class='side-bar ad'>x</div><p>k&nbsp; l\n m</p></main><div>out</div>", ["x", "k l m", "out"], "k l m"),
    ("<article>a<script>if (a<b) '</article>'</script><style>p{}</style>b<!-- <p>c</p> --></article>", ["ab"], "ab"),
    ("<p>foo<!--x-->bar <span class=ad>z</span>q</p>", ["foobar zq"], "foobar zq"),
    ("<article><p>Price is <span class='ad-price'>12</span> today.</p><ol class='search-results'><li>hit</li></ol></article>", ["Price is 12 today.", "hit"], "Price is 12 today.\nhit"),
    ("<article><p class='ad-hoc'>made for it</p><div class='ad-box left'>buy</div><p class=headerless>k</p></article>", ["made for it", "buy", "k"], "made for it\nk"),
    ("<div class='site-footer'>f</div><div class='navbar-nav'>n</div><div class=comment_list>c</div><div class='article-content'>t</div>", ["f", "n", "c", "t"], "t"),
    ("<article class=teaser><p>Read also</p></article><p>The text of the page is much longer than what is offered beside it.</p>", ["Read also", "The text of the page is much longer than what is offered beside it."], "The text of the page is much longer than what is offered beside it."),
    ("<article><ul><li>1<li>2</ul><section class=comments><p>reader</p></section>3</article>", ["1", "2", "reader", "3"], "1\n2\n3"),
    ("<div id=cookie-notice>no</div><div hidden>no</div><form>no</form>yes 1 < 2<foot", ["no", "no", "no", "yes 1 < 2"], "yes 1 < 2"),
    ('<p title="a > b">t</p></div></p>end', ["t", "end"], "t\nend"),
    ("<head><title>t</title></head><template><p>x</p></template><nav><p>m</p></nav>", ["m"], ""),
])
def test_lines(html, lines, text):
    found = html_extract.lines_of(html)
    assert [x[0] for x in found] == lines and html_extract.main_text(found, None) == (text, 0, 0)


TWO = "<div>Site</div><{0}><ul><li>Home</li><li>Shop</li></ul><p>{1}</p></{0}>"
#: (page, its neighbour, the text by hand)
NEIGHBOURS = [
    (TWO.format("main", "First text"), TWO.format("main", "Second text"), "First text"),
    (TWO.format("section", "First text"), TWO.format("section", "Second text"), "First text"),
    (TWO.format("article", "First text"), TWO.format("article", "Second text"), "Home\nShop\nFirst text"),
    (TWO.format("main", "First text"), TWO.format("main", "First text"), "Home\nShop\nFirst text"),  # a copy in all its lines
    ("<main><h1>T</h1><p>own</p></main><p>Imprint and all the rights of the owner</p>", "<main><h1>U</h1></main><p>Imprint and all the rights of the owner</p>", "T\nown"),
    ("<p>a</p><p>b</p><p>a</p>", "<div><p>a</p></div><p>b</p>", "a\na"),  # other tags around it are another line
]


@pytest.mark.parametrize("page,near,text", NEIGHBOURS)
def test_what_the_neighbour_has_goes(spark, page, near, text):
    docs = spark.createDataFrame([(1, "http://h.example/a/1", page), (2, "http://h.example/a/2", near + " ")], "page_id int, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(docs, parts=1).collect()}[1] == text


def test_marks_of_names():
    marked = ["ad", "ads", "side-bar", "sidebar", "cookie-notice", "site_header", "ad-box", "comment-list", "nav-bar", "main-nav"]
    plain = ["ad-hoc", "ad-price", "search-results", "content", "page", "article-header", "adverse", "main", "shareholder", "comment-free", ""]
    assert all(html_extract._marks(x) for x in marked) and not any(html_extract._marks(x) for x in plain)


@pytest.mark.parametrize("piece", ["<!a ", "<![", "<script", "<a b='", "<!--", "<div class=\"", "</"])
def test_broken_markup_is_read_in_linear_time(piece):
    began = time.time()
    html_extract.lines_of(piece * (640_000 // len(piece)))
    assert time.time() - began < 4


def longest(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("direct_bits", [1, 20, 1 << 23])
def test_common_lines_are_a_longest_common_subsequence(direct_bits, monkeypatch):
    monkeypatch.setattr(html_extract, "DIRECT_BITS", direct_bits)
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 14))] for _ in "ab")
        found = sorted(html_extract.common_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in found)


def test_very_long_pages():
    """50,000 open tags, 20,000 lines against as many others, a line of five million characters."""
    assert len(html_extract.lines_of("<div><b>x" * 50_000)) == 50_000
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 20_000, 20_000).tolist() for _ in "ab")
    assert len(html_extract.common_lines(a, b)) > 100
    assert len(html_extract.lines_of("<article>" + "word " * 1_000_000)[0][0]) == 4_999_999


def brute_texts(rows):
    """The nearest page of another html, looked for among all pages of the host."""
    from urllib.parse import urlsplit

    def key(r):
        try:
            u = urlsplit(r[1] or "")
            host, path = (u.hostname or "", u.path) if "://" in (r[1] or "") and u.scheme else ("", "")
        except ValueError:
            host = path = ""
        return host, path, r[1] or "", "" if r[0] is None else str(r[0])

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    ordered = sorted(rows, key=lambda r: (key(r), html_extract_key(r[2])))
    out = []
    for i, r in enumerate(ordered):
        before = next((x for x in ordered[:i][::-1] if (x[2] or "") != (r[2] or "")), None)
        after = next((x for x in ordered[i + 1 :] if (x[2] or "") != (r[2] or "")), None)
        best = None
        for x in (before, after):
            if x and key(r)[0] and key(x)[0] == key(r)[0] and (best is None or shared(key(x)[1], key(r)[1]) > shared(key(best)[1], key(r)[1])):
                best = x
        found = html_extract.main_text(html_extract.lines_of(r[2] or ""), best and html_extract.lines_of(best[2] or ""))
        out.append((r[0], r[1], found[0], len(found[0]), *found[1:]))
    return sorted(out, key=repr)


def html_extract_key(html):
    return CONTENT[html or ""]


CONTENT: dict[str, str] = {}


@pytest.fixture(scope="module")
def site(spark):
    """Two hosts; pages with and without an article, copies next to each other and apart, equal
    keys with other html, shared passages, null and broken urls."""
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50, n))
    rows = []
    for i in range(70):
        top, end = f"<div>Site {i % 3}</div><nav><a>{words(2)}</a></nav>", "<div>Imprint</div><p>All rights</p>"
        body = "".join(f"<p>{words(4)}</p>" for _ in range(rng.integers(0, 5))) + "<p>passage of many</p>"
        if i % 5 == 0:
            body = f"<article>{body}</article>"
        page = f"{top}{body}{end}" if i % 7 or not rows else rows[-1][2]
        rows.append((i, f"http://{'big' if i % 4 else 'small'}.example/a{i % 3}/{i % 11}/{i}?q={i}", page))
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(3, rows[3][1], "<p>other</p>"), (None, None, None), (None, "::bad::", "<article>x</article>"), (900, "http://big.example", "<p>é&eacute;</p>")]
    table = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], "page_id long, url string, html string, host string, text int, key string")
    found = html_extract.keyed(table).select("html", "key").distinct().collect()
    CONTENT.update({r.html or "": r.key[-16:] for r in found})
    return rows, table


def test_every_page_meets_its_nearest_whatever_the_parts(site):
    rows, table = site
    want = brute_texts(rows)
    for parts in (1, 4, 12, 40):
        got = sorted((tuple(r) for r in html_extract.extract(table.repartition(parts), parts=parts).collect()), key=repr)
        assert got == want
    assert sum(r[5] > 0 for r in want) > 20 and html_extract.extract(table.limit(0)).count() == 0


def test_copies_stay_whole(spark):
    top = "<div>Site name</div>"
    rows = [(i, f"http://h.example/{i}", f"{top}<p>one</p><p>two</p>") for i in range(4)] + [(4, "http://h.example/5", f"{top}<p>three</p>"), (5, "http://h.example/6", f" {top}<p>three</p>")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), parts=3).collect()}
    assert [got[i].text for i in range(4)] == ["one\ntwo"] * 4
    # page 4 is held against the copies before it, page 5 against page 4, which is alike in every line
    assert got[4].text == "three" and got[5].text == "Site name\nthree"
