import random
import re
from html import unescape
from os.path import commonprefix

from landgrid.llm.pages import extract_pages, main_text, page_lines, shared


def lcs_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2)]
        at = shared(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at) and len(at) == lcs_length(a, b)


def test_many_equal_lines_are_cheap():
    assert len(shared(["x"] * 3000 + ["y"], ["z"] + ["x"] * 2000)) == 2000


PAGE = "<html><head><title>T</title><style>p{}</style></head><body class='share'><nav><ul><li>Home</li></ul></nav>@@<footer>&copy; us</footer></body></html>"


def test_elements_and_references():
    body = (
        "<div class='ad'>Buy</div><article class='related'><header><h1>Big &amp; new</h1></header><p><b>One\n two<br>three<p>Four &#233;<script>x()</script></p>"
        "<p class='share-price'>Five</p><aside>More</aside><div id='comments'>Hi</div></article>"
    )
    assert main_text(page_lines(PAGE.replace("@@", body)), None) == "Big & new\nOne two three\nFour é\nFive"


def test_no_markup_raises():
    hard = ["<![foo[ x ]]>", "<![ 1[", "<!DOCTYPE [", "<!ELEMENT a", "<?php", "</", "<a b='", "<!-- open", "&#xFFFFFFFF;&#0;&bogus;", "<p><b></i></p></p>", "<![CDATA[ <p>in</p> ]]>after", "<script>", "<!", "<![", "<!x y>z"]
    for html in hard:
        page_lines(html)
        page_lines(f"<p>before</p>{html}<p>after</p>")
    rng = random.Random(3)
    bits = [*hard, "<p>", "</p>", "<li>", "<b>", "</b>", "<article>", "</article>", " text ", "&amp;", "\n", "<br/>", "<form>", "</form>", "\0"]
    for _ in range(500):
        page_lines("".join(rng.choices(bits, k=rng.randrange(1, 30))))
    assert page_lines("<p>a</p><![foo[ x ]]><p>b</p>")[0] == ("a", 1) and page_lines("<p>a</p><![foo[ x ]]><p>b</p>")[-1] == ("b", 1)


def test_very_long_page():
    lines = page_lines("<article>" + "<b><p>word <i>more</i>" * 60_000 + "</article>" + "</u>" * 60_000)
    assert len(lines) == 60_000 and {z for _, z in lines} == {2}


def plain_texts(rows):
    """Every page held against its neighbours in the order of host, path and page_id, written out."""
    keyed = []
    for page_id, url, html in rows:
        m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)", url or "")
        keyed.append((m.group(1).lower(), m.group(2), page_id, html))
    keyed.sort(key=lambda r: r[:3])
    out = {}
    for i, (host, path, page_id, html) in enumerate(keyed):
        sides = [keyed[j] for j in (i - 1, i + 1) if 0 <= j < len(keyed) and keyed[j][0] == host]
        best = max(sides, key=lambda s: len(commonprefix([s[1], path])), default=None)
        out[page_id] = main_text(page_lines(html), page_lines(best[3]) if best else None)
    return out


def test_whole_result_against_brute_force(spark):
    rng = random.Random(8)
    menu = ["<div>Menu %s</div>" % w for w in ("home", "news", "shop", "about")]
    rows = []
    for i in range(300):
        host = rng.choice(["hot.example", "hot.example", "hot.example", "b.example", f"h{i % 7}.example"])
        own = [f"<p>{rng.choice('abc')} text {rng.randrange(40)}</p>" for _ in range(rng.randrange(4))]
        body = rng.sample(menu, rng.randrange(5)) + own + ["<div>Contact</div>"] * (i % 3 > 0)
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{rng.choice('pq')}{i % 11}", "".join(body)))
    expected = plain_texts(rows)
    for parts in (1, 13):
        docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {r.page_id: r.text for r in extract_pages(docs).collect()} == expected
    changed = [i for i, _, html in rows if expected[i] != main_text(page_lines(html), None)]
    assert len(changed) > 150  # the nearest page decides


def test_sample_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S).group(1)
        plain = unescape(re.sub(r"<(?:p|/p|h1|/h1|br)>", "\n", inside).replace("<b>", "").replace("</b>", ""))
        assert r.text.split() == plain.split()


def test_shared_lines_go_where_there_is_no_article():
    one, two = ([(t, 1) for t in ("Menu", text, "Contact")] for text in ("First text", "Other text"))
    assert main_text(one, two) == "First text"
    assert main_text(one, one) == "Menu\nFirst text\nContact"


def test_rows_come_back_whole(spark):
    body = "<body><div>Menu</div><p>Text {}</p><div>Contact</div></body>"
    rows = [(i, f"http://h.example/a/{i}", body.replace("{}", str(i)), "x") for i in range(6)]
    rows += [(7, None, body, "x"), (8, "http://h.example/b", None, "x"), (None, "http://k.example/b", "plain", None), (9, "", "", "x"), (9, "", "", "x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[i, f"http://h.example/a/{i}"] in (f"Text {i}", f"Menu\nText {i}\nContact") for i in range(6))
    assert text[8, "http://h.example/b"] == "" and text[None, "http://k.example/b"] == "plain"
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shared_ends_of_main_and_hyphenated_names():
    page = (
        "<body><nav>Menu</nav><main><p>Skip to text</p><h1>Title @</h1><p>First line of @</p><p>A quoted line</p><p>Last line of @</p><p class='share-price'>Price of @</p>"
        "<section><h2>Related stories</h2><p>Another story</p></section><ol class='comment-list'><li>Reader of @ says</li></ol><div class='cookie-notice'>We use cookies, @</div></main></body>"
    )
    one, two = page_lines(page.replace("@", "one")), page_lines(page.replace("@", "two"))
    assert main_text(one, two) == "Title one\nFirst line of one\nA quoted line\nLast line of one\nPrice of one"
    assert main_text(one, one) == main_text(one, None)  # a copy says nothing
    article = [page_lines(page.replace("main>", "article>").replace("@", x)) for x in ("one", "two")]
    assert "Related stories" in main_text(*article) and "says" not in main_text(*article)
