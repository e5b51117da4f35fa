"""Main text of pages, templates of hosts, and odd markup."""

from fluvia.llm import html_extract
from fluvia.llm.html_extract import Page


def text(source):
    return Page(source).main_text(frozenset())


def test_furniture_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">Accept?</div><!-- <p>no</p> -->
    <article><h1>Title &amp; more</h1><p>One  two<br>three&nbsp;four <b>bold<p>Next &lt;x&gt;</p><div class="ad">Buy</div><aside>Side</aside>
    <form><input value="a>b">Name</form><section id="comments"><p>First!</p></section><ul><li>a<li>b</ul></article>
    <div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title & more\n\nOne two three four bold\n\nNext <x>\n\na\n\nb"


def test_odd_markup_does_not_crash():
    for source in ("", "plain", "<", "<p", "<p>a<", "</p>", "<!-- open", "<script>x", "<a href='x>y'>z</a>", '<a title="', "<p>" * 3000 + "deep" + "</div>" * 50, "<b><i>x</b></i>", "&#0;&#x110000;&bogus;"):
        assert isinstance(text(source), str)
    assert text("no <b>tags</b> but text") == "no tags but text"
    assert text("<div><p>a</p>b<p>c</div>d") == "a\n\nb\n\nc\n\nd"


def test_recurring_subtrees_of_a_host_go(spark):
    def page(i, host="a.example"):
        return (i, f"https://{host}/p{i}", f"<body><div><p>Welcome to our site</p></div><div><p>Text number {i} is of its own</p></div><div>Call us</div></body>")

    same = (100, "https://b.example/x", "<body><div><p>Copied page</p></div></body>")
    rows = [page(i) for i in range(8)] + [same, *[(100 + k, *same[1:]) for k in range(1, 9)], (200, None, None), (201, "odd", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(df).collect()}
    assert all(got[i][0] == f"Text number {i} is of its own" for i in range(8))
    assert got[100][0] == "Copied page"  # one page in many copies is no template
    assert got[200] == ("", 0) and got[201] == ("x", 1)


def test_article_paragraphs_stay_however_often_they_recur(spark):
    rows = [(i, "http://h.example/", f"<article><p>Boilerplate words</p><p>own {i}</p></article><div><p>Boilerplate words</p></div>") for i in range(9)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    assert {r.text for r in got} == {f"Boilerplate words\n\nown {i}" for i in range(9)}


def test_articles_are_chosen_only_for_most_of_the_text():
    cards = "<article><h2>Card</h2></article>" * 3
    assert text(f"<body><div><p>The long main text of this page</p></div>{cards}</body>").startswith("The long main text of this page")
    assert text("<body><article> </article><main>text</main></body>") == "text"
    assert text("<body><article></article><div>text</div></body>") == "text"
    assert text("<article>long enough an article</article><div>aside</div>") == "long enough an article"


def test_class_names_never_delete_what_the_page_is_about():
    for page in (
        '<article class="post has-comments"><p>main text</p></article>',
        '<div id="page" class="no-sidebar"><p>main text</p></div>',
        '<div class="layout with-sidebar"><article><p>main text</p></article></div>',
        '<main class="related"><p>main text</p></main>',
        '<div class="widget"><main><p>main text</p></main></div>',
        '<form action="/"><div><p>main text</p></div></form>',
        '<div class="widget"><p>main text</p></div>',
    ):
        assert text(f"<body>{page}<div class='cookie-notice'>no</div><form>no</form></body>") == "main text", page
    assert text("<article>The article itself<section class='comments'><article>First!</article></section></article>") == "The article itself"


def test_recurring_containers_inside_articles_go(spark):
    note = "<div class='x7'><p>Read our other stories</p></div>"
    rows = [(i, "http://h.example/", f"<article><p>The own text of page {i}</p>{note}</article>") for i in range(9)]
    # copies of one text with another title are one body, so what they share stays
    rows += [(100 + i, "http://c.example/", f"<article><h1>Title {i}</h1><p>One text that stands in copies</p><section><p>Its second part</p></section></article>") for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"The own text of page {i}" for i in range(9))
    assert all(got[100 + i] == f"Title {i}\n\nOne text that stands in copies\n\nIts second part" for i in range(9))


def test_templates_count_alike_on_hosts_of_any_size(spark, monkeypatch):
    def html(i):
        return f"<body><div>Own text number {i}</div>" + ("<div><p>A notice that rotates</p></div>" if i % 60 == 0 else "") + "</body>"

    rows = [(i, "http://big.example/", html(i)) for i in range(400)] + [(1000 + i, "http://big.example/", html(7)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Own text number {i}" for i in range(400)} | {1000 + i: "Own text number 7" for i in range(40)}
    assert {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", 0)
    out = html_extract.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert {r.page_id: r.text for r in out.collect()} == want


def test_empty_table(spark):
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    n = 20_000
    pages = ["<div>" * n + "</b>" * n, "<p>" + "<b>" * n + "<h1>x</h1>" * n, "<div><p><b>" * n, "<li><div>" * n + "</li>" * n, "<article>" + "<div>text " * n, "<table>" + "<tr><td>x" * n]
    for page in pages:
        began = time.process_time()
        html_extract.Page(page).main_text(frozenset())
        assert time.process_time() - began < 5, page[:30]


def test_furniture_larger_than_a_short_article_goes():
    assert text('<body><div class="ad">Buy this one thing now, it is on offer today only</div><article><p>Short.</p></article></body>') == "Short."
    assert text('<body><div class="related">All the text that this page has stands in here</div><p>x</p></body>').startswith("All the text")


def test_formulas_stay_in_the_text(spark):
    html = "<html><body><article><p>Euler: <math><mi>e</mi><mo>=</mo></math> is known.</p></article></body></html>"
    out = html_extract.extract_main_text(spark.createDataFrame([(1, "http://a.example/1", html)], "page_id long, url string, html string")).first()
    assert out.text == "Euler: e= is known."
