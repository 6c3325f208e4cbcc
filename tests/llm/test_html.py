import random
import time

from riskweave.llm import html as H

LONG = "A sentence of some length that belongs to the article and says something. " * 3


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy</div>
<main><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>three<br>four.</p><p>Sh.<p>{LONG}</p><div class="notice">N</div>
<form>Name <input></form><ul><li>i1</li><li>i2&nbsp;&lt;x&gt;</li></ul><aside>Side</aside><section id="comments"><p>{LONG}</p></section></article></main>
<footer>&copy; F</footer>"""
    assert H.main_text(page) == "\n\n".join(["Head & line", "One twothree four.", "Sh.", " ".join(LONG.split()), "i1", "i2 <x>"])


def test_unmarked_page():
    links = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(30))
    page = f"<body><ul>{links}</ul><div>Home</div><div class='sidebar'>S {LONG}</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div id=cookie-notice>C</div><div>Imprint</div>"
    one = " ".join(LONG.split())
    assert H.main_text(page) == "\n\n".join([one, "Short.", one])


def test_notice_inside_an_unmarked_article():
    one = " ".join(LONG.split())
    page = f"<body><div>Home</div><nav>N</nav><div class=post><p>{LONG}</p><div class=advert>{LONG}</div><div><p>After it.</p></div><p>End.</p></div><div>Imprint"
    assert H.main_text(page) == "\n\n".join([one, "After it.", "End."])
    assert H.main_text("<div><p>x" * 30000 + "</section>") == "\n\n".join(["x"] * 30000)


def test_names_that_only_speak_about_parts():
    one = " ".join(LONG.split())
    assert H.main_text(f'<div class="page has-sidebar"><main class="content-search"><p>{LONG}</p></main></div>') == one
    assert H.main_text(f'<article><div class="post-header"><h1>Title</h1></div><p>{LONG}</p><article class="comment">No {LONG}</article></article>') == f"Title\n\n{one}"
    assert H.main_text(f'<div class="widget"><p>{LONG}</p></div>') == one
    assert H.main_text('<div class="cookie-banner">Accept</div><div class="modal">Join</div><p>Text</p>') == "Text"
    assert H.main_text('<article></article><div class="ad">Buy</div><div class="widget">W</div>') == ""
    assert H.main_text(f'<div class="cookie-banner">{LONG}</div><div class="widget">W</div>') == ""


def test_broken_and_empty():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<p>a < b &amp; c &am") == "a < b & c &am"
    assert H.main_text("<p>x<script>never closed") == "x"
    assert H.main_text("<p " * 3 + "x") == "<p <p <p x"
    assert H.main_text("<!-- open <p>x") == ""
    assert len(H.main_text("<article>" + "<p>word</p>" * 50000 + "</article>")) == 50000 * 6 - 2


def test_frame(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in H.extract(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert H.extract(df.limit(0)).count() == 0


EIGHT = "".join(f"<p>{i} {LONG}</p>" for i in range(8))
WANT = "\n\n".join(f"{i} {' '.join(LONG.split())}" for i in range(8))


def test_layout_names_do_not_erase_the_article():
    for before, after in [
        ('<form action="/x"><nav><a href="/m">Menu</a></nav>', "<input></form>"),
        ('<div class="wrapper sidebar-right">', '<div class="sidebar">Side</div></div>'),
        ('<div class="content ad-free">', "</div>"),
        ('<div class="page cookie-accepted">', "</div>"),
        ('<div class="entry-header-wrap">', "</div>"),
        ('<div id="comment-policy-article">', "</div>"),
        ('<nav><ul><li><a href="/m">Menu</a></ul>', "<footer>Foot</footer>"),
        ('<div class="comments">', "</div>"),
        ('<div class="widget">', "</div>"),
    ]:
        assert H.main_text(f"<body>{before}{EIGHT}{after}") == WANT, before
    one = " ".join(LONG.split())
    assert H.main_text(f'<article><p>{LONG}</p></article><div class="comments">{EIGHT}</div>') == one
    assert H.main_text(f'<div><p>{LONG}</p></div><div class="comment-list">{EIGHT}</div><form>Name <input></form>') == one
    assert H.main_text(f'<p>{LONG}</p><div class="ad">Buy</div><p>End.</p>') == f"{one}\n\nEnd."
    assert H.main_text('<div class="widget">W</div>') == "W"


def test_weights_decide_on_marked_pages():
    # a teaser that calls itself an article against an article that does not
    assert H.main_text(f"<article><p>Top</p></article><div>{EIGHT}</div>") == WANT
    one = " ".join(LONG.split())
    assert H.main_text(f"<article><p>{LONG}</p><p>x</p></article><div><p>{LONG}</p></div>") == f"{one}\n\nx"
    assert H.main_text(f"<article><p>{LONG}</p></article><article><p>Two</p></article><p>Imprint</p>") == f"{one}\n\nTwo"
    assert H.main_text("<article>x</article><p>Imprint</p>") == "x"


def test_windows_surges_and_dives():
    r = random.Random(4)
    for _ in range(400):
        size = [r.choice([0, 0, 0, 1, 5, 30, 79, 80, 200]) for _ in range(r.randint(0, 40))]
        window, surge = r.randint(1, 5), r.choice([1, 50, 80, 160])
        sums = [sum(size[i : i + window]) for i in range(len(size))]
        assert H.window_sums(size, window) == sums
        kept, on = [], False
        for i, n in enumerate(sums):
            on = n > 0 if on else n >= surge and size[i] > 0
            kept.append(on)
        found = H.runs(size, window, surge)
        assert [any(a <= i < b for a, b in found) for i in range(len(size))] == kept
        assert all(a < b for a, b in found) and all(p[1] <= q[0] for p, q in zip(found, found[1:]))


def test_hostile_markup_takes_time_in_proportion():
    start = time.process_time()
    for page in ("<a " * 300_000, '<a ">" ' * 100_000, "<a \"'>' " * 100_000, "<" * 500_000 + ">", "<!" * 300_000, '<a "' * 200_000 + ">", "<b class" + " " * 500_000 + ">x", "<nav><p>x" * 50_000, "<div>" * 100_000 + "</nav>" * 100_000):
        H.main_text(page)
    assert time.process_time() - start < 20


def test_query_against_another_parser(spark, sf):
    """The pages of the table mark their article; the standard library's parser reads its blocks."""
    from html.parser import HTMLParser

    from riskweave.llm import queries

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.parts, self.found = 0, [], []

        def block(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text and self.depth:
                self.found.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "article", "div"):
                self.block()
            self.depth += tag == "article"
            if tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "h3", "li", "ul", "article", "div"):
                self.block()
            self.depth -= tag == "article"

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    got = {x.page_id: x for x in queries.QUERIES["op7_html_text"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        parser = Article()
        parser.feed(p.html or "")
        parser.close()
        want = "\n\n".join(parser.found)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want), p.page_id


def test_links_between_the_paragraphs_of_an_unmarked_article():
    one = " ".join(LONG.split())
    page = f'<body><ul><li><a href="/1">Menu</a></li></ul><div class=post><p>{LONG}</p><p><a href="/2">See this one</a></p><p>{LONG}</p><p><a href="/3">More</a></p></div>'
    assert H.main_text(page) == "\n\n".join([one, "See this one", one])
