"""Main text of pages: given pages against a second reader, and sites made for the test."""

import html
from html.parser import HTMLParser

import pytest

from countloom.llm import pages

SF = "/root/testdata/sf0.001"
KINDS = "page_id long, url string, html string"


class Plain(HTMLParser):
    """The article of the given pages by the standard library's parser: texts inside <article>, cut at p and h1."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [""] if tag in ("p", "h1") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(source):
    p = Plain()
    p.feed(source)
    p.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, KINDS)).collect()}


def test_given_pages(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in pages.op12_main_text(spark, SF).collect()}
    assert len(got) == given.count() > 0
    for r in given.collect():
        assert got[r["page_id"]]["text"] == plain(r["html"]) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


PROSE = ["The cat sat on the mat and looked at the rain.", "Nobody knew where it had come from that day.", "It left in the evening without a sound."]


@pytest.mark.parametrize("around", [
    "<nav><a href=/a>Home</a> About</nav>", "<header><h1>The Site</h1></header>", "<footer>&copy; us</footer>", "<aside>See also</aside>", '<div class="cookie-notice">We use cookies</div>',
    '<div id="sidebar"><p>Popular</p></div>', "<form><label>Name</label><input><button>Go</button></form>", "<script>if (a < b) write('<p>x</p>')</script>", "<style>p > a {}</style>", "<!-- <p>no</p> -->",
    '<section id="comments"><article class="comment"><p>First!</p></article></section>', '<div class="adBox">Buy</div>', '<div role="banner">Site</div>', "<p hidden>secret</p>", '<p style="display: none">secret</p>',
    "<noscript>Turn it on</noscript>", '<ul class="breadcrumbs"><li>Home</li></ul>', '<div class="newsletter-signup"><p>Subscribe</p></div>', "<svg><text>icon</text></svg>", "<select><option>One<option>Two</select>",
])
def test_what_stands_around_goes_by_its_markup(around):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    for source in (f"<body>{around}<article>{body}</article></body>", f"<body><article>{body}{around}</article>", f"<main>{around}{body}</main>", f"<body>{around}<div id=content>{body}</div>"):
        # a header inside the article keeps its headings
        assert pages.Article(source).text().replace("The Site", "").strip() == "\n".join(PROSE)
        assert "header" not in around or not source.startswith("<body><header") or "Site" not in pages.Article(source).text()
    assert pages.Article(f"<body>{around}{body}").text() == "\n".join(PROSE)


def test_text_is_whole():
    source = """<article class=has-sidebar><header><h1>A &amp; B</h1><p class=byline>By me</p></header><p>one<b>two</b> <i>three</i>&nbsp;
      four &lt;tag&gt; &#x41;&#66;&eacute; 5 &am 6 < 7 <br>next<p>open <a href="/x?a>b">link</a><ul><li>item<li>other</ul><table><tr><td>c1<td>c2</table><pre> a
        b </pre><blockquote>said</blockquote><div>loose <span class=ad>BUY</span>text</div>last</b></article>tail"""
    assert pages.Article(source).text() == "A & B\nonetwo three four <tag> ABé 5 &am 6 < 7 next\nopen link\nitem\nother\nc1\nc2\na b\nsaid\nloose text\nlast"


def test_odd_sources():
    assert pages.Article("").text() == "" and pages.Article("just text &amp; more").text() == "just text & more"
    assert pages.Article("<article><p>a</div></span><p>b").text() == "a\nb" and pages.Article("<script>never closed").text() == ""
    assert pages.Article("<article><p title='open>a</p><p>b</p>").text() == "a\nb"
    assert pages.Article("<div>" * 3000 + "deep" + "</div>" * 3000).text() == "deep"
    assert pages.Article("<form><div class=page-wrapper><article>x</article></div></form>").text() == "x"
    assert pages.Article("<body><ul><li><a>One</a><li><a>Two</a></ul><p>Prose with <a>one link</a> in it.</p>").text() == "Prose with one link in it."


def site(host, k, body, block):
    return f"http://{host}/{k}", f"<body><div class=x1><div>{block}</div></div><div class=x2>{body}</div></body>"


def test_templates_of_a_site_go(spark):
    """Blocks without telling names: what recurs on a host goes there, what recurs elsewhere or with the same article stays."""
    block = "Site of the year <p>Call us</p>"
    own = lambda k: f"<p>Story {k} of the day.</p><p>It ends with {k}.</p>"
    rows = [(k, *site("a.example", k, own(k), block)) for k in range(10)]
    rows += [(100 + k, *site("b.example", k, own(k), f"Block {k}")) for k in range(10)]
    rows += [(200 + k, *site("c.example", 0, own(0), block)) for k in range(10)]  # copies of one page are no template
    rows += [(300, *site("d.example", 0, own(0), block)), (301, None, "<p>no site</p>"), (302, "nonsense", None), (303, "http://a.example/", "")]
    got = texts(spark, rows)
    for k in range(10):
        assert got[k] == f"Story {k} of the day.\nIt ends with {k}."
        assert got[100 + k] == f"Block {k}\nStory {k} of the day.\nIt ends with {k}."
        assert got[200 + k] == got[300] == "Site of the year\nCall us\nStory 0 of the day.\nIt ends with 0."
    assert got[301] == "no site" and got[302] == got[303] == ""


def test_prose_that_pages_share_stays_in_a_named_article(spark):
    shared = "<p>This passage stands in the articles of many pages.</p>"
    box = '<div class="c9"><p>Rate this page</p></div>'
    rows = [(k, f"https://user@h.example:80/{k}", f"<article><h1>T{k}</h1>{shared}{box}<p>end {k}</p></article>") for k in range(12)]
    got = texts(spark, rows)
    assert all(got[k] == f"T{k}\nThis passage stands in the articles of many pages.\nend {k}" for k in range(12))


def test_hot_host_repeated_rows_and_other_columns(spark):
    rows = [(k % 3, "http://h.example/x", f"<article><p>{k % 3}</p></article>", "x", k) for k in range(40)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, KINDS + ", text string, host long")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(df).collect() if r["page_id"] is not None)
    assert got == sorted((k % 3, str(k % 3), 1) for k in range(40))
    assert pages.main_text(df).count() == 41 and pages.main_text(df.filter("false")).count() == 0


def test_very_long_page(spark):
    body = "".join(f"<p>word {k} &amp; more</p>" for k in range(30_000))
    got = texts(spark, [(1, "http://l.example/", f"<article>{body}</article>")])
    assert got[1] == html.unescape("\n".join(f"word {k} &amp; more" for k in range(30_000)))
