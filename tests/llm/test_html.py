import time
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from kvlake.llm import html
from kvlake.llm.html import extract, main_text, query
from tests.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page sidebar-left">
<header><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, ok?</div>
%s
<aside><p>Aside text that is long enough, really.</p></aside><div id="comments"><article class="comment"><p>First! A reader's comment, quite long, with points.</p></article></div>
<form><input><label>Mail</label><button>Send</button></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Big &amp; small</h1><p>First paragraph, with <b>bold</b> and\n  <a href='#'>link</a>.<p>Second &eacute;&#x41; one<br>line<ul><li>item a<li>item b</ul><div class='ad'>Buy!</div><blockquote>Quote, end.</blockquote>"
WANT = "Big & small\n\nFirst paragraph, with bold and link.\n\nSecond éA one line\n\nitem a\n\nitem b\n\nQuote, end."


def test_containers():
    for tag in ("article", "main", 'div role="main"', 'div id="content"', "div class='post-body'"):
        html = PAGE % f"<{tag}>{BODY}</{tag.split()[0]}>"
        assert main_text(html) == WANT, tag


def test_broken_markup():
    assert main_text("<article><p>One &amp two") == "One & two"
    assert main_text("<p>a<!-- never closed") == "a"
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<script>x") == "" and main_text("<nav>menu</nav>") == "" and main_text("<") == "<"
    assert main_text("<article><p>x &lt;b&gt; y</p></article>") == "x <b> y"
    assert main_text("<article><p>a</p></nav></div><p>b</p></article>") == "a\n\nb"


def test_empty_and_long():
    assert main_text(None) == main_text("") == main_text("   ") == ""
    body = "".join(f"<p>Paragraph {i}, with words.</p>" for i in range(5000))
    assert main_text(PAGE % f"<article>{body}</article>").count("\n\n") == 4999


def test_query(spark):
    rows = query(spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r["text"] == main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)
    assert all("<" not in r["text"] or "&lt;" in pages[r["page_id"]] for r in rows)


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, PAGE % f"<article>{BODY}</article>", "k"), (2, "", "k")], "page_id long, html string, text string")
    assert [r["t"] for r in df.withColumn("t", extract(F.col("html"))).collect()] == ["", WANT, ""]
    assert df.limit(0).withColumn("t", extract(F.col("html"))).collect() == []


def test_names():
    page = PAGE % "<div class='main'><div class='post-header'><h1>Title here</h1></div><div class='overflow-hidden border-bottom'><p>First text, long enough to count.</p></div><ol class='commentlist'><li>A comment, quite long, indeed.</ol><div class='sideBar navlinks'>x</div><div class='entry-footer'>Tags</div><div class='hidden'>no</div><p>Second text, also long.</p></div>"
    assert main_text(page) == "Title here\n\nFirst text, long enough to count.\n\nSecond text, also long."
    assert main_text("<body><div id=top-menu><a>a</a></div><table><tr><td>Cell one, with text.<td>Cell two, with more.</table><div role=alert>No</div><p hidden>No</p><p aria-hidden='true'>No</p></body>") == "Cell one, with text.\n\nCell two, with more."
    assert main_text("<body><article><header><h1>T</h1></header><p>Body, text.</p><footer>f</footer></article><article class='related'><p>Other, text, longer than the body.</p></article></body>") == "T\n\nBody, text."


def test_nested_containers_are_kept_whole():
    assert main_text("<article><h1>T</h1><div itemprop='articleBody'><p>Body, a text.</p></div><p>End.</p></article>") == "T\n\nBody, a text.\n\nEnd."
    assert main_text("<main><h1>T</h1><article><p>Body, a text.</p></article></main>") == "T\n\nBody, a text."
    assert main_text("<article><p>Outer, text.</p><article><p>Inner, longer than the outer text.</p></article></article>") == "Outer, text.\n\nInner, longer than the outer text."


def test_links_of_an_article_stay():
    refs = "".join(f"<li><a href='#'>Reference {i}</a>" for i in range(4))
    kept = "Text, of a kind.\n\n" + "\n\n".join(f"Reference {i}" for i in range(4))
    for tag in ("article", "main"):
        assert main_text(f"<body><nav><a>x</a></nav><{tag}><p>Text, of a kind.</p><ul>{refs}</ul></{tag}></body>") == kept
    assert main_text(f"<main><ul>{refs}</ul><article><p>Text, of a kind.</p></article></main>") == "Text, of a kind."


def test_names_inside_an_article_need_a_poor_path():
    text = "A paragraph, long enough to be content; it has points, too."
    html = f"<article><h1>T</h1><p>{text}</p><h2 id='related-work'>Related work</h2><p>{text}</p><div class='discussion'><h3>Notes</h3><p>{text}</p></div><p class='commentary'>{text}</p><div class='share'><a>Tweet</a></div></article>"
    assert main_text(PAGE % html) == "\n\n".join(["T", text, "Related work", text, "Notes", text, text])
    assert main_text(f"<article><p>{text}</p><ul class='related'><li><a>{text}</a><li><a>{text}</a></ul></article>") == text


def test_time_is_linear_in_broken_markup():
    for start in ("<article><p>x</p><a " + "a" * 1_000_000, "<a " + "b c" * 300_000 + "'", '<a ="x' * 150_000, "<div>" * 20_000 + "x", "<button>" * 50_000, "<!-- " * 100_000, "<a x='>" * 50_001, "<b>" * 100_000):
        began = time.time()
        main_text(start)
        assert time.time() - began < 5, start[:20]
    assert main_text("<article><p>kept, all of it.</p><a " + "a" * 30) == "kept, all of it."
    assert main_text('<article><p title="a > b">kept</p><p class=x"y>too</p></article>') == "kept\n\ntoo"


def test_tag_path_ratios_choose_the_nodes(monkeypatch):
    text = "A paragraph, long enough to be content; it has points, too."
    page = f"<body><div class='a1'>Short line one</div><div class='b2'><h2>Title</h2><p>{text}</p><p>{text} {text}</p></div><div class='c3'>Short line two</div></body>"
    want = f"Title\n\n{text}\n\n{text} {text}"
    assert main_text(page) == want
    monkeypatch.setattr(html, "path_scores", lambda blocks, factor: dict.fromkeys(factor, 3.0))
    assert main_text(page) == f"Short line one\n\n{want}\n\nShort line two"
    pages = [r for r in pd.read_parquet(f"{SF}/pages.parquet").html]
    assert sum(main_text(h) != article_by_hand(h) for h in pages) > len(pages) // 2


def article_by_hand(h):
    """The supplied pages hold one article of headings and paragraphs, some with unclosed bold text; read with the standard
    library's parser."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.on = [], False

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.on = True
            if tag == "br" and self.blocks:
                self.blocks[-1] += " "
            if tag in ("h1", "h2", "p", "li", "div", "ul", "blockquote", "article"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.on = False
            elif tag in ("h1", "h2", "p", "li", "div", "ul", "blockquote"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.on:
                self.blocks = self.blocks or [""]
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(h or "")
    reader.close()
    return "\n\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_supplied_pages_against_the_standard_parser():
    for sf in (SF, "/root/testdata/sf0.01"):
        for h in pd.read_parquet(f"{sf}/pages.parquet").html:
            assert main_text(h) == article_by_hand(h)


def test_names_that_only_look_like_furniture():
    text = "A paragraph, long enough to be content; it has points, too."
    assert main_text(f"<article><p>{text}</p><p class='notice-period'>{text}</p><div id='search-results-study'><p>{text}</p></div></article>") == "\n\n".join([text] * 3)
    assert main_text(f"<article><p>{text}</p><div class='ad-box'><p>{text}</p></div><section id='comments'><p>{text}</p></section></article>") == text
    assert main_text(f"<body><div class='cookie-notice'><p>{text} {text} {text}</p></div><div id='content'><p>{text}</p></div></body>") == text


def test_several_articles_and_parts():
    text = "A paragraph, long enough to be content; it has points, too."
    assert main_text(f"<main><article><p>{text}</p></article><article><p>{text} {text}</p></article></main>") == f"{text}\n\n{text} {text}"
    assert main_text(f"<body><nav>x</nav><div id='all'><div class='s1'><p>{text}</p></div><div class='s2'><p>Short.</p></div></div></body>") == f"{text}\n\nShort."
