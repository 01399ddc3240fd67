"""Main text of hand-made pages, whose articles are known, and defined results for odd ones."""

import time
from html.parser import HTMLParser

import pytest

from millrace.llm import html

LONG = "This is a sentence with several words, some commas, and enough length to look like real prose."

PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div id=main><h1>Head &amp; line</h1><p>{LONG}</p><p>A  second\n one&nbsp;with &#x41;&#66; <b>bold</b><i>er</i>.</p></div><div class=sidebar><p>{LONG}</p></div><footer>c 2024</footer><script>var a='<p>';</script></body></html>", f"Head & line\n{LONG}\nA second one with AB bolder."),
    (f"<body><article><p>{LONG}<p>Unclosed one<ul><li>first<li>second</ul><form><input><p>Sign up</p></form></article><div class='comments'><p>{LONG}</p></div></body>", f"{LONG}\nUnclosed one\nfirst\nsecond"),
    ("", ""),
    (None, ""),
    ("<p>", ""),
    ("<script>only()</script>", ""),
    ("just text &lt;b&gt; <!-- not this -->end", "just text <b> end"),
    (f"<div><p>{LONG}</p><p>cut off <a href='x", f"{LONG}\ncut off"),
    (f"<article><p class='lead ad-free'>{LONG}</p><div class='promoted-story-text'><p>Second, one.</p></div><p class='ad'>Buy</p><div class='ad-slot'>now</div></article>", f"{LONG}\nSecond, one."),
    (f"<div id=page class='has-sidebar'><h1>Head</h1><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div>", f"Head\n{LONG}"),
    (f"<div class=sidebar><p>{LONG}</p></div><div class='cookie-notice'><p>{LONG}</p></div>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert html.main_text(page) == text


OTHER = "Another sentence, which is long enough to be read as prose and has, as such, its own commas."
#: Pages with the text that a reader would copy, written by hand.
ARTICLES = [
    (f"<header>Site</header><article><header><h1>Headline</h1><p>By A. Writer</p></header><p>{LONG}</p><footer>c</footer></article>", f"Headline\nBy A. Writer\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='related-work'><p>{OTHER}</p></div><div class='related-posts'><p>Read on</p></div></article>", f"{LONG}\n{OTHER}"),
    (f"<article><section class='social-history'><p>{LONG}</p></section><div class='social-buttons'><p>Tell a friend</p></div></article>", LONG),
    (f"<article><div class='hidden-gems'><p>{LONG}</p></div><h2 id=share>Share of votes</h2><p>{OTHER}</p></article>", f"{LONG}\nShare of votes\n{OTHER}"),
    (f"<article><p>{LONG}</p><p>See:</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><p>{OTHER}</p><ul><li><a href=c>Three</a></li><li><a href=d>Four</a></li></ul></article>", f"{LONG}\nSee:\nOne\nTwo\n{OTHER}"),
    (f"<div><h1>T</h1><p>{LONG}</p><p>{OTHER}</p></div><div><h3>3 Comments</h3><div><b>Bob</b><p>{LONG}</p></div><div><b>Al</b><p>{OTHER} Yes.</p></div></div>", f"T\n{LONG}\n{OTHER}"),
    (f"<main><h1>T</h1><p>{LONG}</p><p>{OTHER}</p><h3>Kommentare (2)</h3><div><p>{LONG} Ja.</p></div><div><p>{OTHER} Nein.</p></div></main>", f"T\n{LONG}\n{OTHER}"),
    (f"<article><p>{LONG}</p><h2>Comments</h2><p>{OTHER}</p><h2>End</h2><p>{LONG}</p></article>", f"{LONG}\nComments\n{OTHER}\nEnd\n{LONG}"),
]


@pytest.mark.parametrize("page,text", ARTICLES)
def test_articles(page, text):
    assert html.main_text(page) == text


def test_operator(spark, small):
    rows = [(i, None if i == 3 else f"http://x/{i}", p, "extra") for i, (p, _) in enumerate(PAGES)] + [(None, "u", "<p>x</p>", "e")] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html.extract_main_text(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == sorted([(str(i), t, len(t)) for i, (_, t) in enumerate(PAGES)] + [("None", "x", 1)] * 2)
    assert html.extract_main_text(pages.limit(0)).count() == 0
    real = html.extract_main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()
    assert real and all(r.n_chars == len(r.text) and "<script" not in r.text for r in real)


def test_long_and_deep_pages():
    assert html.main_text("<div>" * 20_000 + f"<p>{LONG}</p>") == LONG
    assert html.main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    assert html.main_text("<a " * 20_000) is not None


def test_time_is_linear():
    n = 100_000
    for page in ("<div>" * n + "x</q>" * n, "<p><table>" + "<div>" * n, "<li>" * n, "</p>" * n, "<td>" * n + "<p>" * n, "<a <b" * n, "<" * n, "&amp;" * n, "<p>x</p>" + "<ul><li><a>l</a><li><a>m</a></ul>" * (n // 4), "<div>3 Comments</div>" * (n // 4)):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10


def plain_text(page):
    """The driver's pages are made with <article>: its blocks by the standard library's parser, by themselves."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.inside, self.blocks = [], 0, [""]

        def handle_starttag(self, tag, attrs):
            if tag in html.VOID:
                self.blocks[-1] += " " if tag == "br" else ""
                return
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            if self.skip or tag in html.DROPPED or any(html._names_noise(t, tag) for t in names.split()):
                self.skip.append(tag)
            elif tag == "article":
                self.inside += 1
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_endtag(self, tag):
            if self.skip:
                if tag in self.skip:
                    while self.skip.pop() != tag:
                        pass
            elif tag == "article":
                self.inside -= 1
            if tag not in html.INLINE:
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    return "\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


def test_articles_of_the_table_equal_a_plain_reader(spark, small):
    """Pages with one article element and no list of links in it."""
    pages = spark.read.parquet(f"{small}/pages.parquet").where("html is not null").collect()
    own = [r.html for r in pages if r.html.count("<article") == 1 == r.html.count("</article>")]
    same = sum(html.main_text(h) == plain_text(h) for h in own)
    assert len(own) > len(pages) / 4 and same / len(own) >= 0.9, (len(pages), len(own), same)
