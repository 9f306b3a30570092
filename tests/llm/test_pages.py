from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pytest

from slopeworks.llm.pages import extract, main_text

PROSE = "The house by the river was old and it had been there for as long as any of them could remember. "
LONG = (PROSE * 4).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<article><h1>Title</h1><p>One &amp; two&nbsp; three</p></article>", "Title\n\nOne & two three"),
        (f"<nav><a href=x>Home</a></nav><p>{LONG}</p><footer>{LONG}</footer>", LONG),
        (f"<article><p>{LONG}<p>Short line.<br>More</article><aside>{LONG}</aside>", f"{LONG}\n\nShort line. More"),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p><div id=comments><p>{LONG}</p></div></article>", LONG),
        (f"<article><script>if (a < b) '</p>'</script><p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p></form></article>", LONG),
        (f"<p>{LONG}</p><p>Between.</p><p>{LONG}</p><ul><li><a href=a>one two</a></li></ul>", f"{LONG}\n\nBetween.\n\n{LONG}"),
        ("<article><p>un<b>brok</b>en</p><p>a\n\t b</p></article>", "unbroken\n\na b"),
        (f"<div class=ad>{LONG}</div><article><p>zzz zzz zzz</article>", "zzz zzz zzz"),
        (f"<header><h1>Site</h1></header><main><header><h1>Story</h1></header><p>{LONG}</p></main>", f"Story\n\n{LONG}"),
        (f"<p>{LONG}<script>never closed <p>{LONG}", LONG),
        ("<a <b <c", ""),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


# Two sentences of prose in six languages and three scripts.
TONGUES = {
    "en": "The boat came back to the harbour in the evening, and the people who had waited for it were glad. ",
    "it": "La barca tornò al porto verso sera e la gente che la aspettava sulla riva era contenta di vederla. ",
    "pl": "Łódź wróciła wieczorem do portu, ludzie czekający na brzegu ucieszyli się bardzo z jej powrotu. ",
    "ru": "Лодка вернулась вечером в гавань, и люди, ждавшие её на берегу, очень обрадовались возвращению. ",
    "zh": "傍晚时分小船回到了港口,在岸边等候的人们都非常高兴,大家一起把鱼搬到市场上去卖,直到天黑才回家休息。",
    "de": "Das Boot kam am Abend in den Hafen zurück, und die Leute, die darauf gewartet hatten, waren froh. ",
}
LINKS = "<ul><li><a href=a>one two</a></li><li><a href=b>three</a></li></ul>"


@pytest.mark.parametrize("tongue", sorted(TONGUES))
def test_prose_in_any_language(tongue):
    first, second = (TONGUES[tongue] * 5).strip(), (TONGUES[tongue] * 4).strip()
    page = f"<body><nav>{LINKS}</nav><div><p>{first}</p><p>{second}</p></div><footer>{second}</footer></body>"
    assert main_text(page) == f"{first}\n\n{second}"
    page = f"<div class=sidebar>{first}</div><article><h1>{first[:12]}</h1><p>{second}</p><p>{first[:9]}.</p></article>{LINKS}"
    assert main_text(page) == f"{first[:12]}\n\n{second}\n\n{first[:9]}."


CELL = "Bergen 12 March 1974, 14 knots, Captain Olsen; Tromso 19 March 1974, 11 knots, Captain Dahl; Vardo 2 April 1974, 9 knots"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article class='post share-enabled'><p>{LONG}</article>", LONG),
        (f"<article class='nav-open'><p>{LONG}</article>", LONG),
        (f"<div class='layout with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<article><div class='article-header'><h1>Story</h1></div><p>{LONG}</article>", f"Story\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p>See <a href=x>the whole account of the house by the river</a>.</p></article>",
         f"{LONG}\n\nSee the whole account of the house by the river."),
        (f"<nav>{LINKS}</nav><h1>Story</h1><article><p>{LONG}</p></article>", f"Story\n\n{LONG}"),
        (f"<header><h1>Site</h1></header><article><p>{LONG}</p></article>", LONG),
        (f"<p>{LONG}</p><table><tr><td>{CELL}</td></tr></table><p>{LONG}</p>", f"{LONG}\n\n{CELL}\n\n{LONG}"),
        *((f"<article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>", LONG)
          for name in ("site-footer", "post-comments", "commentList", "related-posts related", "x ads", "newsletter-box", "ad-2")),
        (f"<main><p>{LONG}</p><article class=comment><p>{LONG}</p></article></main>", LONG),
    ],
)
def test_articles_stay_whole(page, text):
    assert main_text(page) == text


class Tree(HTMLParser):
    """A second extraction, from a tree: what is under an article or main, less what is under boilerplate tags."""

    VOID = frozenset("br img hr meta input link".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.blocks, self.open = [], [], True
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag == "p" and self.path and self.path[-1] == "p":
            self.path.pop()
        if tag not in self.VOID:
            self.path.append(tag)
        self.open = self.open or tag not in ("b", "a", "i", "em", "br")

    def handle_endtag(self, tag):
        while tag in self.path and self.path.pop() != tag:
            pass
        self.open = self.open or tag not in ("b", "a", "i", "em")

    def handle_data(self, data):
        if {"article", "main"} & set(self.path) and not {"nav", "aside", "footer", "form", "script", "style"} & set(self.path):
            if self.open or not self.blocks:
                self.blocks.append("")
            self.blocks[-1] += data
            self.open = False

    def text(self):
        return "\n\n".join(t for t in (" ".join(block.split()) for block in self.blocks) if t)


def test_against_a_tree(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for tongue in TONGUES.values():
        parts = [f"<p>{tongue * k}</p>" for k in (1, 4, 2)]
        pages.append(f"<nav>{LINKS}</nav><main><h2>{tongue[:9]}</h2>{''.join(parts)}<aside>{parts[1]}</aside></main><footer>{tongue}</footer>")
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'u' as url")
    found = {r.page_id: r.text for r in extract(frame).collect()}
    assert [k for k, page in enumerate(pages) if found[k] != Tree(page).text()] == []


def test_very_long_and_broken_pages():
    assert main_text(f"<article>{'<p>' + LONG} " * 2000).count("\n\n") == 1999
    for broken in ("<div>" * 50_000, "<a href='" * 20_000, "<div></ul>" * 20_000, "<" * 50_000):
        assert main_text(broken) == "" or broken[0] == "<"


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>"), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<p>x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as k0")
    found = sorted((tuple(r) for r in extract(frame).collect()), key=str)
    assert found == sorted([(1, "u", LONG), (2, None, ""), (3, "v", ""), (3, "v", ""), (None, "w", "")], key=str)
    assert extract(frame.filter("page_id > 5")).count() == 0


def test_the_given_pages(spark):
    """Pages of the given table hold one article: its headline and paragraphs, and nothing else."""
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract(frame).collect()}
    for row in frame.collect():
        article = re.search("<article>(.*?)</article>", row.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<b>", "").replace("<br>", " "))
        blocks = [" ".join(html.unescape(block).split()) for block in blocks]
        assert texts[row.page_id] == "\n\n".join(block for block in blocks if block)
