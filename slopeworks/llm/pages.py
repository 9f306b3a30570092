"""Operator 5: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; each block knows its length, the share of its characters
inside links, the share of its words that are stop words, and its container: boilerplate (by tag, or by a
word in its class or id), article, or neither.

First pass: blocks in boilerplate containers and blocks made of links are bad, but not running paragraphs and
headlines of an article; long blocks with many stop words are good; the others are undecided.  Where a page's blocks
have next to no known stop words, its language is not among those of the list, and length alone decides (a character of a
script without spaces counts as three).  Second pass: undecided blocks take the label of the nearest decided block
on either side; where the sides differ, blocks with some stop words are good and short ones follow the nearer side (a
tie is good).  An article's blocks look no further than the article, and are good where it has no decided block.  If an
article has good blocks, blocks outside any are bad, but for the last top headline before an article without one.

A container is boilerplate by its tag, or by a class, id or role all of whose parts say so or are neutral
(``site-footer``); ``share-enabled`` is none, and no class makes an article boilerplate.

The text is the good blocks in page order with an empty line between; character references are decoded, white
space within a block is one space.  Null and empty pages have an empty text; an unclosed comment, script or style
reaches to the end of the page.  Every input row gives one output row, repeated rows and rows without an id included,
and an empty table gives none; a very long page is a block of its own; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from slopeworks.llm.blocks import column_of, row_blocks

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.12, 0.22
# A page with a smaller share of known stop words is in another language.
STOPS_KNOWN = 0.06
LINKS_HIGH = 0.34

# HTML elements by their part in a page.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset(
    "article aside body blockquote dialog div dl fieldset figure footer form head header main menu nav noscript ol "
    "section table title ul".split()
)
_BOILERPLATE_TAGS = frozenset("aside dialog footer form head header menu nav noscript title".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_SKIPPED_TAGS = (
    "script|style|template|svg|math|iframe|object|select|textarea|button|noframes|canvas|audio|video|xmp"
)
# Words of class and id names that mark boilerplate.
_BOILERPLATE_NAMES = frozenset(
    "ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer form header legal login masthead menu modal nav navbar navigation newsletter notice pager "
    "pagination popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor "
    "sponsored subscribe tags teaser toolbar widget".split()
)
# Words of class and id names that say nothing by themselves, and those that mark the main text.
_NEUTRAL_NAMES = frozenset(
    "area bar block bottom box container div global group inner item items left link links list main module outer page panel "
    "primary right row secondary section site top wrap wrapper".split()
)
_MAIN_NAMES = frozenset("article content entry post story text".split())
# Boilerplate words that name a part of the article behind a word for the main text.
_PART_NAMES = frozenset("banner header masthead".split())
_HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())
# Frequent function words.
_STOPS = frozenset(
    """a about after all also an and are as at be because been but by can could for from had has have he her his if in
    into is it its more no not of on one or other our she so some such than that the their them then there these they
    this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer er es
    für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor
    war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nos
    nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous
    al como con cuando de del desde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o
    para pero por porque que se sea ser si sin sobre son su sus también te un una unos y ya""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>{_SKIPPED_TAGS})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=skip)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_COMMENT_NAMES = frozenset("comment comments reply replies".split())
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    linked: float
    kind: str | None  # "bad", "article" or None
    region: int  # number of the article it is in, or 0
    tag: str = ""  # the block-level tag it stands in

    @property
    def running(self) -> bool:
        """A paragraph or headline of an article."""
        return bool(self.region) and self.kind == "article" and (self.tag == "p" or self.tag in _HEADLINES)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, str | None, int]] = []
    open_tags: dict[str, int] = {}
    kind: str | None = None
    region = articles = links = 0
    block_tag = ""
    parts: list[str] = []
    linked_parts: list[str] = []

    def close() -> None:
        nonlocal links
        links = 0  # a link does not outlive its block
        text = " ".join("".join(parts).split())
        if text:
            linked = len(" ".join("".join(linked_parts).split()))
            found.append(Block(text, linked / len(text), kind, region, block_tag))
        parts.clear()
        linked_parts.clear()

    def add(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked_parts.append(text)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if token["end"] else 1
        elif tag in _BLOCK_TAGS:
            close()
            block_tag = "" if token["end"] else tag
            if tag not in _CONTAINERS:
                continue
            if not token["end"]:
                stack.append((tag, kind, region))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                own = _kind_of(tag, token["rest"], region)
                if own == "article" and (kind != "article" or region == 0):
                    articles += 1
                    region = articles
                kind = own or kind
            elif open_tags.get(tag):
                name = ""
                while name != tag:
                    name, kind, region = stack.pop()
                    open_tags[name] -= 1
    if at < len(page):
        add(page[at:])
    close()
    return found


def _kind_of(tag: str, rest: str, region: int) -> str | None:
    """What a container makes of its blocks; None leaves it to the container around it."""
    if tag in _ARTICLE_TAGS:
        # A comment may be marked up as an article of its own.
        return "bad" if tag == "article" and _named(rest, _COMMENT_NAMES) else "article"
    if tag in _BOILERPLATE_TAGS and not (tag == "header" and region):
        return "bad"
    return "bad" if tag != "body" and _named(rest) else None


def _named(rest: str, names: frozenset[str] = _BOILERPLATE_NAMES) -> bool:
    """Whether a class, id or role says boilerplate as a whole."""
    for groups in _NAMES.findall(rest) if rest else ():
        for name in "".join(groups).split():
            # Parts between marks, digits and changes to upper case.
            parts = {part.lower() for part in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
            said = parts & names
            if parts & _MAIN_NAMES:
                said -= _PART_NAMES
            if said and parts <= said | _NEUTRAL_NAMES | _MAIN_NAMES:
                return True
    return False


def _length(text: str) -> int:
    """Characters, those of scripts without spaces counted as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(word in _STOPS for word in words) / max(len(words), 1)


def known_language(blocks: list[Block]) -> bool:
    """Whether the page's text outside boilerplate has stop words of the list."""
    return _stop_share("\n".join(block.text for block in blocks if block.kind != "bad" and block.linked <= LINKS_HIGH)) >= STOPS_KNOWN


def first_pass(block: Block, known: bool = True) -> str:
    """``good``, ``bad``, or undecided: ``near`` (with some stop words) or ``short``; without a ``known`` language by
    length."""
    if block.kind == "bad" or (block.linked > LINKS_HIGH and not block.running):
        return "bad"
    length = _length(block.text)
    if length < LENGTH_LOW:
        return "bad" if block.linked and not block.region else "short"
    stops = _stop_share(block.text) if known else STOPS_HIGH
    if stops >= STOPS_HIGH:
        return "good" if length >= LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW else "short"


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is good once the undecided ones have taken their neighbours' labels."""
    nearest: list[list[tuple[str, int] | None]] = [[None, None] for _ in blocks]
    for side, order in ((0, range(len(blocks))), (1, range(len(blocks) - 1, -1, -1))):
        last: dict[int, tuple[str, int]] = {}
        for at in order:
            # Blocks of one article, or all blocks outside any, are neighbours.
            nearest[at][side] = last.get(blocks[at].region)
            if labels[at] in ("good", "bad") and not (blocks[at].region and blocks[at].kind == "bad"):
                last[blocks[at].region] = (labels[at], at)
    good = []
    for at, (block, label) in enumerate(zip(blocks, labels, strict=True)):
        if label in ("good", "bad"):
            good.append(label == "good")
            continue
        sides = [side for side in nearest[at] if side]
        seen = {side[0] for side in sides}
        if not sides:
            good.append(bool(block.region) or label == "near")
        elif len(seen) == 1:
            good.append("good" in seen)
        elif label == "near":
            good.append(True)
        else:
            good.append(min(sides, key=lambda side: (abs(side[1] - at), side[0] == "bad"))[0] == "good")
    inside = [at for at, block in enumerate(blocks) if good[at] and block.region]
    if inside:
        good = [own and bool(block.region) for own, block in zip(good, blocks, strict=True)]
        if not any(blocks[at].tag == "h1" for at in inside):
            tops = [at for at in range(inside[0]) if blocks[at].tag == "h1" and blocks[at].kind is None]
            if tops and labels[tops[-1]] != "bad":
                good[tops[-1]] = True
    return good


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    known = known_language(blocks)
    good = second_pass(blocks, [first_pass(block, known) for block in blocks])
    return "\n\n".join(block.text for block, own in zip(blocks, good, strict=True) if own)


def extract(df: DataFrame, html_column: str = "html", kept: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text`` for every row."""

    def run(batches):
        for block in row_blocks(batches, "html"):
            texts = [main_text(page) if page else "" for page in column_of(block, "html").to_pylist()]
            own = [block.column(place) for place in range(block.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], [*names, "text"])

    names = [f"k{place}" for place in range(len(kept))]
    rows = df.select(
        *[df[name].alias(own) for name, own in zip(kept, names, strict=True)], df[html_column].cast("string").alias("html")
    )
    fields = [f"{own} {df.schema[name].dataType.simpleString()}" for name, own in zip(kept, names, strict=True)]
    return rows.mapInArrow(run, ", ".join([*fields, "text string"])).toDF(*kept, "text")
