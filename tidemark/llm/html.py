"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags.  The first pass decides a block by where it
stands, the density of its links, its length and the density of stop words; short blocks
and those with few stop words stay open.  In the second pass an open block takes the label
of the nearest decided block, before or after it.

A page that has an article (or main) element with text has its main text there.  Names of
classes and ids are evidence for the first pass; they don't count where no other block is
main text.

Defined results: null or empty html, and pages without such blocks, give the empty text;
unclosed and crossing tags close with their parents; markup cut off at the end of the page
is dropped; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINK_DENSITY = 0.33
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.25

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their them
    they this to was we were which who will with you all can more one so there what when would
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es
    für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und von vor war
    was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou
    par pas plus pour qu que qui sa se ses si son sont sur un une vous y
    al como con de del donde el ella en entre era es esta este ha han la las le lo los más me mi muy no nos o para pero
    por que se ser si sin sobre su sus también un una y ya
    """.split()
)

#: Names of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template svg math title iframe object canvas audio video select textarea button datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
ARTICLE_TAGS = frozenset(["article", "main"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the start of a block.
CLOSED_BY_BLOCK = frozenset(["p", "li", "dt", "dd", "td", "th", "tr", "option"])

_BOILERPLATE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|nav\w*|menu|footer|header|masthead|breadcrumbs?|comments?|replies|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|skip|copyright|legal)(?:$|[\s_-])",
    re.I,
)
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCK_START = re.compile(rf"<(?:body|{'|'.join(sorted(BLOCK_TAGS))})\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    article: bool
    boilerplate: bool  # by its elements, roles or being hidden
    named: bool  # by a class or id
    heading: bool


def _set_apart(attributes: str, tag: str) -> tuple[bool, bool]:
    """Whether the attributes of an element say, or its names suggest, that it holds no main text."""
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    named = False
    for name, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in _BOILERPLATE_ROLES):
            return True, named
        named = named or (name in ("class", "id") and tag not in ("html", "body", "article", "main") and bool(_BOILERPLATE_NAME.search(value)))
    return False, named


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def _after(page: str, tag: str, at: int, endless: set[str]) -> int:
    """Where the page goes on after a skipped element: its end tag; without one, the body or the first block.

    ``endless`` holds the elements that have no end tag any more, so that the page isn't searched again for each.
    """
    if tag not in endless:
        if end := _end_of(tag).search(page, at):
            return end.end()
        endless.add(tag)
    block = _BLOCK_START.search(page, at)
    return block.start() if block else len(page)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter, whether each is boilerplate, or named so
    text: list[str] = []
    linked, links, at, breaks = 0, 0, 0, 0
    heading = False
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked, heading
        joined = " ".join("".join(text).split())
        if joined:
            article = any(t in ARTICLE_TAGS for t, _, _ in stack)
            bad = any(b for _, b, _ in stack) or any(t == "header" for t, _, _ in stack) and not article
            out.append(Block(joined, linked, article, bad, any(n for _, _, n in stack), heading))
        text.clear()
        linked, heading = 0, False

    while True:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else len(page)
        if stop > at:
            data = entities.unescape(page[at:stop])
            text.append(data)
            if links:
                linked += len(" ".join(data.split()))
            if breaks and data.strip():
                breaks = 0
        if not token:
            break
        at = token.end()
        slash, tag, attributes = token.group(1), (token.group(2) or "").lower(), token.group(3) or ""
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2:
                close()
            continue
        if tag in SKIPPED_TAGS:
            if not slash and not token.group(0).endswith("/>"):
                at = _after(page, tag, at, endless)
            continue
        if tag == "a":
            links = 0 if slash else 1
            continue
        if tag not in BLOCK_TAGS and tag not in ("span", "ins"):
            continue
        block = tag in BLOCK_TAGS
        if slash:
            if block:
                close()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if block:
            close()
            links = 0
            while stack and stack[-1][0] in CLOSED_BY_BLOCK and (stack[-1][0] == "p" or stack[-1][0] == tag):
                stack.pop()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag not in VOID_TAGS:
            said, named = _set_apart(attributes, tag)
            bad = tag in BOILERPLATE_TAGS or said
            if block or bad or named:
                if (bad or named) and not block:
                    close()
                stack.append((tag, bad, named))
    close()
    return out


def first_pass(block: Block) -> str:
    """good, bad or open.  A name of boilerplate is evidence that only a long, plain text of an article outweighs."""
    if block.boilerplate or block.linked > MAX_LINK_DENSITY * len(block.text):
        return "bad"
    if not block.article and "\N{COPYRIGHT SIGN}" in block.text:
        return "bad"
    words = _WORD.findall(block.text.lower())
    density = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if block.named:
        return "good" if block.article and not block.linked and len(block.text) >= 2 * LONG and density >= STOP_HIGH else "bad"
    if len(block.text) < SHORT:
        return "bad" if block.linked and not block.article else "open"
    if density >= STOP_HIGH or (density >= STOP_LOW and len(block.text) >= LONG):
        return "good"
    return "open" if density >= STOP_LOW or block.article else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is main text; open blocks take the label of the nearest decided one, those in the middle between two the better."""
    inside = any(b.article and label != "bad" for b, label in zip(found, labels))
    apart = [b.boilerplate or b.named and label == "bad" for b, label in zip(found, labels)]  # no neighbours of the text
    body = [i for i, b in enumerate(found) if not apart[i] and (b.article or not inside)]
    decided = [(n, labels[i]) for n, i in enumerate(body) if labels[i] != "open"]
    good = any(label == "good" for _, label in decided)
    keep = [False] * len(found)
    following = 0  # the first decided block at or after the one at hand
    for n, i in enumerate(body):
        while following < len(decided) and decided[following][0] < n:
            following += 1
        after = decided[following] if following < len(decided) else None
        before = decided[following - 1] if following else None
        if labels[i] != "open":
            keep[i] = labels[i] == "good"
        elif not good:
            keep[i] = inside or not decided  # nothing on the page speaks for another block
        elif before is None or after is None:
            keep[i] = (before or after)[1] == "good"
        elif found[i].heading:  # goes with what follows
            keep[i] = after[1] == "good"
        elif after[0] - n == n - before[0]:
            keep[i] = "good" in (before[1], after[1])
        else:
            keep[i] = (after if after[0] - n < n - before[0] else before)[1] == "good"
    return keep


def main_text(page: str | None) -> tuple[str, int]:
    """The text and the number of its blocks; where nothing else is main text, names of boilerplate don't count."""
    found = blocks(page) if page else []
    keep = second_pass(found, [first_pass(b) for b in found])
    if not any(keep) and any(b.named for b in found):
        plain = [b._replace(named=False) for b in found]
        keep = second_pass(plain, [first_pass(b) for b in plain])
    kept = [b.text for b, k in zip(found, keep) if k]
    return "\n".join(kept), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every row of ``pages`` (page_id, url, html)."""

    def run(parts):
        for part in parts:
            got = [main_text(page if isinstance(page, str) else None) for page in part["html"]]
            yield part[["page_id", "url"]].assign(text=[t for t, _ in got], n_chars=[len(t) for t, _ in got], n_blocks=[n for _, n in got])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long")
