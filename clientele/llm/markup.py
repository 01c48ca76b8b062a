"""HTML as blocks of text with the path of elements that hold each."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")

#: Fixed values from the HTML standard: elements by how they treat text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split())
#: An element of the first kind ends an open one of the second, unless the third stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("thead", "tbody"), ("table",)), "body": (("head",), ()),
}
_FLOW = BLOCKS - {"html", "body", "head", "title"}  # any of these ends an open paragraph

#: Elements, roles and words of class or id that are furniture of a page, not its article.
CHROME_TAGS = frozenset("nav aside footer head title button select menu dialog svg object canvas".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo "
    "promoted related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
COMMENT_WORDS = frozenset("comment comments disqus reply".split())
#: Words of those that name subjects as well, and words that leave such a name a piece of furniture.
SUBJECT_WORDS = frozenset("menu notice notices related share sharing skip social sponsor".split())
COMPANIONS = frozenset(
    "area article articles bar block bottom box button buttons card cards container content entries entry footer group "
    "header heading icon icons inner item items left link links list main media module more news outer page pages panel "
    "post posts reading right row section site stories story text title top topics wrap wrapper".split())
NEGATIONS = frozenset("has hide is no not with without".split())  # "no-sidebar" is not a sidebar
MAX_DEPTH = 128  # elements of a path; deeper text counts to the element at that depth
_MOST = 0.7  # share of a page's text that makes a marked element its frame
_PROSE_WORDS = 25
_WORD = re.compile(r"[A-Za-z]+")


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    chrome: bool


class _Open(NamedTuple):
    """An open element: what text directly in it belongs to."""

    tag: str
    path: tuple[str, ...] = ()
    nest: int = 0  # block elements around the text
    hard: bool = False  # in furniture whatever the page looks like
    marked: tuple[int, ...] = ()  # the marked elements around it
    region: bool = False  # in an article or main
    link: bool = False


@dataclass
class _Marked:
    """An element whose class, id or kind says furniture; the page decides."""

    comment: bool = False
    subject: bool = False
    region: bool = False  # stands inside an article or main
    first: bool = False  # holds the page's first article or main
    chars: int = 0
    in_region: int = 0
    linked: int = 0
    words: int = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _key(tag: str, attrs: dict[str, str]) -> str:
    """The element as a wrapper knows it: tag, class and id, numbers made alike."""
    marks = " ".join(attrs.get(k, "") for k in ("class", "id")).split()
    return _DIGITS.sub("0", ".".join([tag, *sorted(marks)])) if marks else tag


def _hard(tag: str, attrs: dict[str, str], region: bool) -> bool:
    return (tag in CHROME_TAGS or "hidden" in attrs or (tag == "header" and not region)
            or attrs.get("role", "").lower() in CHROME_ROLES)


def _marked(tag: str, attrs: dict[str, str]) -> _Marked | None:
    if tag in ("html", "body", "main"):
        return None
    furniture = COMMENT_WORDS if tag == "article" else CHROME_WORDS
    hits = []
    for mark in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = _WORD.findall(mark)
        if parts and parts[0] not in NEGATIONS and not furniture.isdisjoint(parts):
            hits.append(set(parts))
    if not hits:
        return _Marked() if tag == "form" or attrs.get("role", "").lower() == "form" else None
    return _Marked(comment=any(h & COMMENT_WORDS for h in hits),
                   subject=all(h & CHROME_WORDS <= SUBJECT_WORDS and h - CHROME_WORDS - COMPANIONS for h in hits))


def _furniture(marked: list[_Marked], found: list[tuple[str, _Open, int]]) -> set[int]:
    """Which marked elements of a page are furniture.

    Not the one that holds the article: the page's first ``article`` or ``main`` with half of the text
    in such, or, on a page without, most of its text. Nor a passage of prose whose name only shares a
    word with furniture ("related-work").
    """
    for text, at, linked in found:
        for i in at.marked:
            m = marked[i]
            m.chars += len(text)
            m.in_region += len(text) if at.region else 0
            m.linked += linked
            m.words += len(text.split()) if not linked else 0
    replies = {i for i, m in enumerate(marked) if m.comment and not m.first}
    total = sum(len(t) for t, at, _ in found if not at.hard)
    inside = sum(len(t) for t, at, _ in found if at.region and not at.hard and replies.isdisjoint(at.marked))
    out = set()
    for i, m in enumerate(marked):
        if m.region:
            kept = not m.comment and m.in_region >= _MOST * inside
        elif inside:
            kept = m.first and 2 * m.in_region >= inside and (not m.comment or 2 * m.chars >= total)
        else:
            kept = 2 * m.linked < m.chars and m.chars >= (0.9 if m.comment else _MOST) * total
        if not kept and not (m.subject and m.words >= _PROSE_WORDS and 4 * m.linked < m.chars):
            out.add(i)
    return out


def blocks(page: str | None) -> list[Block]:
    """The text blocks in page order, white space as single spaces, references decoded.

    Unclosed and stray tags are taken as a browser would: a paragraph ends where another block
    starts, an element where one around it ends, and a closing tag without an open element is nothing.
    A path ends at MAX_DEPTH elements; no text is lost by that.
    """
    if not page:
        return []
    marked: list[_Marked] = []
    found = list(_pieces(page, marked))
    if not marked:
        return [Block(at.path, text, at.hard) for text, at, _ in found]
    out = _furniture(marked, found)
    return [Block(at.path, text, at.hard or not out.isdisjoint(at.marked)) for text, at, _ in found]


def _pieces(page: str, marked: list[_Marked]) -> Iterator[tuple[str, _Open, int]]:
    """(text, where, characters in links) of every block; ``marked`` gets the marked elements."""
    outside = _Open("")
    stack: list[_Open] = []
    words: list[str] = []
    linked = 0
    at, n = 0, len(page)
    regions = False

    def spoken() -> tuple[str, _Open, int] | None:
        nonlocal words, linked
        text = " ".join(html.unescape("".join(words)).split())
        got, words, linked = min(linked, len(text)), [], 0
        return (text, stack[-1] if stack else outside, got) if text else None

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            words.append(m["text"])
            if stack and stack[-1].link:
                linked += len(m["text"].strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if depth is None:
                continue
            below = stack[depth - 1] if depth else outside
            if stack[-1].nest != below.nest or stack[-1].hard != below.hard or stack[-1].marked != below.marked:
                if block := spoken():
                    yield block
            del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end and not m["attrs"].endswith("/") else (at if m["attrs"].endswith("/") else n)
            words.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                if block := spoken():
                    yield block
            else:
                words.append(" " if tag == "br" else "")
            continue
        attrs = _attributes(m["attrs"])
        up = stack[-1] if stack else outside
        hard = _hard(tag, attrs, up.region)
        mark = None if hard else _marked(tag, attrs)
        if tag in BLOCKS or hard or mark:
            if block := spoken():
                yield block
        if tag in BLOCKS:
            if tag in _FLOW:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in _FLOW:
                        break
            ends, stops = ENDS.get(tag, ((), ()))
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in stops:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
            up = stack[-1] if stack else outside
        path = (*up.path, _key(tag, attrs)) if tag in BLOCKS and len(up.path) < MAX_DEPTH else up.path
        region, around = up.region, up.marked
        if tag in ("article", "main") and not (mark and mark.comment):
            if not regions:
                regions = True
                for i in around:
                    marked[i].first = True
            region = True
        if mark:
            mark.region = up.region
            around = (*around, len(marked))
            marked.append(mark)
        stack.append(_Open(tag, path, up.nest + (tag in BLOCKS), up.hard or hard, around, region, up.link or tag == "a"))
    if block := spoken():
        yield block
