"""A tolerant HTML reader: tags, texts and the blocks that they form."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Elements without content, elements whose content is no markup, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html head body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary dialog hr title script style noscript template textarea select option button iframe".split()
)
#: Elements whose text is never main text.
NO_TEXT = frozenset("head title script style noscript template nav header footer aside form fieldset button select option textarea iframe dialog menu svg canvas object audio video map xmp noembed noframes".split())
#: Words of a class or id that name what is around an article, and words that may stand beside them in one name.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets "
    "footer header masthead comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations pagination pager toolbar skip login copyright disclaimer".split()
)
BESIDE = frozenset(
    "area bar block body bottom box button buttons column container content first group holder icons inner item items last left link links list main module outer page panel pane post posts article articles "
    "right row section site slot small story stories thread top unit user reader wrap wrapper".split()
)
#: Words that make a header the one of the article itself.
OWN = frozenset("article articles post posts story stories".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that a start tag closes if they are open and innermost.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)|[^>]*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Marks of a role: none; no main text by HTML's rules; named as around an article; an article or main element; a heading; the page as a whole.
PLAIN, APART, NAMED, ARTICLE, HEADING, ROOT = range(6)
_MARKS = dict.fromkeys(("article", "main"), ARTICLE) | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), HEADING) | dict.fromkeys(("html", "body"), ROOT)


def mark_of(name: str, attributes: str) -> int:
    """What an element's name and attributes say of its text."""
    if name in NO_TEXT:
        return APART
    mark = _MARKS.get(name, PLAIN)
    if not attributes or mark == ROOT:
        return mark
    named = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            named = named or mark != ARTICLE and any(_named(part) for part in value.split())
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return APART
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return APART
    return NAMED if named else mark


def _named(part: str) -> bool:
    """Whether a class or id consists of words for what is around an article."""
    words = _WORD.findall(_CAMEL.sub("-", part).lower())
    around = [w for w in words if w in AROUND]
    if around == ["header"] and OWN.intersection(words):
        return False
    return bool(around) and all(w in AROUND or w in BESIDE or w.isdigit() for w in words)


class Page(NamedTuple):
    roles: list[str]  # one for every start and end of an element that is a block or marked, and every block of text, in order
    up: list[int]  # for each role the place of the start that it stands in, or -1
    marks: list[int]
    blocks: list[tuple[int, str, float]]  # place of the role, text (decoded, white space as one space, trimmed), share of it that stands in links


def _key(attributes: str) -> str:
    found = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
    return "".join(f"{mark}{' '.join(found[n].split())}" for n, mark in (("class", "."), ("id", "#")) if found.get(n))


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(what, name or text, attributes); what is 'start', 'end' or 'text'. Comments and declarations are left out."""
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is not None:
            name = name.lower()
            if m[1]:
                yield "end", name, ""
                continue
            yield "start", name, m[3]
            if name in RAW and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                body = source[at : stop.start() if stop else end]
                if body:
                    yield "text", body, name
                at += len(body)
        elif m[0][0] != "<" or len(m[0]) == 1:
            yield "text", m[0], ""
        elif m[0].startswith("<![CDATA["):
            yield "text", m[0][9:].removesuffix("]]>"), ""


def read(source: str) -> Page:
    """Roles and blocks of a page. Unclosed and wrongly nested tags are read as browsers roughly do."""
    stack: list[tuple[str, str, int]] = []  # name, path, place of the start
    page = Page([], [], [], [])
    parts: list[str] = []
    links = in_link = 0

    def add(role: str, up: int, mark: int) -> int:
        page.roles.append(role)
        page.up.append(up)
        page.marks.append(mark)
        return len(page.roles) - 1

    def top() -> tuple[str, str, int]:
        return stack[-1] if stack else ("", "", -1)

    def start(name: str, attributes: str, mark: int) -> None:
        _, path, place = top()
        path = f"{path}/{name}{_key(attributes)}"
        stack.append((name, path, add(path, place, mark)))

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, path, place = top()
                page.blocks.append((add(f"{path}|{text}", place, PLAIN), text, min(1.0, links / len(text))))
            parts.clear()
        links = 0

    for what, name, more in tokens(source):
        if what == "text":
            parts.append(name)
            if in_link:
                links += len(" ".join(name.split()))
        elif name == "a":
            in_link = 1 if what == "start" else 0
        elif name == "br":
            parts.append("\n")
        elif name not in BLOCK and name not in NO_TEXT:
            if what == "start" and name not in VOID and (mark := mark_of(name, more)) in (APART, NAMED):
                close()  # an inline element that is marked is a block of its own
                start(name, more, mark)
            elif what == "end" and stack and stack[-1][0] == name:
                close()
                stack.pop()
        elif what == "start":
            close()
            in_link = 0
            if name in CLOSES:
                while stack and stack[-1][0] in CLOSES[name]:
                    stack.pop()
            while stack and stack[-1][0] == "p":
                stack.pop()
            if name == "body":
                while stack and stack[-1][0] == "head":
                    stack.pop()
            if name not in VOID:
                start(name, more, mark_of(name, more))
        else:
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    add(f"{stack[i][1]}/", stack[i][2], PLAIN)
                    del stack[i:]
                    break
    close()
    return page
