"""Leaf blocks of a page: runs of inline content between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Fixed values of HTML: elements that do not break a block, that have no end tag, whose content is not page text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head noscript template svg math object audio video canvas select datalist".split())
#: An opening tag closes these open elements first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What may stand in a head; anything else, text too, ends it and begins the body.
OF_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements of another vocabulary, where a tag can close itself.
FOREIGN = frozenset(("svg", "math"))

_OPEN = re.compile(r"<(?=[A-Za-z/!?])")
#: A tag by the grammar of HTML: only a value after an equals sign can be quoted.  Quantifiers give nothing back, so time is linear.
_TAG = re.compile(r"""</?+([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)>""")
#: Where that finds no end: up to the next angle bracket.
_LAX_TAG = re.compile(r"</?+([A-Za-z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
_BOGUS = re.compile(r"<!\[CDATA\[.*?\]\]>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")  # a change of case begins a word


class Node:
    """An open element: its tag, the words of its class, id and role, its parent, and the form that it is in."""

    __slots__ = ("chars", "form", "known", "parent", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.form = self if tag == "form" else parent.form if parent else None
        self.chars = 0  # of a form: the characters of its blocks
        self.known = None  # for a caller's notes


class Block(NamedTuple):
    text: str
    #: The innermost open element where the text begins, or None.
    node: Node | None
    #: The share of the text's characters inside links.
    linked: float


def _words(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            out += [w.lower() for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return tuple(out)


def _closes_itself(attributes: str) -> bool:
    """Whether the last slash belongs to no unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attributes):
        pass
    return last is None or last[4] is None or last.end() < len(attributes)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; white space in a block is one space, and empty blocks are left out.

    A missing head or body tag, attribute values with stray quotes, tags that close themselves, and comments
    and tags without an end are read as browsers do or, where those would show nothing, as little
    markup as possible.  Text that a browser would hide (``hidden``, ``display:none``) is text like any other, as
    pages show such parts later.
    """
    out: list[Block] = []
    path: list[Node] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = hidden = 0
    began: tuple[Node | None] | None = None

    def end_block() -> None:
        nonlocal linked, began
        if began is not None:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, began[0], min(1.0, linked / max(1, len(text)))))
                if began[0] is not None and began[0].form is not None:
                    began[0].form.chars += len(text)
        parts.clear()
        linked, began = 0, None

    def say(text: str) -> None:
        nonlocal linked, began
        if not text:
            return
        if path and path[-1].tag == "head" and not text.isspace():
            pop()
        if not hidden:
            parts.append(text)
            if began is None and not text.isspace():
                began = (path[-1] if path else None,)
            if open_["a"]:
                linked += len(text)

    def push(tag: str, words: tuple[str, ...]) -> None:
        nonlocal hidden
        path.append(Node(tag, words, path[-1] if path else None))
        open_[tag] += 1
        hidden += tag in UNSEEN

    def pop() -> None:
        nonlocal hidden
        tag = path.pop().tag
        open_[tag] -= 1
        hidden -= tag in UNSEEN

    while at < len(page):
        begin = _OPEN.search(page, at)
        if begin is None:
            say(page[at:])
            break
        say(page[at : begin.start()])
        at = begin.start()
        if page.startswith("<!--", at):
            token = _COMMENT.match(page, at) or _BOGUS.match(page, at)
            at = token.end() if token else len(page)
            continue
        token = _TAG.match(page, at) or _LAX_TAG.match(page, at)
        if token is None:
            token = _BOGUS.match(page, at) if page[at + 1] in "!?/" else None
            if token is None:
                if page.find(">", at) < 0:
                    say(page[at:])  # no more markup
                    break
                say("<")
                at += 1
                continue
            at = token.end()
            if token[0].startswith("<![CDATA["):
                say(html.escape(token[0][9:].removesuffix("]]>"), quote=False))
            continue
        closing, at = page[at + 1] == "/", token.end()
        tag, attributes = token[1].lower(), token[2]
        if tag not in INLINE:
            end_block()
        if closing:
            if open_[tag]:
                for k in range(len(path) - 1, -1, -1):
                    if path[k].tag == tag:
                        while len(path) > k:
                            pop()
                        break
                    if tag in INLINE and path[k].tag not in INLINE:
                        break
            continue
        if path and path[-1].tag == "head" and tag not in OF_HEAD:
            pop()
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if (tag in FOREIGN or open_["svg"] or open_["math"]) and _closes_itself(attributes):
            continue
        if tag == "body" and open_["head"]:
            while open_["head"]:
                pop()
        closed = CLOSES.get(tag, ()) or (("p",) if tag in CLOSES_P else ())
        if any(open_[x] for x in closed):
            k = len(path) - 1
            while k >= 0 and (path[k].tag in closed or path[k].tag in INLINE or path[k].tag == "p"):
                k -= 1
            if any(x.tag in closed for x in path[k + 1 :]):
                while len(path) > k + 1:
                    pop()
        push(tag, _words(attributes) if attributes else ())
    end_block()
    return out
