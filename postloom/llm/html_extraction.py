"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each block has binary features of its ancestors' tags and class words and of its text; a compound word counts as the
known word that it begins with; a form that holds
most of the page counts as a wrapper, and standing outside an article counts only on pages that have one.  The chain has
weights for features and for neighbouring labels.  It is trained by maximum likelihood
(forward-backward) on labelled pages and decoded by Viterbi.  The tables hold no labelled pages, so the
training pages are laid out by a seeded generator of page designs, whose blocks are labelled as they are
written; their words are random, so the model rests on structure and shape rather than vocabulary.

Pages are independent, so extraction is one pass without a shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Node, blocks
from ..scratch import small_batches

TRAINING_PAGES = 1000
PENALTY = 2e-5
STEPS = 250

#: Words in class, id and role attributes that are features, as found in common page designs.
MAIN_WORDS = ("article", "content", "post", "entry", "story", "main", "body", "text", "prose")
OTHER_WORDS = ("nav", "menu", "sidebar", "footer", "header", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie", "consent", "notice", "alert", "comment", "comments", "reply", "replies", "share", "social", "related", "widget", "subscribe", "newsletter", "breadcrumb", "popup", "modal", "login", "search", "copyright", "navigation", "complementary", "contentinfo", "disqus", "tags", "pagination")
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "ul", "ol", "li", "table", "figure", "figcaption", "blockquote", "pre", "h1", "h2", "h3", "p", "div", "a", "button", "label", "fieldset", "dl", "address", "details", "body")
PARENTS = (*TAGS, "form", "td", "h4", "h5", "h6", "dd", "dt", "other")
SHAPES = ("words<3", "words<6", "words<12", "words<30", "words<80", "words>=80", "no link", "some link", "mostly link", "all link", "ends", "comma", "copyright", "first", "last", "in article", "outside article", "no article", "in form")

NAMES = [*(f"in {x}" for x in TAGS), *(f"at {x}" for x in PARENTS), *(f"word {x}" for x in (*MAIN_WORDS, *OTHER_WORDS)), *SHAPES, "always"]
_AT = {x: k for k, x in enumerate(NAMES)}
_IN = {x: _AT[f"in {x}"] for x in TAGS}
_PARENT = {x: _AT[f"at {x}"] for x in PARENTS}
_WORDS = {x: _AT[f"word {x}"] for x in (*MAIN_WORDS, *OTHER_WORDS)}


@lru_cache(1 << 14)
def _word(word: str) -> int:
    """The feature of a class word, or of the longest known word of three letters or more that it begins with, as a bit; 0 if none."""
    known = max((x for x in _WORDS if x == word or (len(x) > 2 and x != "ads" and word.startswith(x))), key=len, default=None)
    return 0 if known is None else 1 << _WORDS[known]


def _of_node(node: Node | None) -> tuple[int, bool]:
    """A bit for each feature of an element and its ancestors, and whether one of them is an article."""
    chain = []
    while node is not None and node.known is None:
        chain.append(node)
        node = node.parent
    bits, article = node.known if node is not None else (0, False)
    for x in reversed(chain):
        if x.tag in _IN:
            bits |= 1 << _IN[x.tag]
        if x.tag not in ("html", "body"):  # their words speak of the whole page
            for w in x.words:
                bits |= _word(w)
        article = article or x.tag in ("article", "main") or "main" in x.words
        x.known = bits, article
    return bits, article


def features(found: list[Block]) -> list[list[int]]:
    """The places in NAMES of each block's features."""
    nodes = [_of_node(b.node) for b in found]
    articles, total = any(article for _, article in nodes), sum(len(b.text) for b in found)
    known: dict[tuple[int, str], list[int]] = {}
    out = []
    for k, (b, (bits, article)) in enumerate(zip(found, nodes, strict=True)):
        node = b.node
        while node is not None and node.tag not in _PARENT:
            node = node.parent
        parent = node.tag if node is not None else "other"
        if (bits, parent) not in known:
            known[bits, parent] = sorted([_AT["always"], _PARENT[parent], *(f for f in range(bits.bit_length()) if bits >> f & 1)])
        n = b.text.count(" ") + 1
        shape = [next((s for s, m in (("words<3", 3), ("words<6", 6), ("words<12", 12), ("words<30", 30), ("words<80", 80)) if n < m), "words>=80")]
        shape.append("no link" if not b.linked else "some link" if b.linked < 0.5 else "mostly link" if b.linked < 0.95 else "all link")
        shape += ["ends"] * (b.text[-1] in ".!?…:;\"'”»") + ["comma"] * ("," in b.text) + ["copyright"] * ("©" in b.text)
        shape += ["first"] * (k == 0) + ["last"] * (k == len(found) - 1)
        shape.append("in article" if article else "outside article" if articles else "no article")
        shape += ["in form"] * (b.node is not None and b.node.form is not None and 2 * b.node.form.chars < total)
        out.append(known[bits, parent] + [_AT[s] for s in shape])
    return out


class Chain(NamedTuple):
    weights: np.ndarray  # of the features, for the label "main text" against the other
    moves: np.ndarray  # of neighbouring labels, from and to


def decode(chain: Chain, rows: list[list[int]]) -> list[bool]:
    """The likeliest labels by Viterbi."""
    (oo, om), (mo, mm) = chain.moves.tolist()
    weights = chain.weights.tolist()
    other, main, back = 0.0, 0.0, []
    for k, row in enumerate(rows):
        own = sum(weights[f] for f in row)
        if not k:
            main = own
            continue
        from_main = mo + main > oo + other, mm + main > om + other
        other, main = max(mo + main, oo + other), max(mm + main, om + other) + own
        back.append(from_main)
    label = main > other
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1][: len(rows)]


def fit(pages: list[tuple[list[list[int]], list[bool]]], steps: int = STEPS, penalty: float = PENALTY) -> Chain:
    """Maximum likelihood with a square penalty: forward-backward over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    most = max(len(rows) for rows, _ in pages)
    x = np.zeros((len(pages), most, len(NAMES)), np.float32)
    y, there = np.zeros((len(pages), most), np.int64), np.zeros((len(pages), most), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, row in enumerate(rows):
            x[i, j, row] = 1
        y[i, : len(rows)], there[i, : len(rows)] = labels, True
    n, at = there.sum(), np.arange(len(pages))
    pairs = there[:, 1:]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    seen = np.einsum("ijk,ij->k", x, y * there)
    theta, mean, square = np.zeros(len(NAMES) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        weights, moves = theta[:-4], theta[-4:].reshape(2, 2)
        own = np.zeros((len(pages), most, 2))
        own[:, :, 1] = x @ weights.astype(np.float32)
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = own[:, 0]
        for j in range(1, most):
            now = np.logaddexp(ahead[:, j - 1, :1] + moves[0], ahead[:, j - 1, 1:] + moves[1]) + own[:, j]
            ahead[:, j] = np.where(there[:, j, None], now, ahead[:, j - 1])
        for j in range(most - 2, -1, -1):
            after = own[:, j + 1] + behind[:, j + 1]
            now = np.logaddexp(after[:, None, 0] + moves[:, 0], after[:, None, 1] + moves[:, 1])
            behind[:, j] = np.where(there[:, j + 1, None], now, 0)
        total = np.logaddexp(ahead[at, -1, 0], ahead[at, -1, 1])
        share = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * there
        joint = np.exp(ahead[:, :-1, :, None] + moves + (own + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        slope = np.concatenate([np.einsum("ijk,ij->k", x, share) - seen, (joint.sum(axis=(0, 1)) - seen_moves).ravel()]) / n + penalty * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta - 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


class Designer:
    """Lays out pages; ``mark`` opens every block of main text, so that its label can be read off."""

    mark = ""

    #: How a page writes its paragraphs.
    leaf = "p"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join("".join(r.choice(("ka", "lo", "mi", "ten", "ur", "sha", "er", "on", "é", "st")) for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high)))
        return text.capitalize() + r.choice((".", ".", ".", "", "!", "?", " &amp;&amp;"))

    def links(self, n: int) -> str:
        tag = self.r.choice(("ul", "ol", "div", "p"))
        item = "li" if tag in ("ul", "ol") else "span"
        return f"<{tag}>" + "".join(f'<{item}><a href="/{k}">{self.words(1, 4)}</a></{item}>' for k in range(n)) + f"</{tag}>"

    def named(self, tag: str, words: tuple[str, ...], inner: str) -> str:
        r = self.r
        name = r.choice(words)
        how = r.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}-wrap"', f" class='{name}'", f' class="{name}Box"', f' id="{name}bar"'))
        return f"<{tag}{how}>{inner}</{tag}>"

    def aside(self) -> str:
        """A part of the page that is not main text."""
        r = self.r
        kind = r.randrange(9)
        leaf = r.choice(("p", "p", "div", "li"))
        text = lambda: f"<{leaf}>{self.words(3, 40)}</{leaf}>"
        if kind == 0:
            inner = r.choice((self.links(r.randint(2, 9)),) * 3 + (f"<span>{self.words(1, 2)}</span> <span>{self.words(1, 3)}</span>",))
            return r.choice((f"<nav>{inner}</nav>", f'<div role="navigation">{inner}</div>', self.named("div", ("nav", "menu", "header", "search", "login"), inner)))
        if kind == 1:
            return self.named(r.choice(("div", "aside", "section")), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), r.choice((self.words(3, 30), text())))
        if kind == 2:
            return self.named(r.choice(("aside", "div")), ("sidebar", "widget", "related", "complementary"), f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(r.randint(2, 7)), text(), text() + self.links(3))))
        if kind == 3:
            return self.named("div", ("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe"), r.choice((text(), self.words(3, 30))) + r.choice(("", "<button>Ok</button>")))
        if kind == 4:
            return f"<form><label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + r.choice(("", text())) + "</form>"
        if kind == 5:
            return self.comments()
        if kind == 6:
            return self.named("div", ("share", "social", "tags", "breadcrumb", "pagination"), self.links(r.randint(1, 5)))
        if kind == 7:
            return f"<header><a href=/>{self.words(1, 3)}</a><p>{self.words(2, 9)}</p></header>"
        return f"<aside>{r.choice((text(), self.links(3)))}</aside>"

    def comments(self) -> str:
        """What readers wrote."""
        r = self.r
        leaf = r.choice(("p", "p", "div", "li"))
        said = ["".join(f"<{leaf}>{self.words(3, 40)}</{leaf}>" for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4))]
        if r.random() < 0.6:
            said = [self.named("div", ("comment", "reply"), f"<b>{self.words(1, 2)}</b>" + x) for x in said]
        return self.named(r.choice(("div", "section", "ul", "ol")), ("comments", "replies", "disqus", "comment-list", "user-comments"), r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + "".join(said))

    def paragraph(self, inner: str) -> str:
        """A paragraph of main text, as the page writes them."""
        if self.leaf == "p":
            return f"<p>{inner}</p>"
        return {"div": f"<div>{inner}</div>", "span": f"<div><span>{inner}</span></div>", "br": f"{inner}<br><br>"}[self.leaf]

    def part(self) -> str:
        """A part of the main text."""
        r, m = self.r, self.mark
        kind = r.randrange(14)
        if kind < 7:
            inner = self.words(*r.choice(((1, 3), (4, 14), (15, 60), (60, 140))))
            if r.random() < 0.2:
                inner += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 9)}'
            if self.leaf != "p":
                return self.paragraph(m + inner)
            return f"<p>{r.choice(('', '', '<b>', '<i>'))}{m}{inner}" + r.choice(("</p>", "</p>", "", f"<br>{m}{self.words(2, 20)}</p>"))
        if kind == 7:
            return f"<h{r.randint(2, 4)}>{m}{self.words(1, 8)}</h{r.randint(2, 4)}>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{m}{self.words(2, 25)}" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 9:
            return f"<blockquote>{m}{self.words(5, 40)}</blockquote>"
        if kind == 10:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        if kind == 11:
            return f"<pre>{m}{self.words(3, 20)}</pre>"
        if kind == 12:
            return f"<figure><img src=a><figcaption>{m}{self.words(3, 12)}</figcaption></figure>"
        return f"<section><h3>{m}{self.words(1, 6)}</h3><p>{m}{self.words(10, 60)}</p></section>"

    def page(self) -> str:
        r = self.r
        self.leaf = r.choice(("p",) * 6 + ("div", "span", "br", "br"))
        kind = r.random()
        if kind < 0.08:  # nothing but text
            text = "".join(self.paragraph(self.mark + self.words(2, 60)) for _ in range(r.choice((1, 1, 2, 4))))
            return r.choice((text, text, f"<html><head><title>t</title></head><body>{text}</body></html>", f"<div>{text}</div>", f"<article>{text}</article>", f'<body><div class="{r.choice(MAIN_WORDS)}">{text}</div></body>'))
        if kind < 0.11:  # no main text
            return "<html><body>" + "".join(self.aside() for _ in range(r.randint(1, 3))) + f"<footer>{self.words(1, 9)}</footer></body></html>"
        parts = [self.part() for _ in range(r.randint(1, 12))]
        title = f"<h1>{self.mark}{self.words(2, 10)}</h1>"
        title = r.choice((title, title, f"<header>{title}</header>", ""))
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randint(0, len(parts)), self.aside())
        inner = title + "".join(parts) + (self.comments() if r.random() < 0.3 else "")
        plain = r.random() < 0.35  # nothing says which part is the article
        if plain:
            inner = r.choice((f"<div>{inner}</div>", f"<div><div>{inner}</div></div>", inner, f"<section>{inner}</section>", f"<table><tr><td>{inner}</td></tr></table>", f'<div id="c{r.randint(1, 99)}">{inner}</div>'))
        else:
            inner = r.choice((f"<article>{inner}</article>",) * 5 + (f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", self.named("div", MAIN_WORDS, inner), f'<div id="page"><div class="{r.choice(MAIN_WORDS)}-body">{inner}</div></div>', f'<div role="main">{inner}</div>'))
        before, after = [self.aside() for _ in range(r.randint(0, 3))], [self.aside() for _ in range(r.randint(0, 3))]
        end = f"<p>{self.words(1, 9)}</p>" if r.random() < 0.4 else f"&copy; example.com &middot; {self.words(2, 12)}"
        foot = r.choice((f"<footer>{end}</footer>", f'<div class="{r.choice(("footer", "footer", "copyright", "contentinfo"))}">{end}</div>', f"<footer>{self.links(3)}{end}</footer>", ""))
        body = "".join(before) + inner + "".join(after) + foot
        if r.random() < 0.1:
            body = f'<form method="post" action="/">{body}</form>'
        elif r.random() < 0.1:
            body = f'<div class="{r.choice(("page", "wrapper", "container", "site"))}">{body}</div>'
        head, start, end = r.choice((("<head><title>t</title></head>", "<body>", "</body></html>"),) * 4 + (("<head><title>t</title>", "<body>", "</body></html>"), ("<title>t</title>", "", ""), ("<head><meta charset=utf-8><title>t</title>", "", ""), ("<head><title>t</title></head>", f'<body class="{r.choice(("single-post", "has-sidebar", "no-comments"))}">', "</body></html>")))
        return f"<!DOCTYPE html><html>{head}{start}{body}{end}"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[list[list[int]], list[bool]]]:
    """(features, labels) of generated pages."""
    out, designer = [], Designer(seed)
    for _ in range(n):
        found = blocks(designer.page())
        labels = [designer.mark in b.text for b in found]
        found = [b._replace(text=b.text.replace(designer.mark, "") or " ") for b in found]
        out.append((features(found), labels))
    return out


@lru_cache(1)
def trained() -> Chain:
    return fit(labelled_pages())


def main_text(page: str | None, chain: Chain) -> str:
    """The blocks of main text in page order, joined by line feeds."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, decode(chain, features(found)), strict=True) if keep) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    A null or empty page, or one without main text, has an empty text and no characters.  Null and
    repeated ids are kept; other columns are ignored.  Pages are read whole.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, shared.value) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
