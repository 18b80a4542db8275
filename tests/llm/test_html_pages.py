"""Main text of pages written by hand, which the generator of training pages did not lay out."""

import time

import pytest

from postloom.llm import html_blocks, html_extraction

PARAGRAPHS = (
    "A heavy storm reached the coast on Monday night, and hundreds of homes lost power.",
    "Officials said that repairs would take several days, because roads remain closed.",
    "Schools in three towns stay shut until Thursday, the council announced on its site.",
    "Volunteers are asked to come to the town hall at nine.",
)
PLAIN = "<h1>Storm hits coast</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(("Storm hits coast", *PARAGRAPHS))
ARTICLE = f"<article>{PLAIN}</article>"

MALFORMED = {
    "no head end, no body": f"<html><head><title>x</title>{ARTICLE}</html>",
    "no head, no body, no html": f"<title>x</title><meta charset=utf-8>{ARTICLE}",
    "text ends the head": f"<head><title>x</title>{PLAIN.replace('<h1>Storm hits coast</h1>', 'Storm hits coast')}",
    "self-closed svg": f"<body><svg class='i'/>{ARTICLE}</body>",
    "svg of self-closed parts": f"<body><svg><path d='M0 0'/><g/><text>no</text></svg>{ARTICLE}</body>",
    "apostrophe in a bare value": f"<body><div data-x=it's>{ARTICLE}</div></body>",
    "quotation mark after a value": f'<body><div title="a"b">{ARTICLE}</div></body>',
    "angle bracket in a value": f'<body><div title="a > b" data-y=\'<p>\'>{ARTICLE}</div></body>',
    "quotation without an end": f'<body><div title="a>{ARTICLE.replace(chr(34), "")}</body>',
    "form around the body": f"<body><form method=post action=/><input type=hidden name=s>{ARTICLE}</form></body>",
    "form around plain divs": f"<body><form method=post><div>{PLAIN}</div></form></body>",
    "plain div": f"<body><div>{PLAIN}</div></body>",
    "deeply nested": "<body>" + "<div>" * 3000 + ARTICLE,
    "deeply nested and plain": "<body>" + "<div>" * 3000 + PLAIN,
    "comment without an end": f"<body><!-- x {ARTICLE}</body>",
    "odd comments": f"<body><!--><!---><!-- a --!>{ARTICLE}<!-- b --></body>",
    "words on the body": f'<body class="single has-sidebar no-comments">{ARTICLE}</body>',
}


MENU, FOOT = '<nav><a href="/">Home</a> <a href="/b">About</a></nav>', "<footer>© 2024 Example</footer>"
BODIES = {
    "p": "".join(f"<p>{p}</p>" for p in PARAGRAPHS),
    "div": "".join(f"<div>{p}</div>" for p in PARAGRAPHS),
    "span in div": "".join(f"<div><span>{p}</span></div>" for p in PARAGRAPHS),
    "br": "<br><br>".join(PARAGRAPHS),
}
AROUND = ("{}", "<div>{}</div>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div class="post">{}</div>', '<div class="postBody">{}</div>')
REMARKS = (
    '<section class="comments"><p>I liked this a lot, thanks for the post.</p><p>Me too, great.</p></section>',
    '<div id="commentList"><div>Anna wrote: I liked this a lot.</div><div>Me too, great.</div></div>',
    '<ul class="reader-comments"><li>I liked this a lot, thanks.</li><li>Me too, great.</li></ul>',
)
NOTICES = (
    '<div class="cookiebar">We use cookies, to make this site better for you.</div>',
    '<div class="cookieBar"><p>We use cookies, to make this site better for you. <button>OK</button></p></div>',
)


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("around", AROUND)
def test_articles_however_paragraphs_are_written(body, around):
    for before, after in (("", ""), (MENU, FOOT)):
        page = f"<html><head><title>t</title></head><body>{before}{around.format(BODIES[body])}{after}</body></html>"
        assert html_extraction.main_text(page, html_extraction.trained()) == "\n".join(PARAGRAPHS)


@pytest.mark.parametrize("page", ["A text without any markup at all", "<p>Hello world.</p>", f"<p>{PARAGRAPHS[0]}</p>", " ".join(PARAGRAPHS)])
def test_a_page_of_text_alone(page):
    assert html_extraction.main_text(page, html_extraction.trained()) == page.removeprefix("<p>").removesuffix("</p>")


@pytest.mark.parametrize("remarks", REMARKS)
def test_comments_inside_the_article_go(remarks):
    page = f"<body>{MENU}<article>{PLAIN}{remarks}</article>{FOOT}</body>"
    assert html_extraction.main_text(page, html_extraction.trained()) == TEXT


@pytest.mark.parametrize("notice", NOTICES)
def test_notices_with_compound_names_go(notice):
    for page in (f"<body>{notice}{MENU}{ARTICLE}{FOOT}</body>", f"<body>{MENU}<article>{notice}{PLAIN}</article>{FOOT}</body>", f'<body>{notice}{MENU}<div class="content">{PLAIN}</div>{FOOT}</body>'):
        assert html_extraction.main_text(page, html_extraction.trained()) == TEXT


def test_a_page_without_main_text():
    assert html_extraction.main_text(f"<html><body>{MENU}{FOOT}</body></html>", html_extraction.trained()) == ""


@pytest.mark.parametrize("name", MALFORMED)
def test_the_whole_article_is_found(name):
    assert html_extraction.main_text(MALFORMED[name], html_extraction.trained()) == TEXT


# Parts of pages: (markup, its blocks, whether they are main text).
NAV = ('<ul id="mainnav"><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>', 3, False)
BLOG = [
    ('<div id="page" class="hfeed site"><header id="masthead"><p class="site-title"><a href="/">My Garden</a></p><p>Notes from a small garden</p></header>', 2, False),
    ('<nav class="main-navigation"><ul><li><a href="/">Home</a><li><a href="/about">About</a><li><a href="/contact">Contact</a></ul></nav>', 3, False),
    ('<div id="content"><main><article class="post-12 post hentry"><h1 class="entry-title">Tomatoes in June</h1><div class="entry-content">', 1, True),
    ("<p>The tomatoes were planted in the second week of May, after the last frost.</p><p>Since then they have grown by about two centimetres a day, and the first flowers are open.</p>", 2, True),
    ("<h2>Watering</h2><p>I water every second evening; too much water splits the fruit.</p><ul><li>Water the soil, not the leaves.</li><li>Use rain water where you can.</li></ul>", 4, True),
    ("<blockquote><p>A garden is never finished.</p></blockquote></div></article></main>", 1, True),
    ('<div id="comments" class="comments-area"><h2>Two thoughts</h2><ol><li class="comment"><p>Great post, thank you for sharing this with us.</p></li><li class="comment"><p>Mine died last week, sadly.</p></li></ol></div></div>', 3, False),
    ('<aside class="widget-area sidebar"><h2>Recent posts</h2><ul><li><a href="/1">Beans</a></li><li><a href="/2">Peas</a></li></ul></aside><footer class="site-footer">© 2024 My Garden</footer></div>', 4, False),
]
NEWS = [
    ('<header class="site-header"><a href="/">Daily Planet</a> <a href="/login">Log in</a></header>', 1, False),
    ('<div class="cookie-banner"><p>We use cookies to improve this site. By going on you agree.</p><button>Accept</button></div>', 2, False),
    ('<main><h1>Bridge to reopen in autumn</h1><p>The old bridge over the river will reopen in October, the city said on Friday.</p>', 2, True),
    ('<div class="ad-slot advertisement">Buy new tyres today and save.</div>', 1, False),
    ("<p>Work began two years ago, after inspectors found cracks in a pillar, and has cost more than four million.</p><figure><img src=b.jpg><figcaption>The bridge in March.</figcaption></figure><p>Traffic will be limited to one lane at first.</p></main>", 3, True),
    ('<section class="related"><h3>More stories</h3><ul><li><a href="/a">Tram line delayed again</a></li><li><a href="/b">New park opens</a></li></ul></section>', 3, False),
    ('<form class="newsletter"><label>Your address</label><input name=e><button>Send</button></form><footer><p>Contact us | Terms | Privacy</p><p>© Daily Planet</p></footer>', 4, False),
]
PLAIN_SITE = [
    NAV,
    ("<div><h1>On keeping bees</h1><p>Bees need water, shelter and flowers from spring to autumn, and little else.</p><p>A hive should face south-east, so that the morning sun warms its entrance early.</p>", 3, True),
    ("<p>In winter the colony forms a cluster. It lives on its stores, and should be left alone.</p><table><tr><td>Spring</td><td>Swarms</td></tr></table></div>", 3, True),
    ('<div class="footer">Copyright © Old Beekeeper</div>', 1, False),
]
TABLES = [
    ('<table><tr><td class="menu"><a href="/1">Start</a><br><a href="/2">Archive</a><br><a href="/3">Links</a></td>', 3, False),
    ('<td class="content"><h2>How the mill worked</h2><p>Water was led through a wooden channel, and fell on the wheel from above.</p><p>The stones turned about one hundred times a minute, which is faster than most visitors expect.</p><pre>wheel -&gt; shaft -&gt; stones</pre></td></tr></table>', 4, True),
]
DOCUMENTATION = [
    ('<div role="navigation" class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>', 2, False),
    ('<div role="main"><section><h1>Install</h1><p>Download the archive, unpack it, and run the script.</p><pre><code>sh install.sh</code></pre></section><section><h1>Use</h1><p>Call the tool with a file; it prints a report.</p><dl><dt>-v</dt><dd>Say more, on every step of the work.</dd></dl></section></div>', 7, True),
    ('<div role="contentinfo"><p>© the authors. Built with care.</p></div>', 1, False),
]
FORM_SITE = [
    ('<form id="aspnetForm" method="post"><div class="header"><a href="/">Town of Elm</a></div>', 1, False),
    ('<div class="content-body"><h2>Waste collection</h2><p>Bins are emptied on Tuesdays, in even weeks, from six in the morning.</p><p>Please put them out on the evening before, with the handle to the street.</p></div>', 3, True),
    ('<div class="search"><label>Find</label><input name="q"></div><div class="footer">Town of Elm, Market Square 1</div></form>', 2, False),
]
PAGES = {"blog": BLOG, "news": NEWS, "plain": PLAIN_SITE, "tables": TABLES, "documentation": DOCUMENTATION, "form": FORM_SITE}


def test_blocks_of_pages_written_by_hand():
    right = total = 0
    for parts in PAGES.values():
        found = html_blocks.blocks("<!doctype html><title>t</title>" + "".join(x for x, _, _ in parts))
        want = [label for _, n, label in parts for _ in range(n)]
        assert len(found) == len(want)
        got = html_extraction.decode(html_extraction.trained(), html_extraction.features(found))
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
    assert right >= 0.98 * total, (right, total)


@pytest.mark.parametrize("page", ["<a " * 100_000, "<div>" * 100_000 + "</span>" * 100_000, "<p><b>" * 30_000, "<!--" * 100_000, "<a title='" * 50_000, "<script>" * 100_000, "<" * 300_000, "</" * 200_000, "<div>" * 20_000 + "x<p>" * 20_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    html_extraction.main_text(page, html_extraction.trained())
    assert time.perf_counter() - began < 15
