"""HTML extraction: what neighbours decide, and the same rows however the pages are dealt."""

import random
import time
from html.parser import HTMLParser

from lintlake.llm import html_extract

TOP, END = "Welcome to our pages, dear reader", "All rights are with the owners"


def page(k, article=True, body=None):
    rng = random.Random(k)
    body = body or [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(12)) for _ in range(4)]
    tag = "main" if article else "div"
    return f"<body><div>{TOP}</div><{tag}><p>Share this story now</p>" + "".join(f"<p>{x}</p>" for x in body) + f"<p>Printed by the paper</p></{tag}><div>{END}</div><nav>n{k}</nav></body>", "\n".join(body)


def test_neighbours_decide_what_markup_does_not():
    for article in (True, False):
        (a, own), (b, _), (c, _) = (page(k, article) for k in range(3))
        a, b, c = map(html_extract.lines_of, (a, b, c))
        assert html_extract.main_text(a, b, c)[0] == own
        alone, n = html_extract.main_text(a)
        assert n == 0 and alone != own and ("Share this story now" in alone) and (TOP in alone) == (not article)


def test_copies_teach_nothing():
    body = [" ".join(f"w{k}" for k in range(j, j + 15)) for j in (0, 100, 200)]
    a, own = page(1, body=body)
    edited, _ = page(2, body=[x.replace(x.split()[3], "edited") for x in body[:2]] + body[2:])
    a, edited = map(html_extract.lines_of, (a, edited))
    whole = "Share this story now\n" + own + "\nPrinted by the paper"
    for partners in ([a, a], [edited, edited], [a, edited]):
        assert html_extract.main_text(a, *partners)[0] == whole


def test_a_short_line_inside_the_article_stays_though_neighbours_have_it():
    pages = [html_extract.lines_of(page(k, body=[f"one{k} a{k} b{k} c{k}", "Yes.", f"two{k} e{k} f{k} g{k}"])[0]) for k in range(3)]
    assert html_extract.main_text(*pages)[0] == "one0 a0 b0 c0\nYes.\ntwo0 e0 f0 g0"


def brute(rows):
    """Every page with the pages before and after it in the order of host, path, id."""
    def key(r):
        rest = r[1].split("://", 1)[1] if r[1] and "://" in r[1] else ""
        rest = rest.split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        return host.lower(), "/" + path if "/" in rest else "", r[0]

    rows = sorted(rows, key=key)
    out = {}
    for i, r in enumerate(rows):
        near = [rows[j] for j in (i + 1, i - 1) if 0 <= j < len(rows) and key(r)[0] and key(rows[j])[0] == key(r)[0]]

        def ahead(x, r=r):
            n = 0
            for a, b in zip(key(x)[1], key(r)[1]):
                if a != b:
                    break
                n += 1
            return n

        near.sort(key=lambda x: -ahead(x))
        out[r[0]] = html_extract.main_text(html_extract.lines_of(r[2]), *[html_extract.lines_of(x[2]) for x in near])[0]
    return out


def test_the_same_rows_however_pages_are_dealt(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, f"http://{'big.org' if k % 3 else f'h{k % 7}.net'}/{rng.choice('abc')}/{rng.randint(0, 99)}?x={k}", page(k, article=k % 2 == 0)[0]) for k in range(240)]
    rows += [(300, None, None), (301, "http://big.org/", ""), (302, "none", page(302)[0]), (303, "http://alone.org", "<p>" + "long " * 100_000 + "</p>")]
    want = brute(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, __x int")
    for size, parts in ((10_000, 1), (9, 3), (25, 7)):
        monkeypatch.setattr(html_extract, "PAGES", size)
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df.repartition(parts)).collect()}
        assert got == {k: (t, len(t)) for k, t in want.items()}
    alone = {r[0]: html_extract.main_text(html_extract.lines_of(r[2]))[0] for r in rows}
    assert sum(alone[k] != want[k] for k in want) > 150  # withheld partners change the text
    twice = html_extract.extract(df.unionByName(df).repartition(5)).collect()
    assert len(twice) == 2 * len(rows) and all(twice.count(r) >= 2 for r in twice[:20])


def test_null_ids_and_large_ids(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(None, "http://a.b/1", "<p>x y</p>"), (None, "http://a.b/1", "<p>x y</p>"), (big, "http://a.b/2", "<p>z</p>")], "page_id long, url string, html string")
    assert sorted(str((r.page_id, r.text)) for r in html_extract.extract(df).collect()) == sorted(map(str, [(None, "x y"), (None, "x y"), (big, "z")]))


def texts(page):
    return html_extract.main_text(html_extract.lines_of(page))[0]


def test_inline_adverts_cues_headings_and_broken_tags():
    assert texts('<p>Hello <span class="ad"><span>Buy</span> now cheap</span> end</p>') == "Hello end"
    assert texts('<p>In <a class="search-term">linked words</a> here, <b id="comment">too</b></p>') == "In linked words here, too"
    assert texts('<article><div class="entry-header"><h1 class="header banner">Title</h1></div><p>Text</p><div class="share-nav">x</div></article>') == "Title\nText"
    assert texts('<div class="header">Site</div><p>Text</p>') == "Text"
    assert texts('<p class="x>One</p><p>Two</p>') == "One\nTwo"
    for name in ("object", "map", "svg", "noscript", "template", "canvas", "video", "script", "style", "iframe", "select"):
        assert texts(f"<article><div><p>One <{name}>lost</p></div><p>Two</p></article>") == "One\nTwo", name
        assert texts(f"<p>One <{name} a=1>x<i>y</i></{name}> two</p>") == "One two", name
    assert texts("<p>a <span class=ad>b</p><p>c</span> d</p>") == "a\nc d"


def test_stray_end_tags_cost_no_more_than_others():
    start = time.time()
    assert texts("<div>" * 50_000 + "</span></em></section>" * 50_000 + "end") == "end"
    assert texts("<script>" * 3000 + "x") == "" and texts('<span class="ad">' * 20_000 + "</span>" * 20_000 + "end") == "end"
    assert time.time() - start < 10


class Dom(HTMLParser):
    """A page as a tree, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.root = self.now = ("", {}, [], None)
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [], self.now)
        self.now[2].append(node)
        if tag not in ("br", "img", "hr"):
            self.now = node

    def handle_endtag(self, tag):
        self.now = self.now[3]

    def handle_data(self, data):
        self.now[2].append(data)


BLOCKS, WORDS_IN = ("div", "p", "section", "h2", "ul", "li", "article", "nav", "header", "aside", "footer", "form"), ("b", "a", "span", "em")


def read(node, kind, out):
    """Lines by walking the tree: blocks break lines, adverts in a paragraph say nothing."""
    tag, attrs, children, _ = node
    words = set((attrs.get("class") or "").split())
    if tag in WORDS_IN:
        if words & {"ad", "promo"}:
            return
    elif tag == "br":
        out[-1][0].append(" ")
        return
    elif tag:
        parts = {p for w in words for p in w.split("-")} & {"ad", "promo", "menu", "header", "comments"}
        inside = kind == 2
        if inside:
            parts -= {"header"}
        if tag in ("nav", "aside", "footer", "form") or (tag == "header" and not inside) or (parts and tag != "article" and not (inside and tag == "h2")):
            kind = 0
        elif tag == "article" and kind == 1:
            kind = 2
        out.append(([], kind))
    for c in children:
        if isinstance(c, str):
            out[-1][0].append(c)
        else:
            before = out[-1][1]
            read(c, kind, out)
            if c[0] in BLOCKS:
                out.append(([], before))


def test_lines_are_those_of_a_walk_over_the_tree():
    rng = random.Random(12)

    def made(depth, inline=False):
        parts = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.4 or depth == 0:
                parts.append(f"w{rng.randint(0, 99)} &amp; \n ")
            elif k < 0.5:
                parts.append("<br>")
            else:
                tag = rng.choice(WORDS_IN if inline or k < 0.7 else BLOCKS)
                name = rng.choice(["", ' class="ad"', ' class="main-menu big"', ' class="entry-header"', ' class="promo x"', " class='comments'"])
                parts.append(f"<{tag}{name}>{made(depth - 1, tag in WORDS_IN)}</{tag}>")
        return "".join(parts)

    for _ in range(1500):
        page = made(5)
        out = [([], 1)]
        read(Dom(page).root, 1, out)
        want = [(" ".join("".join(t).split()), k) for t, k in out]
        assert html_extract.lines_of(page) == [x for x in want if x[0]], page
