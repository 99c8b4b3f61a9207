"""Density decides: which of several articles, what a page without an article is about, what a class name may cut."""

import math
import random

import pytest

from graphloom.llm.html_extract import INLINE, NAMED, Node, _measure, _order, main_text, parse

TEXT = "Words of the story that the page is about and no other. "
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>another story {i}</a></li>" for i in range(9)) + "</ul>"
STORY = "".join(f"<p>{TEXT * 3}</p>" for _ in range(4))
PLAIN = " ".join([(TEXT * 3).strip()] * 4)


@pytest.mark.parametrize("wrap", ["<div class='content with-sidebar'>{}</div>", "<div class='post has-sidebar'>{}</div>", "<div class='main-content no-sidebar'>{}</div>", "<div class='entry social-share-enabled'>{}</div>", "<div class='layout has-sidebar'><article>{}</article></div>", "<div class='notice widget'>{}</div>", "<section id='related-wrap'><div>{}</div></section>"])
def test_names_don_t_cut_the_story(wrap):
    page = wrap.format(STORY)
    assert main_text(page) == PLAIN
    assert main_text(f"<body><div class=menu>{LINKS}</div>{page}<div class='sidebar'>{LINKS}</div><div class='notice'>We changed our terms.</div></body>") == PLAIN


def test_the_densest_of_several_articles():
    teaser = f"<article><h2>Teaser</h2><p>Read on</p>{LINKS}</article>"
    assert main_text(f"<body>{teaser}<article>{STORY}</article>{teaser}</body>") == PLAIN
    assert main_text(f"<body>{teaser}{teaser}<div>{STORY}</div></body>") == PLAIN


def test_without_an_article():
    page = f"<body><div><div>{LINKS}</div></div><div><div><h1>Title of it</h1>{STORY}</div></div><table><tr><td>{LINKS}</td></tr></table></body>"
    assert main_text(page) == "Title of it " + PLAIN


def test_loose_text_among_blocks():
    """Text outside any element of its own, as old pages have it, is text too."""
    loose = (TEXT * 4).strip()
    assert main_text(f"<body>{loose}<br><br>{loose}<div><p>first note</p><p>second note</p></div></body>") == f"{loose} {loose} first note second note"
    assert main_text(f"<body>{loose}<div>{STORY}</div>{loose}</body>") == f"{loose} {PLAIN} {loose}"


def test_comments_go_even_if_dense():
    many = "".join(f"<div class=reply><p>{TEXT * 4}</p></div>" for _ in range(4))
    assert main_text(f"<body><div><div>{STORY}</div></div><div id=comments>{many}</div></body>") == PLAIN
    assert main_text(f"<body><article>{STORY}<section class='post-comments'>{many}</section></article></body>") == PLAIN


# ---------------------------------------------------------------- a slow twin of the measure
def slow(node: Node, body: Node, upto: int) -> dict:
    """All counts of a node from its whole subtree, each time anew."""

    def under(x):
        for y in x.children:
            if isinstance(y, Node) and y.cut in (0, upto):
                yield y
                yield from under(y)

    def chars(x):
        return sum(len("".join(t.split())) for y in [x, *under(x)] for t in y.children if isinstance(t, str))

    def linked(x):
        return chars(x) if x.tag == "a" else sum(linked(y) for y in x.children if isinstance(y, Node) and y.cut in (0, upto))

    def ctd(x):
        c, lc, t, lt = chars(x), linked(x), len(list(under(x))), sum(y.tag == "a" for y in under(x))
        if not c:
            return 0.0
        base = max(1.5, math.log(c / max(1, c - lc) * max(1, lc) + linked(body) / max(1, chars(body)) * c + math.e)) if lc else max(1.5, math.log(0 * c + linked(body) / max(1, chars(body)) * c + math.e))
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    kids = [y for y in node.children if isinstance(y, Node) and y.cut in (0, upto)]
    loose = sum(len("".join(y.split())) for y in node.children if isinstance(y, str))
    own = loose * math.log(max(1, loose)) / math.log(max(1.5, math.log(linked(body) / max(1, chars(body)) * loose + math.e))) if any(y.tag not in INLINE for y in kids) else 0.0
    return {"chars": chars(node), "link_chars": linked(node), "tags": len(list(under(node))), "ctd": ctd(node), "sum": sum(ctd(y) for y in kids) + own}


def test_measure_equals_its_slow_twin():
    r = random.Random(4)

    def page(depth):
        tag = r.choice(["div", "p", "a", "span", "section", "ul", "nav"])
        body = "".join(r.choice([TEXT[: r.randint(0, 50)], page(depth - 1) if depth else "x"]) for _ in range(r.randint(0, 4)))
        return f"<{tag} class={r.choice(['x', 'sidebar', 'ad', 'post'])}>{body}</{tag}>"

    for _ in range(60):
        root = parse("".join(page(4) for _ in range(3)))
        for upto in (0, NAMED):
            nodes = _order(root, upto)
            for x in nodes:
                x.chars = x.tags = x.link_chars = x.link_tags = 0
                x.ctd = x.sum = 0.0
            _measure(nodes, upto)
            for x in nodes:
                want = slow(x, root, upto)
                assert {k: getattr(x, k) for k in want} == pytest.approx(want)
