"""op5: broken markup, class names, the tree's entropies against a plain computation."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from wattloom.llm import html
from wattloom.llm.html import extract_main_text, main_text, parse, root_path, tree_marks


def text_of(page):
    return main_text(parse(page))


def test_broken_markup_loses_no_text():
    assert text_of("<article><p title=it's>hello</p><p>more</p></article>") == "hello\nmore"
    assert text_of("<article><p title=it's>hello</p><p>It's more</p><p>last</p></article>") == "hello\nIt's more\nlast"
    assert text_of('<article><p title="abc>hello</p><p class="x">more</p></article>') == "hello\nmore"
    assert text_of('<p title="a > b < c" id=\'d>\'>one</p><p ">two</p><p <b>three</b></p>') == "one\ntwo\nthree"
    assert text_of("<p>a <!-- not closed <b>b</b></p><p>c &lt; d</p>") == "a b\nc < d"
    assert text_of("<noscript><p>kept</p><title>x<p>too") == "kept\nx\ntoo" and text_of("I </3 it, 1 < 2 <") == "I </3 it, 1 < 2 <"


@pytest.mark.parametrize("piece", ["<a ", "<a x=\"", "<a x='\"", "<!--", "<![CDATA[", "<title>", "</", "<p class=", "<div>", "&#", "<!x"])
def test_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    text_of(page)
    tree_marks(parse(page))
    assert time.perf_counter() - began < 12  # two parses and two walks of a megabyte; quadratic time would be hours


def test_class_names_count_as_a_whole():
    kept = "<article><div class=related-work>one</div><div class='social-history'>two</div><div class='menu-engineering'>three</div></article>"
    assert text_of(kept) == "one\ntwo\nthree"
    gone = "<article><p>body</p><div class='cookie-banner'>a</div><div class='x site-footer'>b</div><div id=comments>c</div><ul class=related-posts><li>d</ul></article>"
    assert text_of(gone) == "body"


def test_articles_are_taken_if_they_hold_the_text():
    body = "<p>" + "long body text " * 20 + "</p>"
    assert text_of(f"<div>{body}</div><article>teaser one</article><article>teaser two</article>").startswith("long body")
    assert text_of(f"<div>aside words</div><article>{body}</article>").startswith("long body") and "aside" not in text_of(f"<div>aside words</div><article>{body}</article>")


def brute(pages):
    """path -> (pages, importance), by plain counting."""
    votes = defaultdict(dict)
    for host, page in pages:
        mark, rows = tree_marks(parse(page), root_path(host))
        for path, parent, _, style, content in rows:
            old = votes[path, parent].get(mark, (style, content))
            votes[path, parent][mark] = (min(old[0], style), min(old[1], content))

    def entropy(values):
        n = len(values)
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)

    nodes = {p: (parent, list(v.values())) for (p, parent), v in votes.items() if len(v) >= html.MIN_PAGES}

    def score(p):
        _, own = nodes[p]
        kids = [k for k, (parent, _) in nodes.items() if parent == p]
        if not kids:
            return entropy([c for _, c in own]) if any(c for _, c in own) else entropy([s for s, _ in own])
        w, total = html.GAMMA ** len(kids), sum(len(nodes[k][1]) for k in kids)
        return (1 - w) * entropy([s for s, _ in own]) + w * sum(score(k) * len(nodes[k][1]) for k in kids) / total

    def top(p):
        return max([score(p), *(top(k) for k, (parent, _) in nodes.items() if parent == p)])

    return {p: (len(v), score(p), top(p)) for p, (_, v) in nodes.items()}


def site(rnd, k):
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    extra = "<section class=tips><p>Same tips on all pages</p></section>" if k % 3 else "<section class=tips><p>Other tips</p><p>x</p></section>"
    return f"<body><div class=top><p>Welcome</p><p>to us</p></div><div class=text><h2>{words(2)}</h2><p>{words(30)}</p></div><div><div><div><p>{words(3)}</p></div></div></div>{extra}<article><p>{words(9)}</p><div class=share><p>Send this on</p></div></article></body>"


def test_importance_against_plain_counting(spark):
    rnd = random.Random(2)
    pages = [("a", site(rnd, k)) for k in range(30)] + [("b", site(rnd, k)) for k in range(9)]
    pages += [pages[0]] * 20 + [("c", site(rnd, 1))] * 12  # copies have one vote
    rows = spark.createDataFrame(pages, "host string, html string")
    got = {r.path: (r.pages, r.score, r.top) for r in html.importance(html._marks(rows)).collect()}
    want = brute(pages)
    assert got.keys() == want.keys() and len(got) > 12
    assert all(got[p] == pytest.approx(want[p]) for p in want)
    assert any(s < html.LOW for *_, s in want.values()) and any(s > 0.9 for *_, s in want.values())


@pytest.mark.parametrize("small", [0, 200_000])
def test_the_tree_cuts_outside_and_inside_articles(spark, monkeypatch, small):
    monkeypatch.setattr(html, "SMALL_LOW", small)
    page = lambda k: f"<body><div class=top><p>Welcome</p></div><article><h1>Title</h1><p>Story {k * k} of {k}, told at length</p><section class=more>Read us daily</section></article></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)] + [(90, "http://a.example/x", page(3)), (90, "http://a.example/x", page(3)), (91, "http://b.example", page(5)), (92, None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, path int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_main_text(docs).collect())
    assert len(got) == 24 and all(t == f"Title\nStory {k * k} of {k}, told at length" and n == len(t) for k, t, n in got[:20])
    assert [t for k, t, _ in got if k == 90] == ["Title\nStory 9 of 3, told at length"] * 2
    assert got[-2][1] == "Title\nStory 25 of 5, told at length\nRead us daily" and got[-1][1] == ""
