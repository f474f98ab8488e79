"""Main text: planted layouts, a brute-force cut, hostile pages."""

import itertools
import random
import time

import pytest

from siteweave.llm import main_text
from tests.llm.conftest import SF


def text(page):
    found, kept = main_text.main_blocks(page)
    return "\n".join(b.text for b, k in zip(found, kept) if k)


LONG = "This is a sentence of the article, long enough to look like one, and it goes on for a while. "


@pytest.mark.parametrize(("page", "want"), [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    (f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{LONG}<p>Yes.<br>No&#33;</article><footer>(c) x</footer>",
     f"A & B\n{LONG.strip()}\nYes. No!"),
    # headers: of the page out, of the article in
    (f"<header><h2>Site</h2></header><main><article><header><h1>Title</h1></header><p>{LONG}</p></article></main>", f"Title\n{LONG.strip()}"),
    # notices, adverts, forms, sidebars and comments inside or beside the article
    (f"<div class='cookie-notice'><p>{LONG}</p></div><article><p>{LONG}</p><div class=ad><p>Buy now. {LONG}</p></div><p>End.</p>"
     f"<form><p>{LONG}</p></form><section id='comments'><article><p>{LONG}</p></article></section></article><aside><p>{LONG}</p></aside>",
     f"{LONG.strip()}\nEnd."),
    # no article element: classes, or only what the text looks like
    (f"<div class='nav'><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class='post-content'><p>{LONG}</p><p>Short</p></div>",
     f"{LONG.strip()}\nShort"),
    (f"<div><a href=1>One</a> <a href=2>Two</a></div><div><p>{LONG * 3}</p><p>{LONG * 2}</p></div><div><a href=3>Three</a></div>",
     f"{(LONG * 3).strip()}\n{(LONG * 2).strip()}"),
    # scripts, styles, comments, broken markup
    (f"<article><p>a < b <!-- <p>no</p> --><script>var x='<p>no</p>';</script>and <b>c<p>{LONG}<style>p{{}}</style></article>", f"a < b and c\n{LONG.strip()}"),
    (f"<article><p>caf&eacute;&nbsp;&nbsp;x &#x1F642;</p><p>{LONG}", f"café x 🙂\n{LONG.strip()}"),
    # an advert that never ends does not swallow the article
    (f"<div class=ad>Buy<article><p>{LONG}</p></article>", LONG.strip()),
])
def test_layouts(page, want):
    assert text(page) == want


def cut_size(side, unary, pairs):
    return sum(u if not s else 0 for s, u in zip(side, unary) if u > 0) + sum(-u for s, u in zip(side, unary) if u < 0 and s) + sum(
        w for a, b, w in pairs if side[a] != side[b]
    )


def test_cut_is_the_smallest():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 8)
        unary = [rng.randint(-6, 6) for _ in range(n)]
        pairs = [(i - 1, i, rng.randint(0, 4)) for i in range(1, n)]
        pairs += [(a, b, rng.randint(1, 3)) for a, b in itertools.combinations(range(n), 2) if b > a + 1 and rng.random() < 0.2]
        got = main_text.minimum_cut(unary, pairs)
        sizes = {side: cut_size(side, unary, pairs) for side in itertools.product((False, True), repeat=n)}
        assert cut_size(got, unary, pairs) == min(sizes.values())


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '", "<!--", "<p>", "<div class='", "<p>x <", "</div>", "&amp", "<li><a>b</a>", "<p>a</p><nav>b</nav>"])
def test_hostile_pages_are_linear(part):
    start = time.time()
    main_text.main_blocks(part * (1_000_000 // len(part)))
    assert time.time() - start < 30


def test_training_moves_the_weights_and_keeps_the_prior_without_lessons():
    assert (main_text.train({}) == main_text.PRIOR).all()
    link, plain = main_text._AT["links2"], main_text._AT["ends"]
    counts = {((0, link), False): 500, ((0, plain), True): 500, ((0,), True): 100}
    w = main_text.train(counts)
    assert w[link] < main_text.PRIOR[link] and w[plain] > main_text.PRIOR[plain]


def test_pages_against_their_articles(spark):
    """Every page of the table: the article element, read with plain patterns."""
    import html
    import re

    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in main_text.extract(df).collect()}
    for r in df.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_hard_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x", 1)] * 2
    rows += [(None, None, None, None, None), (2, "v", "", "x", 1), (3, None, "<p>" + "x" * 2_000_000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = main_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:2] == [(0, 0), (1, len(LONG) - 1)]
    assert len(got) == 5 and main_text.extract(df.limit(0)).count() == 0
