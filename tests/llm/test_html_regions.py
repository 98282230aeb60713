"""Names that merely contain a word of a region leave an article alone; names of regions still mark them."""

import numpy as np
import pytest

from sonospan.llm.html_text import main_text, page_texts, parsed

BODY = "<p>The text of the article, which is of some length.</p>"
TEXT = "The text of the article, which is of some length."
NONE = np.zeros(0, dtype=np.uint64)


def text(html):
    return main_text(parsed(html), NONE, NONE)


@pytest.mark.parametrize("opening", [
    '<div class="content no-sidebar">', '<div class="has-sidebar">', '<div id="page" class="layout-with-menu">', '<div class="article-social-science">', '<div class="story promo-free">', '<article class="hentry category-discussion">',
    '<article class="post comments-closed">', '<main><div class="category-reply">', '<section class="related-work">', "<head><title>T</title>", '<head><meta charset="x"><div>', '<div class="sidebar">', '<div id="advertisement"><div class="widget">',
])
def test_articles_stay(opening):
    assert text(opening + BODY) == TEXT


@pytest.mark.parametrize("aside", [
    '<div class="sidebar">Links</div>', '<div class="site-footer-2">Imprint</div>', '<ul class="mainNav"><li>Home</ul>', '<div class="cookie-banner">Cookies</div>', '<section class="comments"><p>First!</section>', '<div id="comment-list"><p>First!</div>',
    '<nav class="x">Home</nav>', '<div role="search">Find</div>', '<form class="newsletter">Mail</form>', '<div style="display: none">Gone</div>', "<header>Top</header>",
])
def test_regions_go(aside):
    assert text(f"<body><div>{BODY}</div>{aside}") == TEXT
    assert text(f"<body><article>{BODY}{aside}</article>") == TEXT


def test_a_teaser_does_not_hide_the_page():
    assert text(f'<article class="teaser"><p>More news</p></article><div>{BODY}{BODY}</div><nav>Home</nav>') == f"More news {TEXT} {TEXT}"
    assert text(f"<article>{BODY}</article><div>Other pages</div>") == TEXT


def test_boilerplate_beside_articles_goes_by_the_template(spark):
    """Long shared text beside a short article is no reason to leave it."""
    shared = "".join(f"<div>Shared paragraph number {k} of every page of this host.</div>" for k in range(5))
    rows = [(k, f"http://a.example/{k}", f"<body>{shared}<article><p>Own words {chr(97 + k) * 5} of this page.</p></article>") for k in range(6)]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Own words {chr(97 + k) * 5} of this page." for k in range(6)}
