"""Names of elements must not empty a page or split a sentence."""

import pytest

from pressline.llm import html_template


def texts(page):
    return [b.text for b in html_template.parse(page)[0]]


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article><p>One two three.</p></article></body>",
        "<body class='nav-open'><article><p>One two three.</p></article></body>",
        "<body><article><section class='comments-off'><p>One two three.</p></section></article></body>",
        "<body><article><div class='share-price'><p>One two three.</p></div></article></body>",
        "<body><article><p>One <span class='share'>two</span> three.</p></article></body>",
        "<body id=sidebar><div class='sidebar'><main><p>One two three.</p></main></div></body>",
        "<body><div class='banner'><div><p>One two three.</p></div></div></body>",
        "<body><div class='comments'><article class='comments'><p>One two three.</p></article></div></body>",
        "<body><article><p>One two three.</p><div class='share-buttons'>Tell</div><div id=Comments><article><p>I disagree</p></article></div></article></body>",
        "<body><div class='cookieNotice'>We</div><div class='ad ad-3'>Buy</div><div class='ad-3'>Buy</div><article><p>One two three.</p></article><section class='comment-list'><p>No</p></section></body>",
        "<body><header>Top</header><article><header>One two three.</header></article><footer>End</footer><aside>Side</aside></body>",
    ],
)
def test_only_the_article_is_left(page):
    assert texts(page) == ["One two three."]


def test_names():
    assert all(map(html_template.named, ["ad", "x nav-main", "post-comments", "site_nav", "cookie-notice", "share-links", "relatedPosts", "ad-12", "top newsletter"]))
    assert not any(map(html_template.named, ["", "has-sidebar", "no-comments", "nav-open", "comments-off", "share-price", "shared", "header-text", "admin", "navy", "sidebars-story"]))
