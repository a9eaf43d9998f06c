"""Names of classes are evidence: no article is lost by one, and what surrounds an article goes."""

import pytest

from quirefold.llm import html_extract

ARTICLE = "".join(f"<p>The {n} paragraph of the article tells at some length of what was found there.</p>" for n in ("first", "second", "third", "fourth", "fifth"))
TEXT = " ".join(f"The {n} paragraph of the article tells at some length of what was found there." for n in ("first", "second", "third", "fourth", "fifth"))


@pytest.mark.parametrize(
    "tag",
    ['div class="widget-reviews"', 'div class="share-price-story"', 'div class="main-menu-page"', 'div id="recommendedReading"', 'article class="post related-news"', 'div class="social-history"', 'div class="comments"', 'section class="sidebar"', 'div role="complementary"'],
)
def test_a_name_alone_loses_no_article(tag):
    end = f"</{tag.split()[0]}>"
    assert html_extract.extract(f"<body><{tag}>{ARTICLE}{end}</body>") == TEXT
    assert html_extract.extract(f"<body><{tag}>{ARTICLE}{end}<div class='x'>short</div></body>") == TEXT
    assert html_extract.vote(f"<body><div class='x'>short</div><{tag}>{ARTICLE}{end}</body>").startswith("/body/")


@pytest.mark.parametrize("name", ["ad", "ads", "sidebar", "comments", "comment-list", "post-comments", "cookie-banner", "newsletter-signup", "related-posts", "site-footer", "left-sidebar", "social-share", "siteHeader", "adUnit", "related-news", "widget-reviews"])
@pytest.mark.parametrize("where", ["beside", "inside"])
def test_what_surrounds_an_article_goes(name, where):
    other = f"<div class='{name}'><p>Some other words of this page.</p></div>"
    page = f"<body><div class='content'>{other}{ARTICLE}</div></body>" if where == "inside" else f"<body>{other}<div class='content'>{ARTICLE}</div>{other}</body>"
    assert html_extract.extract(page) == TEXT


def test_long_comments_go_beside_a_short_article():
    page = f"<body><article><p>Short news.</p></article><section class='comments'>{ARTICLE}</section></body>"
    assert html_extract.extract(page) == "Short news."
    page = f"<body><div class=story>{ARTICLE}</div><div class='post-comments'>{ARTICLE * 3}</div></body>"
    assert html_extract.extract(page) == TEXT


LINKED = "<ul><li><a href=/a>One source of it</a></li><li><a href=/b>Another source</a></li><li><a href=/c>A third source</a></li></ul>"


def test_linked_lists():
    assert html_extract.extract(f"<body><nav>x</nav><article>{ARTICLE}{LINKED}</article></body>") == TEXT + " One source of it Another source A third source"
    assert html_extract.extract(f"<body><article>{LINKED}{ARTICLE}</article></body>") == TEXT
    assert html_extract.extract(f"<body>{LINKED}<div>{ARTICLE}</div>{LINKED}</body>") == TEXT


def test_heading_before_the_container():
    assert html_extract.extract(f"<body><h1>The heading</h1><div class='content'>{ARTICLE}</div></body>") == "The heading " + TEXT
    assert html_extract.extract(f"<body><h1>Site</h1><div class='content'><h1>The heading</h1>{ARTICLE}</div></body>") == "The heading " + TEXT
    assert html_extract.extract(f"<body><header><h1>Site</h1></header><div class='content'>{ARTICLE}</div></body>") == TEXT
    assert html_extract.extract(f"<body><h1>The heading</h1><div class='content'>{ARTICLE}</div></body>", ["/body/div.content"]) == "The heading " + TEXT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body>{LINKED}</body>", "One source of it Another source A third source"),
        ("<body><div class='comments'>only this</div></body>", "only this"),
        ("<body><header>only a header</header></body>", "only a header"),
        ("<body><a href=x>one link</a></body>", "one link"),
        ("<body><nav>menu</nav><div hidden>unseen</div><footer>foot</footer></body>", ""),
    ],
)
def test_no_page_with_visible_text_is_empty(page, want):
    assert html_extract.extract(page) == want
