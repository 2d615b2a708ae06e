"""What counts as an article's text: nested articles, names that only look like boilerplate, unclosed elements."""

from __future__ import annotations

import pytest

from sirenlens.llm.html import page_lines

STORY = "<p>Story</p>"


@pytest.mark.parametrize(
    ("source", "inside"),
    [
        (f'<main>{STORY}<div id="comments"><ol><li><article class="comment-body"><p>Nice post!</p></article></li></ol></div></main>', ["Story"]),
        (f'<main>{STORY}<div id="comments"><article class="comment-body"><p>Nice post!', ["Story"]),
        (f'<article>{STORY}</article><aside class="related"><article><h3>Teaser</h3></article></aside>', ["Story"]),
        (f'<article>{STORY}</article><aside class="related"><article><h3>Teaser', ["Story"]),
        (f'<article class="advert"><p>Buy</p></article><article>{STORY}</article>', ["Story"]),
        ('<article><h2 id="side-effects">Side effects</h2><p>One</p><p id="search-history">Two</p></article>', ["Side effects", "One", "Two"]),
        (f'<article><section class="post-header"><h1>Title</h1></section>{STORY}</article>', ["Title", "Story"]),
        (f'<article class="post with-sidebar comments-open">{STORY}<div class="share-buttons">Share</div></article>', ["Story"]),
        (f'<article id="notice">{STORY}</article>', ["Story"]),
        (f'<article>{STORY}<div role="complementary"><article>More</article></div><p>End</p></article>', ["Story", "End"]),
        (f"<nav><a>menu</a><article>{STORY}</article>", ["Story"]),  # a menu that is never closed
        (f"<nav><article>menu</article></nav><article>{STORY}</article>", ["Story"]),
        (f'<article>{STORY}<div class="comments">Hm</article><p>after</p>', ["Story"]),  # ends with its article
    ],
)
def test_the_article_is_what_counts(source, inside):
    assert page_lines(source)[0] == inside


@pytest.mark.parametrize(
    ("source", "outside"),
    [
        (f'<body><div class="left-sidebar">x</div><div class="site-header">y</div>{STORY}</body>', ["Story"]),
        (f'<body class="has-sidebar"><div class="no-comments">{STORY}</div></body>', ["Story"]),
        ('<div class="header">top</div><h1 class="header">Title</h1>', ["Title"]),
        (f'<div hidden>x</div>{STORY}<div aria-hidden="true">y</div>', ["Story"]),
        ("", []),
    ],
)
def test_lines_of_pages_without_an_article(source, outside):
    assert page_lines(source) == ([], outside)


def test_a_very_long_page():
    lines = [f"line {k} " + "w" * 50 for k in range(40_000)]
    source = "<article>" + "".join(f"<p>{line}</p>" for line in lines) + "<div class=ad><p>buy</p></div></article>"
    assert page_lines(source) == (lines, [])
    unclosed = "<article>" + "<nav>x</div>" * 20_000 + "</article>"
    assert page_lines(unclosed) == ([], [])
