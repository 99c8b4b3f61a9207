"""Elements aren't cut by a class or id alone if they hold the page's text."""

import pytest

from graphloom.llm.html_extract import main_text

TEXT = "Words of the article that the page is about. " * 8
REST = "<div class=sidebar><p>side</p></div><div class='cookie-notice'>notice</div><div id=comments><article class=comment>nice one</article></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content-sidebar-wrap'><main><p>{TEXT}</p></main></div>",
        f"<div class='layout has-sidebar'><article><p>{TEXT}</p></article></div>",
        f"<div class='post share-enabled'><p>{TEXT}</p></div>",
        f"<div id='discussion-paper'><p>{TEXT}</p></div>",
        f"<div class='related-layout'><div class='widget-area'><main><p>{TEXT}</p></main></div></div>",
    ],
)
def test_wrappers_stay(page):
    assert main_text(page) == TEXT.strip()
    assert main_text(f"<body>{page}{REST}</body>") == TEXT.strip()


def test_named_boilerplate_still_goes():
    assert main_text(f"<body><article><p>{TEXT}</p><div class='post-comments'>c</div><div class=ad>a</div></article></body>") == TEXT.strip()
