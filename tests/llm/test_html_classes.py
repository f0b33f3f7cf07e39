"""A drop word that is only part of a class doesn't drop what holds the page's content."""

import pytest

from marginalia.llm import html_text

from .test_html_text import P1, P2, T2


@pytest.mark.parametrize("tag", ["article class='post category-social'", "article class='post tag-advertising'", "main class='content sidebar-right'", "article class='post comments-open'", "div class='layout-with-sidebar'", "div class='ad-free'", "div class='page-header-fixed'"])
def test_compound_class_keeps_content(tag):
    page = f"<nav>n</nav><{tag}><h2>T</h2><p>{P1}</p><p>{P2}</p><div class='share-box'>Share</div></{tag.split()[0]}><footer>f</footer>"
    assert html_text.main_text(page) == f"T\n{P1}\n{T2}"


@pytest.mark.parametrize("comments", ["<article class='comment'><p>{}</p></article>", "<div id=comments><article class='comment-body'><p>{}</p></article></div>", "<div class='comment-list'><p>{}</p></div>", "<aside class='widget-area'><p>{}</p></aside>"])
def test_what_is_no_content_still_goes(comments):
    assert html_text.main_text(f"<article class='post category-social'><p>{P1}</p></article>{comments.format(P2 * 5)}") == P1
    assert html_text.main_text(f"<article><p>{P1}</p>{comments.format(P2 * 5)}</article>") == P1
    assert html_text.main_text(f"<div><p>{P1}</p></div>{comments.format(P2 * 5)}") == P1 or "<article" in comments


def test_compound_classes_one_in_another():
    assert html_text.main_text(f"<div class='layout-with-sidebar'><article class='post category-social'><p>{P1}</p><p>{P2}</p></article><div class='widget-area'>w</div></div>") == f"{P1}\n{T2}"
