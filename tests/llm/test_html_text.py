import random
import re

import pytest

from marginalia.llm import html_text

P1, P2 = "A first paragraph that says a good deal about its subject, at some length.", "A second paragraph, which goes on about it &amp; on&nbsp;and\n\ton about the same."
T2 = "A second paragraph, which goes on about it & on and on about the same."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("only text &lt;here&gt;", "only text <here>"),
        ("<p>a<p>b", "a\nb"),
        (f"<article><h1>T</h1><p>{P1}<p>{P2}</article><footer>f</footer>", f"T\n{P1}\n{T2}"),
        (f"<body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><main><h1>T</h1><p>{P1}</p><aside>x</aside><p>x</p></main><div class='cookie-notice'>We use cookies</div></body>", f"T\n{P1}\nx"),
        (f"<article><header><h1>T</h1><p>by me</p></header><p>{P1}</p><div id=comments><article><p>{P2}</p></article></div></article>", f"T\n{P1}"),
        (f"<div class=content><p>{P1}</p><p>mid</p><p>{P2}</p></div><div class=sidebarLeft><p>{P1}</p></div><form>q <input></form>", f"{P1}\nmid\n{T2}"),
        (f"<script>var a='</p>';</script><style>p{{}}</style><p>{P1}</p><!-- c --><noscript>no</noscript>", P1),
        (f"<div class=ad>buy</div><article><p><b>{P1}<br><p>{P2}</article>", f"{P1}\n{T2}"),
        ("<nav>menu</nav>", ""),
        (f"<p>{P1}</p><p>cut off <a hre", f"{P1}\ncut off"),
    ],
)
def test_pages(html, text):
    assert html_text.main_text(html) == text


def test_pieces_make_no_difference(monkeypatch):
    page = f"<article><h1>T&eacute;</h1>{f'<p>{P1}</p><p>{P2}</p>' * 30}</article><footer>&copy; x</footer>"
    whole = html_text.main_text(page)
    monkeypatch.setattr(html_text, "PIECE", 7)
    assert html_text.main_text(page) == whole and whole.count("\n") == 60


def test_threshold_is_the_best_cut():
    import numpy as np

    rng = random.Random(1)
    values = np.array([rng.random() for _ in range(9)] + [100 + rng.random() for _ in range(7)])
    assert 1 < html_text.threshold(values) < 100
    assert html_text.threshold(np.ones(5)) == -np.inf


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) > 0
        assert article is None or "track(" not in got[r["page_id"]]["text"]
    odd = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(odd).collect()] == [("", 0)] * 3
    assert html_text.extract(odd.limit(0)).count() == 0


def test_headers_and_wrappers():
    page = f"<div class='page has-sidebar'><div class='article-header'><p>by me</p></div><p>{P1}</p><p>{P2}</p></div>"
    assert html_text.main_text(page) == f"{P1}\n{T2}"
    page = f"<nav>n</nav><article><div class='entry-header'><div><h1>T</h1></div><p>by me</p></div><p>{P1}</p><div class='share'><h2>Share</h2></div></article>"
    assert html_text.main_text(page) == f"T\n{P1}"
