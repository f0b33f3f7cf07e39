"""Pages of several layouts with known text; that the ratio decides; that large pages take linear time."""

import random
import time

import numpy as np
import pytest

from marginalia.llm import html_text

WORDS = "the river ran past old mills where farmers once brought their grain each autumn and traded news of distant towns before roads came".split()


def prose(rng, low, high):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def blocks(rng):
    """(html, text) of an article's blocks: paragraphs, some short, headings, a list and a table."""
    out = [("<h1>{}</h1>", prose(rng, 3, 8))]
    for _ in range(rng.randint(3, 9)):
        kind = rng.choice("pppphsl")
        if kind == "l":
            out += [("<ul><li>{}</li></ul>", prose(rng, 4, 12)) for _ in range(rng.randint(2, 6))]
        else:
            out.append({"p": ("<p>{}</p>", prose(rng, 25, 90)), "h": ("<h2>{}</h2>", prose(rng, 2, 5)), "s": ("<p>{}</p>", prose(rng, 3, 9))}[kind])
    out.append(("<p>{}</p>", prose(rng, 25, 60)))
    return "".join(h.format(t) for h, t in out), "\n".join(t for _, t in out)


MENU = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS[:9])
LINKS = "".join(f"<div><a href='/{w}'>{w} {w}</a></div>" for w in WORDS[:7])
LAYOUTS = {
    "article": lambda rng, body: f"<html><head><title>t</title><script>var x='<p>';</script></head><body><header><h2>Site</h2></header><nav><ul>{MENU}</ul></nav><article>{body}</article><aside><p>{prose(rng, 30, 60)}</p></aside><footer>&copy; {prose(rng, 5, 9)}</footer></body></html>",
    "main with comments": lambda rng, body: f"<body><nav>{MENU}</nav><main class='content sidebar-right'>{body}<section id='comments'><article class='comment'><p>{prose(rng, 30, 60)}</p></article><form><label>Name</label><input><button>Send</button></form></section></main><div class='cookie-notice'><p>{prose(rng, 10, 20)}</p></div></body>",
    "div soup": lambda rng, body: f"<body><div class='topbar'>{LINKS}</div><div class='wrap'><div class='col'>{body}</div><div class='sidebarLeft'><p>{prose(rng, 20, 40)}</p></div></div><div class='footer-legal'>{prose(rng, 6, 12)}</div></body>",
    "no classes": lambda rng, body: f"<body><table><tr><td>{LINKS}</td></tr></table><div>{body}</div><div>{LINKS}</div></body>",
    "wrapper with a telling class": lambda rng, body: f"<body><ul>{MENU}</ul><div class='layout-with-sidebar'><section>{body}</section><div class='widget'><p>{prose(rng, 20, 40)}</p></div></div><footer><p>{prose(rng, 5, 9)}</p></footer></body>",
    "unclosed": lambda rng, body: f"<body><nav>{MENU}</nav><div class=ad>{prose(rng, 5, 9)}</div><article>{body.replace('</p>', '').replace('</li>', '')}</article><footer>{prose(rng, 5, 9)}",
    "several articles": lambda rng, body: f"<body><nav>{MENU}</nav><article><header><h2>Of the river</h2><p>by A. Nother</p></header>{body}<footer>tags</footer></article><section class='related'><article class='teaser'><p>{prose(rng, 12, 20)}</p></article></section></body>",
}


def score(got, want):
    a, b = got.split("\n"), want.split("\n")
    both = len(set(a) & set(b))
    return 2 * both / (len(set(a)) + len(set(b)))


def texts(layout, n=40):
    rng = random.Random(layout)
    for _ in range(n):
        body, text = blocks(rng)
        yield LAYOUTS[layout](rng, body), ("Of the river\n" if layout == "several articles" else "") + text


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    scores = [score(html_text.main_text(page), text) for page, text in texts(layout)]
    assert sum(scores) / len(scores) >= 0.95


def test_ratios_decide(monkeypatch):
    pages = [p for layout in LAYOUTS for p, _ in texts(layout, 10)]
    before = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "threshold", lambda v: -np.inf)
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) >= 0.9 * len(pages)
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    monkeypatch.setattr(html_text, "ratios", lambda lines, parents: rng.random(len(lines)))
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) >= 0.9 * len(pages)


@pytest.mark.parametrize("part", ["<div>", "<h2>", "<b><p>", "<i><p>x</i>", "<div class='my-widget'>x", "<article>x", "<td>", "<li><a>", "</p></div></b>"])
def test_large_pages_take_linear_time(part):
    page = "<article><p>words of text " + part * (1_000_000 // len(part))
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10
