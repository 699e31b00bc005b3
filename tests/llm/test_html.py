"""Tag-path ratios against plain loops, and pages without telling names."""

import math

import numpy as np
import pytest
from evidentia.llm import html_extract as hx

LONG = "This is a paragraph of the article, with enough words and signs, as one would expect of it. " * 3
PARA = " ".join(LONG.split())


def lines(html):
    return hx.main_text(html).split("\n\n")


@pytest.mark.parametrize(
    "inner, want",
    [
        (f'<p title="a hidden gem">{LONG}</p>', [PARA]),
        (f'<p>{LONG}</p><p><a href="/s?id=share">the full report</a> is out.</p>', [PARA, "the full report is out."]),
        (f'<section data-id="related"><p>{LONG}</p></section>', [PARA]),
        (f'<p data-x=\'class="nav"\' aria-label="hidden">{LONG}</p>', [PARA]),
    ],
)
def test_values_of_attributes_are_no_names(inner, want):
    assert lines(f"<body><article>{inner}</article></body>") == want


def test_a_name_around_the_whole_article_drops_nothing():
    for name in ("social-history", "comments", "sidebar"):
        assert lines(f'<body><div class="{name}"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>') == ["Head", PARA, PARA]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div class="k3">{}</div>'])
def test_names_that_tell_nothing(wrap):
    body = wrap.format(f"<h1>Head</h1><p>{LONG}</p><div class='q1'>Buy now</div><p>Short one.</p><ul><li>x one<li>y two</ul><p>{LONG}</p>")
    page = f'<body><div class="z9">Home <a href="/a">About</a> <a href="/b">Contact</a></div><div class="z8"><span>Buy now, pay later.</span></div>{body}<div class="z7"><p>Copyright 2024</p></div></body>'
    assert lines(page) == ["Head", PARA, "Short one.", "x one", "y two", PARA]


def test_lists_of_links_beside_the_article_go():
    links = "".join(f"<li><a href='/{i}'>Another story about it {i}</a>" for i in range(8))
    assert lines(f"<body><div class='m'><ul>{links}</ul></div><div class='c'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div class='r'><h3>More</h3><ul>{links}</ul></div></div></body>") == ["Head", PARA, PARA]


def test_form_around_a_page_and_menu_alone():
    assert lines(f"<body><form id='aspnet'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></form></body>") == [PARA] * 3
    assert hx.main_text("<body><nav><a>One</a><a>Two</a></nav></body>") == "" and hx.main_text("<body><footer>(c) 2020, all.</footer></body>") == ""


def test_scores_are_the_ratios_told_plainly():
    page = f"<body><div class='a'><p>One, two.</p><p>{LONG}</p></div><div class='b'>x <a>link text</a></div><footer>End, all.</footer><div class='a'><p>Three; four</p></div></body>"
    found = hx.blocks(page)
    path = []
    for e, _, _ in found:
        p, x = [], e
        while x is not None:
            p.append((x.tag, x.label))
            x = x.parent
        path.append(tuple(p))
    chars, punct = [], []
    for p in path:
        mine = [(t, link) for (_, t, link), q in zip(found, path) if q == p]
        chars.append(sum(len(t) * (1 - link) for t, link in mine) / len(mine))
        punct.append(sum(1 + sum(c in ".,;:!?" for c in t) for t, _ in mine) / len(mine))

    def smooth(x, i):
        k = {d: math.exp(-0.5 * d * d) for d in range(-3, 4)}
        return sum(k[d] * x[i + d] for d in k if 0 <= i + d < len(x)) / sum(k.values())

    want = [math.sqrt(smooth(chars, i) * smooth(punct, i) * chars[i] * punct[i]) * (hx.LOW if found[i][0].tag == "footer" else 1) for i in range(len(found))]
    assert np.allclose(hx.path_scores(found), want)
    limit = hx.THRESHOLD * max(np.std(want), np.mean(want))
    assert list(hx.content_paths(found)) == [any(w >= limit for w, q in zip(want, path) if q == p) for p in path]


def test_without_the_ratios_boilerplate_comes_out(monkeypatch):
    page = f"<body><div class='ad'>Buy this, now.</div><article><p>{LONG}</p></article></body>"
    assert lines(page) == [PARA]
    monkeypatch.setattr(hx, "content_paths", lambda found: np.ones(len(found), bool))
    assert lines(page) == ["Buy this, now.", PARA]


def test_deep_nesting_and_long_pages_end():
    deep = "<div>" * 20_000 + "x" + "".join(f"<div>a{i}, b." for i in range(3000))
    assert len(hx.blocks(deep)) == 3001
    assert hx.main_text("<body>" + f"<p>{LONG}</p>" * 5000).count(PARA) == 5000
