"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of tags (and classes). For every path of a page the length of its
text (links left out) and its punctuation are summed and set against the number of its blocks. The ratios, laid along the page in
block order, are smoothed with a Gaussian; length and punctuation are fused by their product, weighed with a prior, and
paths whose score reaches a share of the page's spread are content: their blocks are the text.

The prior says what tags, roles and names let expect: 1 for plain elements; LOW for footers, sidebars, forms, headers of the page and elements
named by boilerplate words and words of place or form only ("cookie-notice", "comments"); HALF where such a word is a part
of the name ("overflow-hidden"), may be a topic ("discussion") or stands in an id within an article; OUTSIDE beside the element that holds most of the text
in `article` and `main`, which themselves start anew at 1. Menus, controls and hidden elements have 0 and never come out. Ids of headings
and text blocks say nothing.

Headings, items and short paragraphs have low ratios by nature. Those in the article (the smallest element that holds all
content, or the `article` or `main` around it, or its parents as long as they add paragraphs) are added where they stand with content: not
if mostly links (unless in `article`), not under elements that look like boilerplate and hold more other text than content, not as
text of a bare container when the page's content stands in paragraphs, and headings or unfinished paragraphs only in a part
of the article that has content or a sentence.

White space inside a block becomes one space and blocks are joined by an empty line. Null or empty html gives an empty text.
Broken markup (unclosed or stray tags, a cut-off page) never fails: open elements end with the page. One row for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SIGMA, THRESHOLD, PARAGRAPH = 1.0, 0.25, 80
LOW, HALF, OUTSIDE = 0.03, 0.4, 0.1
#: Elements nested deeper stand beside each other, as in browsers; no text is lost.
DEPTH = 400

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP_TAGS = set("nav button select option dialog menu svg canvas object audio video map datalist".split())
DROP_ROLES = set("navigation search alert alertdialog dialog menu menubar toolbar".split())
LOW_TAGS = set("footer aside form".split())
LOW_ROLES = set("banner contentinfo complementary".split())
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar toolbar share sharing social related recommended "
    "comment comments commentlist discussion replies newsletter subscribe subscription signup login popup popups modal overlay widget widgets pagination pager skip hidden".split()
)
#: Words of DROP_WORDS that are often topics or parts of layouts, and words that only tell the place or form of what they stand with.
TOPIC_WORDS = set("discussion notice notices header promotion promotions skip foot widget widgets sharing".split())
FORM_WORDS = set("list lists container wrapper wrap box block area bar inner outer item items top bottom left right main site page post global form thread links icons slot unit section panel buttons".split())
KEEP_TAGS = set("html body main article".split())
TEXT_TAGS = set("p li dd dt blockquote pre td th caption figcaption h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCT = re.compile(r"[.,;:!?…。、，؛؟]")
_ENDED = re.compile(r"[.!?:;…。؟][\"'»”’)\]]*$")


class _Element:
    __slots__ = ("tag", "label", "parent", "order", "prior", "dropped", "linked", "article", "depth")

    def __init__(self, tag: str, attrs: str, parent: _Element | None, order: int):
        found: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(attrs) if attrs else ():
            found.setdefault(k.lower(), a or b or c)
        self.tag, self.label, self.parent, self.order = tag, f"{tag}.{found.get('class', '').strip().lower()}", parent, order
        self.depth = parent.depth + 1 if parent is not None else 0
        self.linked = tag == "a" or parent is not None and parent.linked
        #: The article or main element around, itself included.
        self.article = parent.article if parent is not None else None
        inside, role = self.article is not None, found.get("role", "").lower()
        none = tag in DROP_TAGS or role in DROP_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        low = tag in LOW_TAGS or role in LOW_ROLES or tag == "header" and not inside
        #: 2: the name says boilerplate; 1: a word of it does.
        named = max([_named(x, inside) for x in found.get("class", "").lower().split()], default=0)
        if tag not in TEXT_TAGS and tag not in INLINE:
            by_id = _named(found.get("id", "").lower(), inside)
            named = max(named, min(by_id, 1) if inside or tag == "section" else by_id)
        above = parent.prior if parent is not None else 1.0
        if tag in KEEP_TAGS and not {"comment", "comments"} & set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower())):
            none = low = False
            named = 0
            if tag in ("article", "main"):
                self.article = self
                above = 1.0 if above else 0.0
        if tag in INLINE:
            none |= named == 2
            named = 0
        self.prior = 0.0 if none else min(above, LOW if low or named == 2 else HALF if named else 1.0)
        self.dropped = self.prior == 0


@lru_cache(4096)
def _named(name: str, in_article: bool) -> int:
    """2 if a class or id is made of boilerplate words, 1 if a word of it is one or may be a topic, else 0."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    hits = DROP_WORDS.intersection(words)
    if not hits or in_article and "header" in words and "comment" not in words:
        return 0
    return 2 if hits - TOPIC_WORDS and all(w in DROP_WORDS or w in FORM_WORDS for w in words) else 1


def _up(e: _Element | None) -> Iterator[_Element]:
    while e is not None:
        yield e
        e = e.parent


#: An opening tag on the left ends an open one on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}


def blocks(html: str) -> list[tuple[_Element, str, float]]:
    """(element, text, share of it in links) of every block of text, in page order; text is not dropped here, scripts and titles aside."""
    out: list[tuple[_Element, str, float]] = []
    here = root = _Element("#", "", None, 0)
    parts: list[str] = []
    made = at = linked = 0
    owner: _Element | None = None

    def end_block():
        nonlocal owner, linked
        raw = "".join(parts)
        text = " ".join(unescape(raw).split())
        if text and owner is not None:
            out.append((owner, text, linked / len(raw)))
        parts.clear()
        owner, linked = None, 0

    def add(text: str):
        nonlocal owner, linked
        if text:
            if here.linked:
                linked += len(text)
            if owner is None and not text.isspace():
                owner = next((e for e in _up(here) if e.tag not in INLINE or e.dropped and not (e.parent and e.parent.dropped)), root)
            parts.append(text)

    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            parts.append(" ") if tag in ("br", "wbr") and tag == "br" else None
            if tag == "hr":
                end_block()
            continue
        if m[1]:
            if any(e.tag == tag for e in _up(here)):
                if tag not in INLINE or here.dropped:
                    end_block()
                while here.tag != tag:
                    here = here.parent
                here = here.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag not in INLINE:
            end_block()
            while any(e.tag == "p" for e in _up(here)) and here.tag != "#":
                if here.tag not in INLINE and here.tag != "p":
                    break
                here, was = here.parent, here.tag
                if was == "p":
                    break
            ends = CLOSES.get(tag, ())
            for e in _up(here):
                if e.tag in ends:
                    here = e.parent
                    break
                if e.tag not in INLINE and e.tag != "p":
                    break
        if m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        made += 1
        nxt = _Element(tag, m[3], here if here.depth < DEPTH else here.parent, made)
        if nxt.dropped and not here.dropped:
            end_block()
        here = nxt
    end_block()
    return out


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, k / k.sum(), "full")[reach : reach + len(x)]


def _article_of(found: list[tuple[_Element, str, float]]) -> _Element | None:
    """The article or main element with most of the text that stands in such elements; none if no one has."""
    chars: dict[int, int] = {}
    seen: dict[int, _Element] = {}
    for e, t, _ in found:
        outer = e.article
        while outer is not None:
            seen[id(outer)] = outer
            chars[id(outer)] = chars.get(id(outer), 0) + len(t)
            outer = outer.parent.article if outer.parent is not None else None
    total = sum(len(t) for e, t, _ in found if e.article is not None)
    most = [seen[k] for k, n in chars.items() if n > 0.6 * total]
    return max(most, key=lambda e: e.order) if most else None


def path_scores(found: list[tuple[_Element, str, float]], sigma: float = SIGMA) -> np.ndarray:
    """The score of each block: the fused, smoothed and weighed ratios of its path."""
    paths = ["/".join(e.label for e in _up(x)) for x, _, _ in found]
    names = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    path = np.array([names[p] for p in paths])
    nodes = np.bincount(path)
    chars = np.bincount(path, [len(t) * (1 - link) for _, t, link in found]) / nodes
    punct = np.bincount(path, [(1 + len(_PUNCT.findall(t))) for _, t, _ in found]) / nodes
    own = _article_of(found)
    prior = np.array([e.prior * (OUTSIDE if own is not None and not any(x is own for x in _up(e)) else 1.0) for e, _, _ in found])
    return np.sqrt(_smooth(chars[path], sigma) * _smooth(punct[path], sigma) * chars[path] * punct[path]) * prior


def content_paths(found: list[tuple[_Element, str, float]], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which blocks lie on content paths: those with a block whose score reaches the threshold."""
    score = path_scores(found, sigma)
    paths = ["/".join(e.label for e in _up(x)) for x, _, _ in found]
    good = {p for p, v in zip(paths, score, strict=True) if v > 0 and v >= threshold * max(score.std(), score.mean())}
    return np.array([p in good and v > 0 for p, v in zip(paths, score, strict=True)], bool)


def main_text(html: str | None) -> str:
    found = [x for x in blocks(html or "") if not x[0].dropped]
    if not found:
        return ""
    content = content_paths(found)
    if not content.any():
        return ""
    if max(e.prior for (e, _, _), c in zip(found, content, strict=True) if c) <= LOW:  # boilerplate is the article only if it reads like one
        read = [t for (_, t, _), c in zip(found, content, strict=True) if c]
        if sum(map(len, read)) < 3 * PARAGRAPH or sum(len(_PUNCT.findall(t)) for t in read) < 3:
            return ""
    return "\n\n".join(t for (_, t, _), k in zip(found, _with_short(found, content), strict=True) if k)


def _with_short(found: list[tuple[_Element, str, float]], content: np.ndarray) -> list[bool]:
    """Content blocks, and the short blocks of the article that stand with them."""
    chains = [list(_up(e))[::-1] for e, _, _ in found]
    common = None
    for chain, c in zip(chains, content, strict=True):
        if c:
            common = chain if common is None else [e for e, f in zip(common, chain) if e is f]
    top = common[-1].article or _climb(common[-1], found)
    chars, held = {}, {}
    for (_, t, _), chain, c in zip(found, chains, content, strict=True):
        for e in chain:
            chars[id(e)] = chars.get(id(e), 0) + len(t)
            held[id(e)] = held.get(id(e), 0) + len(t) * bool(c)
    in_text = sum(len(t) for (e, t, _), c in zip(found, content, strict=True) if c and e.tag in TEXT_TAGS)
    paragraphs = 2 * in_text > sum(len(t) for (_, t, _), c in zip(found, content, strict=True) if c)

    def part(chain: list) -> _Element | None:
        """The child of the article that a block stands in; None outside."""
        at = next((i for i, e in enumerate(chain) if e is top), None)
        return None if at is None else chain[min(at + 1, len(chain) - 1)]

    parts = [part(chain) for chain in chains]
    kept, waiting = list(map(bool, content)), []
    for i, ((e, t, link), chain) in enumerate(zip(found, chains, strict=True)):
        if kept[i] or parts[i] is None or link >= 0.8 and e.article is None:
            continue
        below = chain[next(k for k, x in enumerate(chain) if x is top) + 1 :]
        # An element that brings a lower prior is boilerplate unless half of its text is content.
        if any(x.prior < x.parent.prior and 2 * held[id(x)] < chars[id(x)] for x in below):
            continue
        tag = next((x.tag for x in reversed(below) if x.tag in TEXT_TAGS), None)
        if tag is None:
            kept[i] = bool(_ENDED.search(t)) and not paragraphs or e is top and bool(_ENDED.search(t))
        elif tag[0] == "h" or tag == "p" and not _ENDED.search(t):
            if parts[i] is e:
                kept[i] = True
            else:
                waiting.append(i)
        else:
            kept[i] = True
    alive = {id(p) for p, k in zip(parts, kept, strict=True) if k and p is not None}
    for i in waiting:
        kept[i] = id(parts[i]) in alive
    return kept


def _climb(top: _Element, clean: list[tuple[_Element, str, float]]) -> _Element:
    """The highest parent on the way to body that adds paragraphs, and to body itself for paragraphs that stand in it."""
    if top.parent and (top.tag in INLINE or top.tag in TEXT_TAGS):
        top = top.parent
    best = top
    inside = lambda x, e: any(y is e for y in _up(x))
    for e in _up(top.parent):
        out = [x for x, t, _ in clean if x.prior == 1 and len(t) >= PARAGRAPH and _PUNCT.search(t) and inside(x, e) and not inside(x, best)]
        if e.tag in ("body", "html", "#"):
            out = [x for x in out if x is e or x.tag in TEXT_TAGS and x.parent is e]
        if out:
            best = e
    return best


def all_text(html: str | None) -> str:
    """Every block of visible text, boilerplate too, one on a line."""
    return "\n".join(t for _, t, _ in blocks(html or ""))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), whole: bool = False) -> DataFrame:
    """The columns of keep with text (the main text, or all text) and n_chars."""
    from pyspark.sql import types as T

    shown = [pages.schema[name] for name in keep]
    schema = T.StructType([*[T.StructField(f"k_{i}", f.dataType) for i, f in enumerate(shown)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    reader = all_text if whole else main_text

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [reader(h if isinstance(h, str) else None) for h in b["_html"]]
            yield b.drop(columns="_html").assign(text=texts, n_chars=[len(t) for t in texts])

    sent = small_batches(pages).select(*[F.col(f.name).alias(f"k_{i}") for i, f in enumerate(shown)], F.col(html_col).alias("_html"))
    return sent.mapInPandas(of, schema).select(*[F.col(f"k_{i}").alias(f.name) for i, f in enumerate(shown)], "text", "n_chars")
