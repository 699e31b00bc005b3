"""Text as columns: folding, numbers, tokens."""

from __future__ import annotations

import re
import unicodedata
import warnings
from functools import cache
from re import _parser as _sre

from pyspark.sql import Column
from pyspark.sql import functions as F

_SOURCE = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1)
_TARGET = "".join(unicodedata.normalize("NFD", c)[0] for c in _SOURCE)

#: Quotes and spaces with their plain forms.
_MARKS, _PLAIN = "\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a0\u202f\u2009", "''\"\"\"\"   "


def fold(c: Column) -> Column:
    """Lower case without accents; ligatures and ß stay."""
    return F.lower(F.translate(c, _SOURCE, _TARGET))


def normalize(c: Column) -> Column:
    """Without accents, with plain quotes and single spaces, trimmed; a NUL, as some PDF fonts give for it, becomes fi."""
    c = F.translate(F.replace(c, F.lit("\0"), F.lit("fi")), _SOURCE + _MARKS, _TARGET + _PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\u0300-\u036f]", ""), "\\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct folded words of letters and digits."""
    return F.array_distinct(F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda t: t != ""))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it: as a plain column it would be put into each place that does."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """The share of the tokens of whole that are in part."""
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole)).otherwise(0.0)


def value_key(number: Column, text: Column) -> Column:
    """What makes two readings the same value: six decimals, or the folded text with single spaces."""
    return F.when(number.isNotNull(), F.format_string("%.6f", number)).otherwise(F.regexp_replace(F.trim(fold(text)), "\\s+", " "))


def same_number(a: Column, b: Column) -> Column:
    """Equal within 0.051 or a thousandth."""
    return F.abs(a - b) <= F.greatest(F.lit(0.051), F.abs(b) * 0.001)


def _literals(items) -> tuple[str, ...]:
    """Of a parsed pattern: texts one of which is in whatever it matches; none if that can't be told."""
    found: list[tuple[str, ...]] = []
    run = ""
    for kind, what in items:
        if kind is _sre.LITERAL:
            run += chr(what)
            continue
        if kind in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT):
            continue
        found, run = [*found, (run,)], ""
        if kind is _sre.SUBPATTERN:
            found.append(_literals(what[3]))
        elif kind in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT) and what[0] > 0:
            found.append(_literals(what[2]))
        elif kind is _sre.BRANCH:
            each = [_literals(x) for x in what[1]]
            found.append(tuple(dict.fromkeys(t for x in each for t in x)) if all(each) else ())
    good = [x for x in (*found, (run,)) if x and min(map(len, x)) > 1]
    return max(good, key=lambda x: min(6, *map(len, x)) - len(x) / 2, default=())


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case texts one of which is in every text, lower-cased, that bears a pattern; none if that can't be told (as for patterns that Python doesn't know)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return tuple(t.lower() for t in _literals(_sre.parse(pattern)))
    except (re.error, OverflowError):
        return ()


def bears(text: Column, low: Column, pattern: str) -> Column:
    """text.rlike(pattern), whatever its case; low is the text in lower case. Patterns are tried only where their words stand, which is much cheaper to see."""
    words = needed(pattern)
    fits = text.rlike(f"(?i){pattern}")
    if not words:
        return fits
    some = low.contains(words[0])
    for w in words[1:]:
        some = some | low.contains(w)
    return some & fits
