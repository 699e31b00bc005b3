"""Numbers, units, versions, dates and keys read from French texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold

_SPACES = " \u00a0\u202f\u2009"
#: A number with spaces between thousands or any separators, as one piece; no look-around, so other engines read it too.
NUMBER = f"[-+−]?(?:[0-9]{{1,3}}(?:[{_SPACES}][0-9]{{3}})+\\b|[0-9]+)(?:[.,][0-9]+)*"
_CHUNK = f"\\b[0-9]{{1,3}}(?:[{_SPACES}][0-9]{{3}})+\\b(?:,[0-9]+)?|[a-z0-9_]*[0-9](?:[a-z0-9_]|[.,][0-9])*"
_PLAIN = f"^[0-9]+(?:[{_SPACES}][0-9]{{3}})*(?:[.,][0-9]+)?$"


def as_double(raw: Column) -> Column:
    """A matched number as double; null where it is none."""
    return F.translate(raw, f",−{_SPACES}", ".-").try_cast("double")


def fr_number(c: Column) -> Column:
    """The first number of a text: thousands by spaces, decimals by comma or point; null with two or more separators or no number."""
    raw = F.regexp_extract(c, NUMBER, 0)
    parts = F.char_length(F.regexp_replace(raw, "[^.,]", ""))
    return F.when((raw != "") & (parts <= 1), as_double(raw))


def numbers_in(c: Column) -> Column:
    """All numbers of a text that stand alone: not glued to letters, thousands joined only where spaces make them certain."""
    found = F.regexp_extract_all(fold(c), F.lit(_CHUNK), F.lit(0))
    return F.transform(F.filter(found, lambda t: t.rlike(_PLAIN)), as_double)


def strip_unit_exponents(c: Column) -> Column:
    """m2, m3 and CO2 without their digit, so that it is not taken for a value."""
    return F.regexp_replace(F.regexp_replace(c, "(?i)\\b([ck]?m)[23²³]", "$1"), "(?i)\\bco2\\b", "CO")


def mask_rules(c: Column) -> Column:
    """Names of regulations and version numbers replaced by x, so that their digits are no values."""
    return F.regexp_replace(c, "(?i)\\br[et] ?20[0-9]{2}\\b|\\bv[0-9]+(?:\\.[0-9]+)+\\b", "x")


def number_with_unit(c: Column, unit: str) -> Column:
    """Numbers directly followed by the unit and then by no letter or digit."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})\\s*{unit}(?:[^A-Za-z0-9]|$)"), F.lit(1)), as_double)


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves upwards; null where the whole is not positive."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10)


def money(c: Column) -> Column:
    """Amounts of zero or more; others are null."""
    return F.when(c >= 0, c)


def version_key(c: Column) -> Column:
    """A dotted version as an array that sorts by its numbers."""
    return F.transform(F.split(c, "\\."), lambda t: F.coalesce(F.regexp_extract(t, "^[0-9]+", 0).try_cast("int"), F.lit(0)))


def revision(name: Column) -> Column:
    """The revision in a file name: IND C is 3, V1.8 is 1.08; null without one."""
    low = F.regexp_replace(fold(name), "[_ -]+", " ")
    letter, version = F.regexp_extract(low, "\\bind(?:ice)? ?([a-z])\\b", 1), F.regexp_extract_all(low, F.lit("\\bv([0-9]+)(?:\\.([0-9]+))?"), F.lit(1))
    minor = F.coalesce(F.regexp_extract(low, "\\bv[0-9]+\\.([0-9]+)", 1).try_cast("double"), F.lit(0.0))
    return F.when(letter != "", (F.ascii(letter) - 96).cast("double")).when(F.size(version) > 0, F.round(version[0].cast("double") + minor / 100, 2))


def iso_date(name: Column) -> Column:
    """The first date in a file name, year first or day first; null without a valid one."""
    y = F.regexp_extract(name, "((?:19|20)[0-9]{2})[-_.]?([01][0-9])[-_.]?([0-3][0-9])", 0)
    d = F.regexp_extract(name, "([0-3][0-9])[-_.]([01][0-9])[-_.]((?:19|20)[0-9]{2})", 0)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return F.coalesce(F.try_to_date(F.nullif(digits(y), F.lit("")), "yyyyMMdd"), F.try_to_date(F.nullif(digits(d), F.lit("")), "ddMMyyyy"))


def contract_key(c: Column) -> Column:
    """The digits of a contract number padded to eight; null with none or more than eight."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.char_length(digits).between(1, 8), F.lpad(digits, 8, "0"))


def glazing(c: Column) -> Column:
    """A glazing composition in one spelling: 4/16/4 Argon becomes 4.16.4 Ar."""
    tidy = F.regexp_replace(c, "([0-9]+)\\s*[/.-]\\s*([0-9]+)\\s*[/.-]\\s*([0-9]+)", "$1.$2.$3")
    return F.trim(F.regexp_replace(tidy, "(?i)\\s*\\bar(?:gon)?\\b", " Ar"))


def postal(c: Column) -> Column:
    """(postcode, commune, department) of an address line; nulls without a postcode."""
    code = F.nullif(F.regexp_extract(c, "\\b([0-9]{5})\\s+[^0-9,]", 1), F.lit(""))
    town = F.nullif(F.trim(F.regexp_extract(c, "\\b[0-9]{5}\\s+([^0-9,]+)", 1)), F.lit(""))
    overseas = F.substring(code, 1, 2).isin("97", "98")
    return F.struct(code.alias("postcode"), town.alias("commune"), F.when(overseas, F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2)).alias("department"))


def excerpt(c: Column, needle: str, around: int) -> Column:
    """The text around the first occurrence of a needle; null where there is none."""
    at = F.instr(c, needle)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(c, start, at - start + len(needle) + around))
