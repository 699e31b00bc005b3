"""Readers that end in rows of text: separated files, lists, tables in HTML, XML leaves, key=value texts, page items, OCR."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import contract_key
from ..functions.text import fold

# Common French words; a text in which they are rare was read badly.
COMMON = ("le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "au", "aux", "pour", "par", "sur", "dans", "est", "avec", "ou")


def kind_of(path: Column) -> Column:
    """The reader for a path by its extension; null for none."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("xls", "xlsx"), "table").when(ext.isin("pdf", "xml", "csv", "json", "txt"), ext)


#: Bytes 128 to 159 of Windows-1252 as Latin-1 reads them, and what they stand for.
_LATIN_1 = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def separated(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, cells) of text files: UTF-8, else Windows-1252; the separator is the most frequent of ; tab and comma in the first twenty lines.

    Files are read in splits, so none has to fit in a task: a line's number is its place in its split plus the lines of the splits before.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = t.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    file = Window.partitionBy("path")
    splits = splits.select("path", "start", "first", F.bool_and("ok").over(file).alias("utf8"), (F.sum("n").over(file.orderBy("start")) - F.col("n")).alias("before"))
    latin = F.translate(F.decode(F.col("value").cast("binary"), "iso-8859-1"), _LATIN_1, _WINDOWS)
    rows = t.join(splits, ["path", "start"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("idx"), F.when(F.col("utf8"), F.col("value")).otherwise(latin).alias("line"))
    count = lambda s: F.sum(F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(s), F.lit(""))))
    found = F.array_max(F.array(*[F.struct(count(s).alias("n"), F.lit(-i).alias("first"), F.lit(s).alias("sep")) for i, s in enumerate([";", "\t", ","])]))["sep"]
    rows = rows.filter("line <> ''").join(rows.filter("idx < 20").groupBy("path").agg(found.alias("sep")), "path")
    cells = F.split("line", F.concat(F.col("sep"), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    return rows.select("path", "idx", F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).alias("cells"))


def contracts(texts: DataFrame, text_col: str) -> DataFrame:
    """(contract, n) of a column with one number in a row; rows that are none have a null contract, repeated ones n above 1."""
    return texts.groupBy(contract_key(F.col(text_col)).alias("contract")).agg(F.count(F.lit(1)).alias("n"))


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row, col, text) of the cells of all tables; a page without tables gives nothing."""
    rows = F.split(F.coalesce(F.col(html_col), F.lit("")), "(?i)<tr\\b[^>]*>")
    r = pages.select(F.col(id_col), F.posexplode(F.slice(rows, 2, F.size(rows))).alias("row", "_r"))
    cells = F.regexp_extract_all(F.col("_r"), F.lit("(?is)<t[dh]\\b[^>]*>(.*?)(?:</t[dh]>|$)"), F.lit(1))
    return r.select(id_col, "row", F.posexplode(cells).alias("col", "_c")).select(id_col, "row", "col", plain_text(F.col("_c")).alias("text"))


#: An anchor up to the end of the value of its href, which may be quoted either way or bare.
_HREF = """(?is)<a(?=\\s)(?:[^>"']|"[^"]*"|'[^']*')*?\\shref\\s*=\\s*(?:"[^"]*"|'[^']*'|[^\\s>"']+)"""


def html_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, idx, href) of all links in page order, wherever the href stands in its tag and however it is quoted."""
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_HREF), F.lit(0))).alias("idx", "_a"))
    return found.select(id_col, "idx", F.regexp_replace(F.regexp_extract("_a", """(?is)\\shref\\s*=\\s*("[^"]*"|'[^']*'|[^\\s>"']+)$""", 1), """^["']|["']$""", "").alias("href"))


def plain_text(c: Column) -> Column:
    """Text of an HTML fragment: no markup, the five character references of XML decoded, single spaces."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, "\\s+", " "))


_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[?!][^>]*(?:>|$)|<(/?)([A-Za-z_][\w.:-]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<""", re.S)


def _leaves(text: str) -> Iterator[tuple[str, str]]:
    """(path, value) of elements without children; a closing tag ends what is open inside its element, a stray one nothing, the end of the text all."""
    open_: list[list] = []  # [name, text, whether it has children]

    def close() -> Iterator[tuple[str, str]]:
        _, value, parent = open_[-1]
        if not parent and value.strip():
            yield "/" + "/".join(o[0] for o in open_), html.unescape(value.strip())
        open_.pop()

    at = 0
    for m in _MARKUP.finditer(text):
        if open_:
            open_[-1][1] += text[at : m.start()] + (m[1] or "") + ("<" if m[0] == "<" else "")
        at = m.end()
        name = (m[3] or "").rsplit(":", 1)[-1]
        if name and m[2]:
            if any(o[0] == name for o in open_):
                while open_[-1][0] != name:
                    yield from close()
                yield from close()
        elif name:
            if open_:
                open_[-1][2] = True
            open_.append([name, "", False])
            if m[4].endswith("/"):
                open_.pop()
    if open_:
        open_[-1][1] += text[at:]
    while open_:
        yield from close()


def xml_leaves(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, idx, path, value) of every element without children that has text. Broken XML gives what can be read of it; null gives nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(key, i, *leaf) for key, text in zip(b.iloc[:, 0], b.iloc[:, 1]) if text for i, leaf in enumerate(_leaves(text))]
            yield pd.DataFrame(out, columns=["id", "idx", "path", "value"])

    return docs.select(id_col, xml_col).mapInPandas(read, f"id {docs.schema[id_col].dataType.simpleString()}, idx int, path string, value string")


def key_values(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, label, value) of lines like label = value or label : value; the label is folded."""
    d = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("idx", "_l")).filter(F.col("_l").rlike("^[^=:]{1,80}[=:]\\s*\\S"))
    return d.select(id_col, "idx", F.trim(fold(F.regexp_extract("_l", "^([^=:]+)[=:]", 1))).alias("label"), F.trim(F.regexp_extract("_l", "^[^=:]+[=:](.*)$", 1)).alias("value"))


def header_row(cells: DataFrame, by: list[str], words: tuple[str, ...], within: int = 40) -> DataFrame:
    """(by, row): the first of so many rows (by, row, text) that has one of the words in most cells."""
    hit = F.count_if(fold(F.col("text")).rlike("|".join(words)))
    per = cells.filter(F.col("row") < within).groupBy(*by, "row").agg(hit.alias("n")).filter("n > 0")
    return per.groupBy(*by).agg(F.max_by("row", F.struct("n", (-F.col("row")).alias("r"))).alias("row"))


def assemble(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, text): items (by, x, y, height, width, text) of a page grouped into lines from the top.

    An item joins the line above while its y is within max(2.8, min(6, 0.45 height)) of the line's mean; a gap of more than 2 gives
    a space. The mean runs along the items, so a page is walked in order; a group is one page.
    """
    schema = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in by) + ", line int, text string"

    def walk(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        found: list[list] = []
        for x, y, h, w, t in page.sort_values(["y", "x"], ascending=[False, True])[["x", "y", "height", "width", "text"]].itertuples(index=False):
            if found and abs(sum(i[1] for i in found[-1]) / len(found[-1]) - y) <= max(2.8, min(6.0, 0.45 * h)):
                found[-1].append((x, y, w, t))
            else:
                found.append([(x, y, w, t)])
        out = []
        for n, line in enumerate(found):
            text, end = "", None
            for x, _, w, t in sorted(line, key=lambda i: i[0]):
                text += (" " if end is not None and x - end > 2 else "") + (t or "")
                end = x + w
            out.append((*key, n, text))
        return pd.DataFrame(out, columns=[*by, "line", "text"])

    return items.groupBy(*by).applyInPandas(walk, schema)


def quality(text: Column) -> Column:
    """(alnum, symbols, common, garbled, score) of a text: shares of letters and digits, of odd symbols, and of common words; garbled where
    common words are under 2 % or symbols over 12 %. An empty or null text scores 0 and is not garbled."""
    t = F.coalesce(text, F.lit(""))
    solid = F.char_length(F.regexp_replace(t, "\\s", ""))
    alnum = F.coalesce(F.try_divide(F.char_length(F.regexp_replace(fold(t), "[^a-z0-9]", "")), solid), F.lit(0.0))
    symbols = F.coalesce(F.try_divide(F.char_length(F.regexp_replace(fold(t), "[a-z0-9\\s.,;:'()%/-]", "")), solid), F.lit(0.0))
    words = F.filter(F.split(fold(t), "[^a-z]+"), lambda w: w != "")
    common = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.isin(*COMMON))), F.size(words)), F.lit(0.0))
    garbled = (F.size(words) > 0) & ((common < 0.02) | (symbols > 0.12))
    return F.struct(alnum.alias("alnum"), symbols.alias("symbols"), common.alias("common"), garbled.alias("garbled"), F.when(garbled, 0.0).otherwise(F.round(alnum * (1 - symbols), 6)).alias("score"))


def merge_ocr(native: DataFrame, ocr: DataFrame, by: list[str], covered: float = 0.8) -> DataFrame:
    """(by, text, origin): native lines, and OCR lines of the page of whose words no native line has 80 % or more.

    Lines meet on their page and a word; words are counted by pairs that met, pages bound how many lines meet.
    """
    words = lambda df, name: df.select(*by, F.col("text").alias(name), F.array_distinct(F.filter(F.split(fold(F.col("text")), "[^a-z0-9]+"), lambda w: w != "")).alias("w")).distinct()
    n, o = words(native, "text"), words(ocr, "line")
    met = n.select(*by, "text", F.explode("w").alias("x")).join(o.select(*by, "line", F.size("w").alias("size"), F.explode("w").alias("x")), [*by, "x"])
    seen = met.groupBy(*by, "text", "line", "size").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= covered * F.col("size")).select(*by, "line").distinct()
    new = o.filter("size(w) > 0").join(seen, [*by, "line"], "left_anti").select(*by, F.col("line").alias("text"), F.lit("ocr").alias("origin"))
    return native.select(*by, "text", F.lit("native").alias("origin")).unionByName(new)
