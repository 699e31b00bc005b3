"""Pages as they come from readers: quality of their text layer, recognised blocks, cells by columns, spreadsheets, kept and retained readings."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, let
from .formats import COMMON


def layer_quality(text: Column, items: Column) -> Column:
    """(score, chars, alnum, weird, fragments, garbled) of a page's text layer with so many items.

    Score 0 to 1: .28 length (520 characters), .38 letters and digits, .20 items (65), .09 no replacement signs, .05 no lone signs; a garbled layer (common words under 2 % of twenty or more words, symbols over 12 %
    of eighty or more characters) scores .05, an empty one 0.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))

    def cut(raw: Column) -> Column:
        part = lambda pattern: F.char_length(F.regexp_replace(raw, f"[^{pattern}]", ""))
        tokens, words = F.filter(F.split(raw, " "), lambda t: t != ""), F.filter(F.split(fold(raw), "[^a-z]+"), lambda w: w != "")
        return F.struct(F.char_length(raw).alias("n"), part("A-Za-zÀ-ÿ0-9").alias("alnum"), part("�□■◆◇▯-").alias("weird"), tokens.alias("tokens"), words.alias("words"), F.regexp_replace(raw, "\\s+", "").alias("solid"))

    def counted(x: Column) -> Column:
        over = lambda part, whole: part / F.greatest(whole, F.lit(1))
        fragments = over(F.size(F.filter(x["tokens"], lambda t: t.rlike("^[^0-9A-Za-zÀ-ÿ]$"))), F.size(x["tokens"]))
        common = over(F.size(F.filter(x["words"], lambda w: w.isin(*COMMON))), F.size(x["words"]))
        symbols = over(F.char_length(F.regexp_replace(x["solid"], "[^!\"#$%&()*+/:;<=>?@\\[\\]^_`{|}~]", "")), F.char_length(x["solid"]))
        garbled = (F.size(x["words"]) >= 20) & (common < 0.02) | (F.char_length(x["solid"]) >= 80) & (symbols > 0.12)
        return F.struct(x["n"].alias("n"), over(x["alnum"], x["n"]).alias("alnum"), over(x["weird"], x["n"]).alias("weird"), fragments.alias("fragments"), garbled.alias("garbled"))

    def scored(x: Column) -> Column:
        n, alnum, weird, fragments, garbled = (x[k] for k in ("n", "alnum", "weird", "fragments", "garbled"))
        score = F.least(F.lit(1.0), n / 520) * 0.28 + alnum * 0.38 + F.least(F.lit(1.0), items / 65) * 0.20 + (1 - F.least(F.lit(1.0), weird * 7)) * 0.09 + (1 - F.least(F.lit(1.0), fragments * 4)) * 0.05
        return F.struct(F.when(n == 0, 0.0).when(garbled, 0.05).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"), n.alias("chars"), alnum.alias("alnum"), F.when(n == 0, 1.0).otherwise(weird).alias("weird"), F.when(n == 0, 1.0).otherwise(fragments).alias("fragments"), garbled.alias("garbled"))

    return let(let(let(raw, cut), counted), scored)


def clean_dense(q: Column, items: Column) -> Column:
    """Whether a layer of this quality is clean and dense: nothing is left for recognition to read."""
    return ~q["garbled"] & (q["chars"] >= 350) & (items >= 25) & (q["alnum"] >= 0.6) & (q["weird"] <= 0.01) & (q["fragments"] <= 0.12)


def needs_recognition(q: Column, items: Column, mode: str = "auto", images: Column | None = None, critical: Column | None = None) -> Column:
    """Whether a page has to be recognised from its image: off never, max always, always all but clean dense pages without images; auto where a critical table is incomplete or the layer is empty, garbled, poor or broken, never for short clean pages."""
    if mode in ("off", "max"):
        return F.lit(mode == "max")
    if mode == "always":
        return ~(clean_dense(q, items) & ~(images if images is not None else F.lit(True)))
    short = (q["chars"] >= 24) & (q["alnum"] >= 0.62) & (q["weird"] <= 0.012) & (q["fragments"] <= 0.12)
    poor = (q["alnum"] < 0.48) | (q["weird"] > 0.02) | (q["fragments"] > 0.22)
    out = F.when(critical, True) if critical is not None else F.when(F.lit(False), True)
    out = out.when((q["chars"] == 0) | (items == 0) | q["garbled"], True).when(short, False).when((q["chars"] < 45) | (items < 3), poor)
    return out.otherwise((q["score"] < 0.43) | (q["weird"] > 0.03) | (q["fragments"] > 0.24))


def recognised_lines(pages: DataFrame, by: list[str], blocks: str = "blocks") -> DataFrame:
    """(by, idx, text, y, confidence) of recognised pages: blocks an array of (lines: array of (text, confidence, bbox (x0, y0, x1, y1))); blank lines are left out."""
    lines = F.flatten(F.transform(F.coalesce(F.col(blocks), F.array()), lambda b: F.coalesce(b["lines"], F.array())))
    kept = F.filter(lines, lambda x: F.coalesce(F.trim(x["text"]) != "", F.lit(False)))
    rows = pages.select(*by, F.posexplode(kept).alias("idx", "_x"))
    return rows.select(*by, "idx", F.trim("_x.text").alias("text"), F.col("_x.bbox.y0").alias("y"), F.col("_x.confidence").alias("confidence"))


def cells_by_column(items: DataFrame, heads: DataFrame, by: list[str], slack: float = 6.0) -> DataFrame:
    """items (by, x, text) with column, the last header (by, x, name) that begins at or left of the item, up to slack to its right; null left of all. One sort for each page, no pairing."""
    both = items.withColumn("_x", F.col("x").cast("double")).withColumn("_side", F.lit(1)).withColumn("column", F.lit(None).cast("string"))
    both = both.unionByName(heads.select(*by, (F.col("x") - slack).cast("double").alias("_x"), F.lit(0).alias("_side"), F.col("name").alias("column")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("column", F.last("column", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_x")


_CELL = re.compile(r'<c\b([^>]*?)(?:/>|>(.*?)</c>)', re.S)
_TEXT = re.compile(r"<t\b[^>]*>(.*?)</t>", re.S)


def _sheets(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, text) of the filled cells of a workbook; what is no workbook gives nothing."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [html.unescape("".join(_TEXT.findall(si))) for si in re.findall(r"<si\b[^>]*>(.*?)</si>", book.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.S)]
        head = book.read("xl/workbook.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return
    links = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for tag in re.findall(r"<Relationship\b[^>]*>", book.read("xl/_rels/workbook.xml.rels").decode("utf-8", "replace")):
            one = dict(re.findall(r'\b(Id|Target)="([^"]*)"', tag))
            links[one.get("Id")] = posixpath.normpath(posixpath.join("/xl", html.unescape(one.get("Target", "")))).lstrip("/")
    # A sheet's file is what its relationship names; only a workbook without relationships has them by number.
    for k, tag in enumerate(re.findall(r"<sheet\b[^>]*>", head), 1):
        title, link = re.search(r'\bname="([^"]*)"', tag), re.search(r'\br:id="([^"]*)"', tag)
        file = links.get(link[1], "") if link and links else f"xl/worksheets/sheet{k}.xml"
        if not title or file not in names:
            continue
        title, data = title[1], book.read(file).decode("utf-8", "replace")
        for attrs, body in _CELL.findall(data):
            at = re.search(r'\br="([A-Z]+)([0-9]+)"', attrs)
            kind = re.search(r'\bt="(\w+)"', attrs)
            value = re.search(r"<v>(.*?)</v>", body, re.S)
            if kind and kind[1] == "inlineStr":
                text = html.unescape("".join(_TEXT.findall(body)))
            elif value and kind and kind[1] == "s":
                text = shared[int(value[1])] if int(value[1]) < len(shared) else ""
            else:
                text = html.unescape(value[1]) if value else ""
            if at and text.strip():
                col = 0
                for c in at[1]:
                    col = col * 26 + ord(c) - 64
                yield html.unescape(title), int(at[2]) - 1, col - 1, text.strip()


def spreadsheets(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sheet, row, col, text) of the filled cells of workbooks (xlsx) read as binary files; other files and null give nothing. The used range of a sheet is that of its filled cells, whatever the file declares."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                yield pd.DataFrame([(p, *cell) for cell in _sheets(c or b"")], columns=["path", "sheet", "row", "col", "text"])

    return files.select(path, content).mapInPandas(of, "path string, sheet string, row int, col int, text string")


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, text): a line for each row that has cells, joined by ' | ' in order of columns, blanks between them kept."""
    g = cells.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("col").alias("last"))
    return g.select("path", "sheet", "row", F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), " | ").alias("text"))


def used_range(cells: DataFrame) -> DataFrame:
    """(path, sheet, first_row, last_row, first_col, last_col) of what is filled."""
    return cells.groupBy("path", "sheet").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def with_retained(facts: DataFrame, removed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """facts and those of removed documents, flagged removed; a document that was read again counts as it is now."""
    kept = removed.join(facts.select(doc).distinct(), doc, "left_anti")
    return facts.withColumn("removed", F.lit(False)).unionByName(kept.withColumn("removed", F.lit(True)), allowMissingColumns=True)


def manual_facts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, value, method, confidence, definitive): a row for each filled field of rows entered by hand."""
    each = F.array_compact(F.array(*[F.when(F.trim(F.col(f).cast("string")) != "", F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value"))) for f in fields]))
    return rows.select(*keys, F.inline(each)).withColumn("method", F.lit("manual:paste")).withColumn("confidence", F.lit(1.0)).withColumn("definitive", F.lit(True))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results or sessions: lines of JSON, compressed or not."""
    return spark.read.json(path)


def last_events(events: DataFrame, order: list[str], most: int, unsynced: Column | None = None) -> DataFrame:
    """The last so many events (that are not synced yet) in order of time."""
    e = events.filter(unsynced) if unsynced is not None else events
    return e.orderBy(*[F.col(c).desc() for c in order]).limit(most).orderBy(*order)
