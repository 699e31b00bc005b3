"""Tables on pages, read by the positions of their items: columns from the x bands of a header, cells stitched over lines.

A page's items (x, y, width, height, text; y grows upwards) are walked in order, pages one after another within a partition: lines by y, a header where enough of its labels stand, a
band for each header cell (borders lie half-way between neighbours), every later item in the band it overlaps most. A line goes on with the row above
if it fills only bands that this row lacks and not the first one, or if it is close below and meets no number in its bands, nor words with a number; every other line
begins a row. A gap of more than three line heights, or a line that overlaps no band, ends the table; a page may hold several.

Null texts are skipped, items without a position or height too; pages without a header give nothing. Items repeated at one place are stitched twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fr_number
from ..functions.text import fold

LABELS, GAP, NEAR = 2, 3.0, 1.4
_NUMBER = re.compile(r"[-+]?[\d ]+(?:[.,]\d+)?")
_DIGIT = re.compile(r"\d")


def _plain(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class _Bands:
    """Walks the items of one page, from the top."""

    def __init__(self, label: re.Pattern) -> None:
        self.label = label
        self.lines: list[list[tuple]] = []

    def add(self, x: float | None, y: float | None, w: float | None, h: float | None, t: str | None) -> None:
        if x is None or y is None or w is None or h is None or t is None or not t.strip():
            return
        if self.lines and abs(self.lines[-1][0][1] - y) <= max(2.0, 0.4 * h):
            self.lines[-1].append((x, y, w, h, t.strip()))
        else:
            self.lines.append([(x, y, w, h, t.strip())])

    def cells(self) -> Iterator[tuple]:
        """(table, row, col, label, value, head) of the page."""
        bands: list[tuple[str, float, float]] = []
        row: dict[int, str] = {}
        table = n = 0
        last_y = 0.0
        for line in self.lines:
            line.sort()
            if len(line) >= LABELS and sum(self.label.search(_plain(i[4])) is not None for i in line) >= LABELS:
                yield from self._cells(table, n, row, bands)
                table, n, row, bands = table + 1, 0, {}, self._borders(line)
                last_y = line[0][1]
                continue
            if not bands:
                continue
            height = max(i[3] for i in line)
            placed: dict[int, str] = {}
            for x, _, w, _, t in line:
                best, k = 0.0, -1
                for at, (_, lo, hi) in enumerate(bands):
                    over = min(x + w, hi) - max(x, lo)
                    if over > best:
                        best, k = over, at
                if k >= 0:
                    placed[k] = f"{placed[k]} {t}" if k in placed else t
            if not placed or last_y - line[0][1] > GAP * height:
                yield from self._cells(table, n, row, bands)
                row, bands = {}, []
                continue
            gap, last_y = last_y - line[0][1], line[0][1]
            numbered = {k for k, t in placed.items() if _DIGIT.search(t)}
            apart = not placed.keys() & row.keys()
            if row and (apart and 0 not in placed or gap <= NEAR * height and all(k not in row or not (k in numbered or _NUMBER.fullmatch(row[k])) for k in placed)):
                for k, t in placed.items():
                    row[k] = f"{row[k]} {t}" if k in row else t
            elif not row and n == 0 and not numbered:
                # The header itself goes on over a second line.
                bands = [(f"{name} {placed[k]}" if k in placed else name, a, b) for k, (name, a, b) in enumerate(bands)]
            else:
                if row:
                    yield from self._cells(table, n, row, bands)
                n, row = n + 1, placed
        yield from self._cells(table, n, row, bands)

    @staticmethod
    def _borders(line: list[tuple]) -> list[tuple[str, float, float]]:
        ends = [(t, x, x + w) for x, _, w, _, t in line]
        middle = [(a[2] + b[1]) / 2 for a, b in zip(ends, ends[1:])]
        return [(t, lo, hi) for (t, _, _), lo, hi in zip(ends, [float("-inf"), *middle], [*middle, float("inf")])]

    @staticmethod
    def _cells(table: int, n: int, row: dict[int, str], bands: list[tuple]) -> Iterator[tuple]:
        for k in sorted(row):
            yield table, n, k, bands[k][0], row[k], row.get(0)


def cells(items: DataFrame, header: str) -> DataFrame:
    """(doc, page, table, row, col, label, value, head) of items (doc, page, x, y, width, height, text); header is a pattern, without accents, that finds a header's labels, and head the row's first cell (null without one)."""
    kinds = {k: items.schema[k].dataType.simpleString() for k in ("doc", "page")}
    names = ["doc", "page", "table", "row", "col", "label", "value", "head"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = re.compile(header, re.I)
        key, page, out = None, None, []

        def table_of(schema: pa.Schema) -> pa.RecordBatch:
            types = [schema.field("doc").type, schema.field("page").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        schema = None
        for b in batches:
            schema = b.schema
            for doc, at, *item in zip(*(c.to_pylist() for c in b.columns)):
                if page is None or (doc, at) != key:
                    if page is not None:
                        out.extend((*key, *c) for c in page.cells())
                    key, page = (doc, at), _Bands(label)
                page.add(*item)
            if out:
                yield table_of(schema)
                out.clear()
        if page is not None:
            out.extend((*key, *c) for c in page.cells())
            yield table_of(schema)

    # A page's items come one after another, in batches that hold many pages; the number of partitions is given, as walking is dear for the size of what is shuffled.
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = items.select("doc", "page", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], "text").repartition(n, "doc", "page").sortWithinPartitions("doc", "page", F.col("y").desc(), "x")
    return sent.mapInArrow(walk, f"doc {kinds['doc']}, page {kinds['page']}, table int, row int, col int, label string, value string, head string")


def table_facts(found: DataFrame, fields: list[tuple[str, str, str]]) -> DataFrame:
    """(doc, page, table, row, field, value_num, value_text): cells whose row's first cell and whose column's label match a (row pattern, column pattern, field)."""
    field: Column = F.coalesce(*[F.when(fold(F.col("head")).rlike(r) & fold(F.col("label")).rlike(c), F.lit(name)) for r, c, name in fields])
    rest = found.filter("col > 0 and head is not null")
    return rest.withColumn("field", field).filter("field is not null").select("doc", "page", "table", "row", "field", fr_number(F.col("value")).alias("value_num"), F.col("value").alias("value_text"))
