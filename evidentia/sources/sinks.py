"""Writers: reports, sessions as lines of JSON, result tables, appends that repeat harmlessly."""

from __future__ import annotations

import json
import math
import re
import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store import written


def report(df: DataFrame, path: str) -> None:
    """Text files with semicolons, every field quoted, quotes doubled, a byte order mark and a header in each file."""
    first, *rest = df.columns
    named = df.select(F.col(first).alias("\ufeff" + first), *rest)
    named.write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def session_lines(df: DataFrame, key: str, path: str) -> None:
    """Compressed lines of JSON, one for each operation with its rows inside; operations are bounded by what one study holds."""
    rest = F.struct(*[c for c in df.columns if c != key])
    df.groupBy(key).agg(F.sort_array(F.collect_list(rest)).alias("rows")).write.mode("overwrite").option("compression", "gzip").json(path)


def results(df: DataFrame, path: str, by: str) -> None:
    """Parquet in folders by a column of few values; only the folders that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, key: str, day: str) -> int:
    """Append the rows whose key is not at path yet, whatever its day, in folders by day; returns how many. Of what is there only the keys are read; of repeated keys in df one row enters."""
    spark = df.sparkSession
    rows = df.dropDuplicates([key])
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        rows = rows.join(old.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
    rows = written(rows, "append")
    n = rows.count()
    rows.write.mode("append").partitionBy(day).parquet(path)
    return n


def journal_export(events: DataFrame, path: str, by: str, order: list[str]) -> None:
    """The events as lines of JSON in folders by a column of few values, ordered within each file of a range of the order columns: files in order of name are in order of time."""
    rows = events.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    rows.write.mode("overwrite").option("compression", "gzip").partitionBy(by).json(path)


def learning_pull(events: DataFrame, kinds: tuple[str, ...], kind: str, order: list[str]) -> DataFrame:
    """The events of some kinds in order, sorted by ranges: nothing is gathered in one row."""
    return events.filter(F.col(kind).isin(*kinds)).orderBy(*order)


SHEET_ROWS = 1_048_576


class _Workbooks(DataSource):
    """A writer of spreadsheets: each task writes one file with as many sheets as its rows need, and the commit lists the files."""

    @classmethod
    def name(cls) -> str:
        return "evidentia_workbook"

    def writer(self, schema, overwrite: bool) -> "_WorkbookWriter":
        return _WorkbookWriter(self.options, [f.name for f in schema.fields])


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    sheets: int


class _WorkbookWriter(DataSourceWriter):
    def __init__(self, options, columns: list[str]) -> None:
        self.path, self.title, self.most, self.columns = options["path"], options.get("title", "Feuille"), int(options.get("most", SHEET_ROWS)), columns

    def write(self, iterator) -> "_Written":
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        fs.create_dir(root, recursive=True)
        no = TaskContext.get().partitionId()
        # An attempt has a name of its own; only the files that the commit lists count.
        file, rows, sheets = f"part-{no:05d}-{uuid.uuid4().hex[:8]}.xlsx", 0, 0
        with fs.open_output_stream(f"{root}/{file}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            iterator = iter(iterator)
            row = next(iterator, None)
            while row is not None or not sheets:
                sheets += 1
                with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + _row(1, self.columns))
                    at = 1  # the head is a row too
                    while row is not None and at < self.most:
                        at, rows = at + 1, rows + 1
                        sheet.write(_row(at, row))
                        row = next(iterator, None)
                    sheet.write(b"</sheetData></worksheet>")
            for part, text in _frame(self.title, sheets).items():
                book.writestr(part, text)
        return _Written(no, file, rows, sheets)

    def commit(self, messages) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        with fs.open_output_stream(f"{root}/index.json") as out:
            out.write(json.dumps([{"file": m.file, "rows": m.rows, "sheets": m.sheets} for m in done]).encode())

    def abort(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


def _column(k: int) -> str:
    name = ""
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def _row(at: int, values) -> bytes:
    cells = []
    for k, v in enumerate(values, 1):
        if v is None:
            continue
        place = f"{_column(k)}{at}"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
            cells.append(f'<c r="{place}"><v>{v!r}</v></c>')
        else:
            text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(v))
            cells.append(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    return f'<row r="{at}">{"".join(cells)}</row>'.encode()


def _frame(title: str, sheets: int) -> dict[str, str]:
    """The parts of a workbook around its sheets."""
    main, office, package = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006"))
    one = range(1, sheets + 1)
    named = "".join(f'<sheet name="{escape(title)[:24]} {k}" sheetId="{k}" r:id="rId{k}"/>' for k in one)
    links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in one)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in one)
    return {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{named}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{links}</Relationships>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{kinds}</Types>',
    }


def workbook(sheets: dict[str, DataFrame], path: str, most: int = SHEET_ROWS) -> dict[str, int]:
    """Each table as spreadsheets in a folder of its own (a path or URI that all machines share); returns the rows of each.

    A partition is a file; a sheet takes most rows, its head included, and the next rows begin another sheet, so none is lost. `index.json` lists the files that were committed, in
    order, with their rows. Nulls are empty cells; what is no number is text without the control characters that the format forbids.
    """
    rows = {}
    for name, df in sheets.items():
        df.sparkSession.dataSource.register(_Workbooks)
        df.write.format("evidentia_workbook").mode("append").option("path", f"{path}/{name}").option("title", name).option("most", str(most)).save()
        index = df.sparkSession.read.option("multiLine", True).schema("file string, rows bigint, sheets int").json(f"{path}/{name}/index.json")
        rows[name] = index.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return rows
