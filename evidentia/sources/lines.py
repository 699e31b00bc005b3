"""Lines of documents. Neighbouring lines come from the document's own row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def cut(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, idx, text, norm), one row for each line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("idx", "text"))
    return rows.withColumn("norm", fold(F.col("text")))


def _framed(docs: DataFrame, id_col: str, text_col: str, frame, name: str) -> DataFrame:
    whole = docs.select(F.col(id_col).alias("doc_id"), cut(F.col(text_col)).alias("_lines"))
    both = F.transform("_lines", lambda t, i: F.struct(t.alias("text"), frame(F.col("_lines"), t, i).alias(name)))
    return whole.select("doc_id", F.posexplode(both).alias("idx", "_row")).select("doc_id", "idx", "_row.text", f"_row.{name}")


def with_context(docs: DataFrame, before: int, after: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, idx, text, context): every line with its neighbours joined by ' | '."""

    def frame(rows, t, i):
        start = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice(rows, start + 1, i + after + 1 - start), " | ")

    return _framed(docs, id_col, text_col, frame, "context")


def sentence_block(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, idx, text, block): a line with the one before when that ends with a colon, or with the next when its sentence is open."""

    def frame(rows, t, i):
        prev, nxt = F.get(rows, i - 1), F.get(rows, i + 1)
        after_colon = F.coalesce(F.rtrim(prev).endswith(":"), F.lit(False))
        open_ = ~F.rtrim(t).rlike("[.:;]$") & nxt.isNotNull() & ~F.coalesce(nxt, F.lit("")).rlike("^\\s*[0-9]+[.)]")
        return F.when(after_colon, F.concat_ws(" ", prev, t)).when(open_, F.concat_ws(" ", t, nxt)).otherwise(t)

    return _framed(docs, id_col, text_col, frame, "block")
