"""Which file of a family is the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import iso_date, revision
from ..functions.text import fold


def document_key(name: Column) -> Column:
    """A file name without extension, revision and date: what versions of one document have in common."""
    low = F.regexp_replace(fold(name), "\\.[a-z0-9]{1,5}$", "")
    bare = F.regexp_replace(low, "(?:19|20)[0-9]{2}[-_.]?[01][0-9][-_.]?[0-3][0-9]|[0-3][0-9][-_.][01][0-9][-_.](?:19|20)[0-9]{2}|[ _-]ind(?:ice)?[ _-]*[a-z](?=[ _.-]|$)|[ _-]v[0-9]+(?:\\.[0-9]+)?", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def archived(folder: Column) -> Column:
    """Whether a folder's name says that its files are out of date."""
    return F.coalesce(fold(folder).rlike("(?:^|[^a-z])(?:archives?|obsoletes?|perimes?|anciens?|old)(?:[^a-z]|$)"), F.lit(False))


def rank_files(files: DataFrame, by: list[str]) -> DataFrame:
    """files (name, folder, mtime, ...) with key, revision, date, version (1 is current) and ambiguous.

    Order: not archived, revision, date, time of change, then name; ambiguous marks groups whose first two agree in all but the name.
    """
    f = files.withColumn("key", document_key(F.col("name"))).withColumn("revision", revision(F.col("name"))).withColumn("date", iso_date(F.col("name"))).withColumn("_old", archived(F.col("folder")))
    w = Window.partitionBy(*by, "key").orderBy("_old", F.col("revision").desc_nulls_last(), F.col("date").desc_nulls_last(), F.col("mtime").desc_nulls_last(), "name")
    same = [F.lead(c).over(w).eqNullSafe(F.col(c)) for c in ("_old", "revision", "date", "mtime")]
    tie = same[0] & same[1] & same[2] & same[3] & F.lead("name").over(w).isNotNull()
    return f.withColumn("version", F.row_number().over(w)).withColumn("ambiguous", (F.col("version") == 1) & tie).drop("_old")


def fresh(files: DataFrame, by: list[str], time: str, days: int = 45) -> DataFrame:
    """Files within so many days of their group's newest."""
    newest = files.groupBy(*by).agg(F.max(time).alias("_newest"))
    return files.join(newest, by).filter(F.datediff("_newest", time) <= days).drop("_newest")


def compare_listings(before: DataFrame, after: DataFrame, key: str, seconds: float = 2.0) -> DataFrame:
    """(key, state): added, gone, changed (another size, or times further apart) or same, of two listings (key, size, mtime in seconds)."""
    a = before.select(F.col(key).alias("_a"), F.col("size").alias("_s"), F.col("mtime").alias("_t"))
    b = after.select(F.col(key).alias("_b"), "size", "mtime")
    moved = ~F.col("_s").eqNullSafe(F.col("size")) | (F.abs(F.col("_t") - F.col("mtime")) > seconds)
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").when(moved, "changed").otherwise("same")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), state.alias("state"))
