"""Joins by tolerance, order, edit distance and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_before(points: DataFrame, marks: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """points with the value of the last mark at or before them in their group (as-of join by one sort, no pairing)."""
    both = points.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).unionByName(marks.select(*by, *order, value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_side = 1").drop("_side")


def global_fallback(rows: DataFrame, buildings: DataFrame, everywhere: str, by: list[str] | None = None, scoped: Column | None = None, most: int = 10_000) -> DataFrame:
    """Rows of their own building, and rows of the building named everywhere once for each building of their operation, flagged is_global.

    by names the columns of an operation that rows and buildings share. Buildings are folded to one array for each operation (up to `most`, else it raises), so that
    rows are joined by operation and fanned out where they are; without by there is one array, read as a scalar. Rows for which scoped holds
    stay out where the operation has several buildings.
    """
    own = rows.filter(F.col("building") != everywhere).withColumn("is_global", F.lit(False))
    shared = rows.filter(F.col("building") == everywhere).drop("building")
    few = F.when(F.size("_all") <= most, F.col("_all")).otherwise(F.raise_error(F.lit(f"more than {most} buildings in one operation")))
    names = buildings.filter(F.col("building") != everywhere).groupBy(*(by or [])).agg(F.collect_set("building").alias("_all")).withColumn("_all", few)
    fan = shared.join(names, by) if by else shared.withColumn("_all", names.scalar())
    if scoped is not None:
        fan = fan.filter(~(scoped & (F.size("_all") > 1)))
    fan = fan.withColumn("building", F.explode("_all")).drop("_all").withColumn("is_global", F.lit(True))
    return own.unionByName(fan)


def nearest_within(left: DataFrame, right: DataFrame, key: str, a: str, b: str, tolerance: float, tie: str) -> DataFrame:
    """left with the nearest right row of its key within the tolerance; cells of the tolerance's width keep the join an equi-join. Equal left rows are matched once and given back as often."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    r = right.withColumn("_cell", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1))).withColumnRenamed(key, "_key")
    once = left.groupBy(*left.columns).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    j = once.withColumn("_c", cell(a)).join(r, (F.col(key) == F.col("_key")) & (F.col("_c") == F.col("_cell")) & (F.abs(F.col(a) - F.col(b)) <= tolerance))
    best = j.groupBy(*left.columns, "_times").agg(F.min_by(F.struct(tie, b), F.struct(F.abs(F.col(a) - F.col(b)).alias("d"), F.col(tie).alias("t"))).alias("near"))
    return best.select(*left.columns, "near.*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_i")).drop("_i")


def _without(c: Column, most: Column) -> Column:
    """The text and every text with up to most (0 to 2) of its characters left out."""
    once = lambda t: F.when(F.char_length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    one = F.when(most >= 1, once(c)).otherwise(F.array().cast("array<string>"))
    two = F.when(most >= 2, F.flatten(F.transform(once(c), once))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, two))


def near_names(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(name, other, distance) for distinct texts within one edit (other of five characters or more) or two (eleven or more), of equal first letters.

    Texts meet where they agree after leaving out as many characters as they may differ in, so equal keys replace a comparison of
    all pairs; each meeting is then verified. Repeated texts enter once; nulls and empty texts meet nothing.
    """
    x = left.select(F.col(a).alias("name")).filter("name <> ''").distinct()
    y = right.select(F.col(b).alias("other")).filter("other <> ''").distinct()
    depth = lambda c, two, one: F.when(F.char_length(c) >= two, 2).when(F.char_length(c) >= one, 1).otherwise(0)
    x = x.select("name", F.substring("name", 1, 1).alias("letter"), F.explode(_without(F.col("name"), depth("name", 9, 4))).alias("key"))
    y = y.select("other", F.substring("other", 1, 1).alias("letter"), F.explode(_without(F.col("other"), depth("other", 11, 5))).alias("key"))
    met = x.join(y, ["letter", "key"]).select("name", "other").distinct().withColumn("distance", F.levenshtein(F.col("name"), F.col("other"), 2))
    return met.filter((F.col("distance") >= 0) & (F.col("distance") <= depth("other", 11, 5)))


def edit_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of left and right whose texts are near_names, with their distance."""
    pairs = near_names(left, right, a, b).select(F.col("name").alias("_name"), F.col("other").alias("_other"), "distance")
    return left.join(pairs, F.col(a) == F.col("_name")).join(right, F.col("_other") == F.col(b)).drop("_name", "_other")
