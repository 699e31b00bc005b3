"""Plausibility, constraints between fields, derived columns, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper limits of the energy and greenhouse classes A to F.
ENERGY_LIMITS = (70, 110, 180, 250, 330, 420)
CARBON_LIMITS = (6, 11, 30, 50, 70, 100)


def letter(value: Column, limits: tuple[int, ...]) -> Column:
    """The class of a value: A up to the first limit, G above the last; null for null."""
    out = F.when(value.isNull(), None)
    for name, top in zip("ABCDEF", limits):
        out = out.when(value <= top, name)
    return out.otherwise("G")


def energy_class(energy: Column, carbon: Column) -> Column:
    """The worse of the two classes; of the one there is if the other is null."""
    return F.greatest(letter(energy, ENERGY_LIMITS), letter(carbon, CARBON_LIMITS))


def differs(a: Column, b: Column) -> Column:
    """Whether two numbers differ by more than 0.051 and more than a thousandth of the larger."""
    return F.abs(a - b) > F.greatest(F.lit(0.051), F.greatest(F.abs(a), F.abs(b)) / 1000)


def texts_differ(a: Column, b: Column) -> Column:
    """Whether two folded texts are neither equal nor, from three characters on, one within the other."""
    within = (F.char_length(a) >= 3) & b.contains(a) | (F.char_length(b) >= 3) & a.contains(b)
    return ~((a == b) | within)


def out_of_range(rows: DataFrame, limits: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """(keys, field, value) of every value outside its range, one row for each broken field; nulls break nothing."""
    marks = F.array(*[F.when(~F.col(f).cast("double").between(lo, hi), F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"))) for f, (lo, hi) in limits.items()])
    return rows.select(*keys, F.inline(F.array_compact(marks)))


def parts_and_total(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, absolute: float = 2.0, relative: float = 0.03) -> DataFrame:
    """(key, n_parts, parts_sum, total, status): ok where parts sum to the total within the larger tolerance, else wrong; unchecked without either."""
    s = parts.groupBy(key).agg(F.count(part).alias("n_parts"), F.sum(part).alias("parts_sum"))
    j = totals.select(key, F.col(total).alias("total")).join(s, key, "left")
    near = F.abs(F.col("parts_sum") - F.col("total")) <= F.greatest(F.lit(absolute), F.abs("total") * relative)
    status = F.when(F.col("parts_sum").isNull() | F.col("total").isNull(), "unchecked").when(near, "ok").otherwise("wrong")
    return j.select(key, F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "parts_sum", "total", status.alias("status"))


def gain(before: Column, after: Column) -> Column:
    """The gain on the initial state in percent, one decimal; null where the initial state is not positive."""
    return F.when(before > 0, F.floor((before - after) / before * 1000 + 0.5) / 10)


def cap_confidence(confidence: Column, boost: Column, validated: Column, review_cap: Column) -> Column:
    """Learning alone does not lift a reading over 0.90, and a review cap holds for all that is not validated."""
    learned = F.when((boost > 0) & ~validated & (confidence >= 0.90) & (confidence - boost < 0.90), 0.899).otherwise(confidence)
    return F.when(validated, 1.0).otherwise(F.least(learned, F.coalesce(review_cap, F.lit(1.0))))


def contested(readings: DataFrame, by: list[str], value: str, doc: str) -> DataFrame:
    """(by, n_values, n_docs, contested): whether documents give more than one value. Minima and maxima decide, so no set is collected."""
    g = readings.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(doc).alias("d0"), F.max(doc).alias("d1"))
    return g.select(*by, ((F.col("lo") != F.col("hi")) & (F.col("d0") != F.col("d1"))).alias("contested"))


def reliability(method: Column, accuracy: Column, n: Column, confidence: Column, is_contested: Column, contested_accuracy: Column) -> Column:
    """certified, sure, probable or to-check. Reference and pasted values are certified and manual ones sure; else measured accuracy
    from twelve cases on, else confidence; a contested value is to check unless contested values of its kind proved right in 85 %."""
    measured = F.when(n >= 12, F.when(accuracy >= 0.95, "sure").when(accuracy >= 0.85, "probable").otherwise("to-check"))
    plain = F.coalesce(measured, F.when(confidence >= 0.85, "probable").otherwise("to-check"))
    doubtful = F.when(F.coalesce(contested_accuracy, F.lit(0.0)) >= 0.85, F.when(plain == "sure", "probable").otherwise(plain)).otherwise("to-check")
    return F.when(method.isin("reference", "free-paste"), "certified").when(method == "manual", "sure").when(F.coalesce(is_contested, F.lit(False)), doubtful).otherwise(plain)


def backoff(rows: DataFrame, measured: DataFrame, levels: list[list[str]], least: int = 12) -> DataFrame:
    """rows with precision, n and level from the first list of keys for which measured (keys, ok 0/1) has at least so many cases.

    One aggregation and one join for each level; a level's table has one row for a combination of its keys.
    """
    out, found, size, level = rows, F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for i, keys in reversed(list(enumerate(levels))):
        per = measured.groupBy(*keys).agg(F.avg(F.col("ok").cast("double")).alias(f"_p{i}"), F.count(F.lit(1)).alias(f"_n{i}")).filter(F.col(f"_n{i}") >= least)
        out = out.join(per, keys, "left")
        found, size, level = F.coalesce(f"_p{i}", found), F.coalesce(f"_n{i}", size), F.when(F.col(f"_n{i}").isNotNull(), i).otherwise(level)
    return out.withColumn("precision", found).withColumn("n", size).withColumn("level", level).drop(*[f"_{c}{i}" for i in range(len(levels)) for c in "pn"])


def ewma(rows: DataFrame, by: list[str], order: list[str], value: str, new: float = 0.28) -> DataFrame:
    """(by, ewma, n): exponentially weighted mean in the order given, the first value as start.

    In closed form a weighted sum, so only ranks need the order: the k-th of n values weighs new * (1 - new) ** (n - k), the first (1 - new) ** (n - 1).
    """
    w = Window.partitionBy(*by)
    r = rows.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    weight = F.pow(F.lit(1 - new), F.col("_n") - F.col("_k")) * F.when(F.col("_k") == 1, 1.0).otherwise(new)
    return r.groupBy(*by).agg(F.sum(F.col(value) * weight).alias("ewma"), F.count(F.lit(1)).alias("n"))
