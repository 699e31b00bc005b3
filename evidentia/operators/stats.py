"""Descriptive statistics and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import written

PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def describe(rows: DataFrame, by: list[str], value: str, digits: int = 2) -> DataFrame:
    """n, min, mean, max and five interpolated percentiles, rounded; nulls count for nothing.

    Percentiles are exact and need no group in one task: equal values are counted map-side, dealt out by ranges of (group, value), and summed up within each range; the ranges before give the rest of a value's
    rank. Of each group only the values at the ten ranks that its percentiles lie between are kept.
    """
    v = F.col(value).cast("double")
    counts = rows.filter(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_v").alias("v_min"), F.max("_v").alias("v_max"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("v_mean"))
    before = dealt.groupBy(*by, "_p").agg(F.sum("_n").alias("_m"))  # one row for each group of a range
    before = before.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_m")).drop("_m")
    ranked = dealt.withColumn("_to", F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_v")))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    ranked = ranked.join(before, same(ranked, before, [*by, "_p"])).select(*[ranked[c] for c in by], "_v", (F.col("_before") + F.col("_to")).alias("_to"), (F.col("_before") + F.col("_to") - F.col("_n")).alias("_from"))
    held = ranked.join(whole, same(ranked, whole, by)).select(*[ranked[c] for c in by], "_v", "_from", "_to", "n")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), (F.floor(p * (F.col("n") - 1)) + k).alias("rank")) for i, p in enumerate(PERCENTILES) for k in (0, 1)])
    hit = held.withColumn("_x", F.explode(F.filter(at, lambda x: (x["rank"] >= F.col("_from")) & (x["rank"] < F.col("_to")))))
    ends = hit.groupBy(*by).agg(*[F.max(F.when((F.col("_x.i") == i) & (F.col("_x.k") == k), F.col("_v"))).alias(f"_{i}_{k}") for i in range(len(PERCENTILES)) for k in (0, 1)])
    j = whole.join(ends, same(whole, ends, by)).select(*[whole[c] for c in [*by, "n", "v_min", "v_mean", "v_max"]], *[c for c in ends.columns if c not in by])
    part = lambda p: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    between = lambda i, p: F.col(f"_{i}_0") + (F.coalesce(f"_{i}_1", f"_{i}_0") - F.col(f"_{i}_0")) * part(p)
    return j.select(*by, "n", *[F.round(c, digits).alias(c) for c in ("v_min", "v_mean", "v_max")], *[F.round(between(i, p), digits).alias(f"p{round(100 * p)}") for i, p in enumerate(PERCENTILES)])


def dominant_share(rows: DataFrame, by: list[str], label: str, amount: str, hybrid: float = 0.30) -> DataFrame:
    """The label with the largest sum in each group, its share, and whether the second reaches the hybrid share."""
    sums = rows.groupBy(*by, label).agg(F.sum(amount).alias("s"))
    w = Window.partitionBy(*by)
    ranked = sums.withColumn("share", F.col("s") / F.sum("s").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("s").desc(), label)))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col(label))).alias("dominant"), F.round(F.max(F.when(F.col("_r") == 1, F.col("share"))), 6).alias("share"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("share") >= hybrid)), F.lit(False)).alias("is_hybrid"))
