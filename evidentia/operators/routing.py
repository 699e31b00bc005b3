"""Routing of occurrences by source rules, agreement, caps and exact de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Confidence added by tier, agreement bonuses by number of documents, ranks outside the lists.
TIER_BONUS = {"main": 0.05, "secondary": -0.03, "forbidden": -0.50, "unrouted": -0.10}
AGREE_TWO, AGREE_THREE = 0.03, 0.05
SECONDARY_RANK, FORBIDDEN_RANK, UNROUTED_RANK, NO_RULE_RANK = 100, 10000, 1000, 999


def route(occ: DataFrame, rules: DataFrame) -> DataFrame:
    """occ (field, doc_type, ...) with tier and source_rank from rules (field, doc_type, tier, rank).

    A forbidden rule decides the tier; a main rule decides the rank even of a forbidden source. Rules are folded to one row for each
    (field, doc_type) first, so the join never multiplies rows; Spark broadcasts them when their measured size allows.
    """
    has = lambda t: F.max(F.when(F.col("tier") == t, F.lit(1)))
    at = lambda t: F.min(F.when(F.col("tier") == t, F.col("rank")))
    per = rules.groupBy("field", "doc_type").agg(has("forbidden").alias("f"), at("main").alias("m"), at("secondary").alias("s"))
    known = rules.select("field").distinct().withColumn("known", F.lit(True))
    j = occ.join(per, ["field", "doc_type"], "left").join(known, "field", "left")
    tier = F.when(F.col("f") == 1, "forbidden").when(F.col("m").isNotNull(), "main").when(F.col("s").isNotNull(), "secondary").otherwise("unrouted")
    rank = F.when(F.col("m").isNotNull(), F.col("m")).when(F.col("s").isNotNull(), SECONDARY_RANK + F.col("s")).when(F.col("f") == 1, FORBIDDEN_RANK)
    rank = rank.when(F.col("known"), UNROUTED_RANK).otherwise(NO_RULE_RANK)
    return j.withColumn("tier", tier).withColumn("source_rank", rank.cast("int")).drop("f", "m", "s", "known")


def tier_confidence(tier: Column, confidence: Column) -> Column:
    bonus = F.lit(0.0)
    for t, b in TIER_BONUS.items():
        bonus = F.when(tier == t, F.lit(b)).otherwise(bonus)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + bonus))


def with_agreement(occ: DataFrame) -> DataFrame:
    """occ with agreement (documents that agree on the value) and its bonus in confidence."""
    n = occ.groupBy("building", "field", "value_key").agg(F.countDistinct("doc_id").alias("agreement"))
    bonus = F.when(F.col("agreement") >= 3, AGREE_THREE).when(F.col("agreement") >= 2, AGREE_TWO).otherwise(0.0)
    return occ.join(n, ["building", "field", "value_key"]).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + bonus))


def dedup(occ: DataFrame) -> DataFrame:
    """The most confident of equal occurrences; the first in order of seq of equally confident ones."""
    same = Window.partitionBy("field", "value_key", "building", "doc_id", "page", "excerpt").orderBy(F.col("confidence").desc(), "seq")
    return occ.withColumn("_row", F.row_number().over(same)).filter("_row = 1").drop("_row")
