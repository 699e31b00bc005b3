"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

Targets: sources share a total by weight; none gets more than `most` times its own size, and the excess is shared again by
weight among the others until none is above (the closed form of that loop: sources in order of limit per weight).
Quotas: the mix is made of blocks of equal token count. Whole blocks go to the sources with the highest quotients
target / (2k + 1), and each source's blocks to its shards in the same way by the shards' sizes, so every
(source, shard) has an integer quota. A shard holds about shard_tokens tokens by a seeded hash of the id; a source has as many shards as its own size
asks for, so a small source beside large ones keeps whole blocks and comes as near to its target.
Selection: a shard's documents stand in seeded order on a line of tokens that is cut into blocks; a quota takes all blocks
as often as it can and the rest as a run of blocks from a seeded start, around the end.

A null text has size 0; a null source is a source of its own, last in order. Sources of size 0 have target 0. An empty table
gives no rows. Rows repeated under one id stand side by side on the line. Nothing is drawn at random: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, materialize

WEIGHTS, FACTOR, MOST = (5, 2, 1), 1.5, 2
BLOCK_TOKENS, SHARD_TOKENS, SEED = 32, 4_000_000, "mix-1"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): size is the number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """(source, pos, source_size, total, target), one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("pos", F.row_number().over(order))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "pos")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") * F.lit(float(factor)) - before) / rest)
    free = F.col("cap") > F.col("level") * F.col("w")
    share = F.max(F.when(free, F.col("level"))).over(Window.partitionBy())
    target = F.when(free, share * F.col("w")).otherwise(F.col("cap").cast("double"))
    return by.select("source", "pos", "source_size", "total", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """parties with the column quota: the group's seats given to the highest quotients weight / (2k + 1), ties by order.

    The quota rounded at the mean divisor is off by at most the group's correction in proportion to the weight, so only the
    quotients in that range are ranked: a number of rows in proportion to the parties, whatever the number of seats.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("_w", F.sum(weight).over(g)).withColumn("_p", F.count(F.lit(1)).over(g))
    p = p.withColumn("_q", F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("_d", F.abs(F.col(seats) - F.sum("_q").over(g)) + F.col("_p"))
    p = p.withColumn("_m", F.when(F.col("_w") > 0, F.ceil(F.col("_d") * F.col(weight) / F.col("_w")) + 2).otherwise(F.lit(1)).cast("long"))
    p = p.withColumn("_base", F.greatest(F.col("_q") - F.col("_m"), F.lit(0).cast("long"))).withColumn("_open", F.col(seats) - F.sum("_base").over(g))
    c = p.withColumn("_k", F.explode(F.sequence("_base", F.col("_q") + F.col("_m")))).withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(g.orderBy(F.col("_quotient").desc(), *[F.col(x).asc_nulls_last() for x in order], "_k"))
    won = (rank <= F.col("_open")) & (F.col("_quotient") > 0)
    c = c.withColumn("_won", won.cast("long"))
    keep = [x for x in parties.columns]
    return c.groupBy(*keep, "_base").agg(F.sum("_won").alias("_won")).withColumn("quota", F.col("_base") + F.col("_won")).select(*keep, "quota")


def _hash60(*parts):
    """A seeded hash of 60 bits, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, factor: float = FACTOR,
        most: int = MOST, block: int = BLOCK_TOKENS, shard_tokens: int | None = None, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, shard, taken) for each row."""
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    targets = materialize(source_targets(sizes, weights, factor, most), "targets")
    seats = targets.withColumn("seats", F.floor(F.col("total") * F.lit(float(factor)) / block + 0.5).cast("long")).withColumn("all", F.lit(1))
    blocks = sainte_lague(seats, ["all"], "target", "seats", ["pos"]).select("source", "pos", "source_size", "total", "target", F.col("quota").alias("blocks"))

    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / (shard_tokens or SHARD_TOKENS)))
    d = sizes.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull())
    t = blocks.select("pos", "source_size", "total", "target", "blocks", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"))
    d = d.join(t, ["s", "no_source"]).drop("s", "no_source")
    d = d.withColumn("h", _hash60(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")))).withColumn("shard", F.pmod("h", shards))
    line = Window.partitionBy("pos", "shard").orderBy("h", F.col("id").asc_nulls_first(), "size")
    d = d.withColumn("hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    d = materialize(d.select("id", "source", "size", "pos", "source_size", "target", "blocks", "shard", (F.col("hi") - F.col("size")).alias("lo"), "hi"), "token-line")

    held = d.groupBy("pos", "blocks", "shard").agg(F.sum("size").alias("tokens"))
    held = held.withColumn("nb", F.ceil(F.col("tokens") / block))
    quotas = sainte_lague(held, ["pos"], "nb", "blocks", ["shard"])
    quotas = quotas.withColumn("quota", F.least("quota", most * F.col("nb"))).filter("nb > 0")
    quotas = quotas.withColumn("full", F.expr("quota div nb")).withColumn("rem", F.expr("quota % nb"))
    quotas = quotas.withColumn("a", F.pmod(_hash60(F.lit(seed), F.col("pos"), F.col("shard")), F.col("nb")))
    quotas = quotas.select("pos", "shard", "full", (F.col("a") * block).alias("a"), (F.least(F.col("a") + F.col("rem"), F.col("nb")) * block).alias("b"),
                           (F.greatest(F.col("a") + F.col("rem") - F.col("nb"), F.lit(0)) * block).alias("c"))
    out = d.join(quotas, ["pos", "shard"], "left")
    over = lambda x, y: F.greatest(F.least("hi", y) - F.greatest("lo", x), F.lit(0))
    taken = F.coalesce(F.col("full") * F.col("size") + over(F.col("a"), F.col("b")) + over(F.lit(0).cast("long"), F.col("c")), F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))
