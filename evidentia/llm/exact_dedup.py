"""Exact de-duplication by progressive refinement, in DataFrame functions alone.

Rows are compared on their texts without white space. Three keys of growing cost narrow the field: the length of the
compared text, then a hash of its first characters, then a digest of all of it. A row alone under a key is settled there;
only rows that share it go on. What goes from step to step is a bitmap over the shared keys, so no text is
ever shuffled: the digest is taken where the text is read, and narrow rows are grouped. A bitmap's false positives cost a
needless digest and never change a result; where there are too many shared keys for one (some four million), all rows get a digest.

Null text counts as empty, and empty texts are equal. Of equal texts the longest original stays, then the smallest id.
Rows repeated under one id share its verdict; a null id sorts before all others. A group of any size is summed up on the map side, and its
rows meet their group in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialize, squeeze_out

PREFIX_CHARS = 64


def _prefix(text, norm):
    """The first PREFIX_CHARS of the compared text, from the head of the text where that is enough."""
    head = squeeze_out(F.substring(text, 1, 4 * PREFIX_CHARS))
    return F.when(F.char_length(head) >= PREFIX_CHARS, F.substring(head, 1, PREFIX_CHARS)).otherwise(F.substring(norm, 1, PREFIX_CHARS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for each row; digest is null for rows settled early unless digest_all."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", text.alias("_text")).withColumn("_norm", squeeze_out(F.col("_text")))

    keys = materialize(rows.select(F.octet_length("_norm").alias("len"), F.xxhash64(_prefix(F.col("_text"), F.col("_norm"))).alias("head")), "exact-keys")
    by_len = materialize(keys.groupBy("len").count().filter("count > 1"), "exact-lengths")
    lens = bitmap_of(by_len, F.col("len"))
    by_head = materialize(in_bitmap(keys, F.col("len"), lens, "hit").filter("hit").groupBy("len", "head").count().filter("count > 1"), "exact-heads")
    heads = bitmap_of(by_head, F.struct("len", "head"))

    full = rows.select("_id", "_norm", F.char_length("_text").alias("_chars"), F.octet_length("_norm").alias("len"), F.xxhash64(_prefix(F.col("_text"), F.col("_norm"))).alias("head"))
    full = in_bitmap(full, F.struct("len", "head"), heads, "hit")
    digest = F.sha2(F.col("_norm"), 256)
    full = materialize(full.select("_id", "_chars", "hit", (digest if digest_all else F.when(F.col("hit"), digest)).alias("digest")), "exact-rows")

    left = full.filter("hit")
    best = left.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").alias("i"))).alias("best"))
    grouped = left.join(best, "digest").select("_id", F.col("best.i").alias("keep_id"), "group_size", "digest")
    alone = full.filter("not hit").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return grouped.unionByName(alone).select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
