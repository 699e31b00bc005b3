"""Line de-duplication with per-document keep bitmaps, in DataFrame functions alone.

Each line is reduced to a 128-bit hash of its key (trimmed, A-Z lowered). The hashes are range-partitioned together with a
slice of the document id, so that a line of very many documents is cut over several tasks, and inside a partition sorted
by document and position. A streaming window then marks the first occurrence in each document, newest document first;
sums per hash give the document count and the one document that keeps the line. The verdicts go back to the occurrences by hash
and slice, and are returned as sparse bitmaps: for each document only those 64-line words that lose a line. Texts are touched again
only to apply a bitmap.

Null or empty text is one empty line. Rows repeated under one id are one document and get the same bitmap; rows with a
null id neither count nor lose lines. Lines shorter than min_chars code points are never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, ascii_lower, bitmap_of, in_bitmap, materialize

MIN_CHARS, MIN_DOCS, SLICES = 40, 5, 16


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, pos, h1, h2) for each line long enough."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.filter(F.char_length("line") >= min_chars)
    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE)))
    keyed = lines.select("id", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, n_dropped, keep): keep is an array of (word, bits) for the 64-line words that lose a line; absent words keep all."""
    occ = materialize(line_keys(docs, id_col, text_col, min_chars), "lines")
    slice_of = F.pmod(F.xxhash64("id"), F.lit(SLICES))
    ranged = occ.withColumn("slice", slice_of).repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("id").desc(), "pos")
    first = ranged.withColumn("first", F.lag("id").over(stream).isNull() | (F.lag("id").over(stream) != F.col("id")))
    common = first.filter("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("holder")).filter(F.col("n_docs") >= min_docs)
    common = materialize(common, "common-lines")
    likely = in_bitmap(occ, F.col("h1"), bitmap_of(common, F.col("h1")), "hit").filter("hit").withColumn("slice", slice_of)
    # The verdict on a line goes to each slice of it, so that a very common line is met in SLICES tasks.
    verdict = common.select("h1", "h2", "holder", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))).alias("slice"))
    drops = likely.join(verdict, ["h1", "h2", "slice"]).filter(F.col("id") != F.col("holder")).select("id", "pos").distinct()
    words = drops.groupBy("id", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("gone"), F.count(F.lit(1)).alias("n"))
    return words.groupBy("id").agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")).withColumnRenamed("id", id_col)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with text_col rebuilt from its kept lines, and n_dropped; untouched texts are not shuffled.

    Raises ValueError if docs has a column n_dropped of its own.
    """
    if "n_dropped" in docs.columns:
        raise ValueError("docs has a column n_dropped; rename it")
    bitmaps = materialize(bitmaps, "keep-bitmaps").withColumnRenamed("n_dropped", "__ev_n").withColumnRenamed("keep", "__ev_keep").withColumnRenamed(id_col, "__ev_bid")
    flagged = in_bitmap(docs, F.col(id_col), bitmap_of(bitmaps, F.col("__ev_bid")), "__ev_hit")
    # Bitmaps grow with the corpus, so they are never broadcast, whatever their size here.
    hit = flagged.filter("__ev_hit").drop("__ev_hit").join(bitmaps.hint("merge"), F.col(id_col) == F.col("__ev_bid"), "left")
    bit = "coalesce(try_element_at(__ev_map, cast(i div 64 as int)), -1L)"
    hit = hit.withColumn("__ev_map", F.map_from_entries("__ev_keep"))
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> getbit({bit}, i % 64) = 1), '\\n')")
    hit = hit.withColumn(text_col, F.when(F.col("__ev_n").isNull(), F.col(text_col)).otherwise(kept))
    hit = hit.withColumn("n_dropped", F.coalesce("__ev_n", F.lit(0).cast("long"))).drop("__ev_map", "__ev_keep", "__ev_n", "__ev_bid")
    return hit.unionByName(flagged.filter("not __ev_hit").drop("__ev_hit").withColumn("n_dropped", F.lit(0).cast("long")))
