"""What several operators share: white space, work tables, bounded bitmaps, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def squeeze_out(col: Column) -> Column:
    """The text without any white space."""
    for c in WHITE:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is set, a temporary one serves a local session, as in tests; a cluster raises, as its machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read back, and its path; cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """As written, for tables that stay until the folder is cleaned."""
    return written(df, tag)[0]


@contextmanager
def by_first_key(spark: SparkSession):
    """While this holds, joins on several keys take tables dealt out by the first of them as they are, without a new shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_ROWS rows from now on in its session: whole texts make the default batch too large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(df.sparkSession.conf.get(name))
    if most <= 0 or most > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


#: Bits for each key, and the most of all: 2**26 bits are 2**20 rows.
KEY_BITS, MOST_BITS = 16, 1 << 26


def bitmap_of(keys: DataFrame, key: Column, most: int = MOST_BITS) -> tuple[DataFrame, int] | None:
    """A hashed bitmap of the keys of a written table, as rows (word, mask) that may be broadcast, and its bits: KEY_BITS for each
    key by count, so one in KEY_BITS others is let through. None if that takes more than most bits (some four million keys):
    then nothing is pruned, and every row goes into the exact join that follows."""
    bits = 1 << max(12, (KEY_BITS * keys.count()).bit_length())
    if bits > most:
        return None
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    return rows, bits


def in_bitmap(df: DataFrame, key: Column, bitmap: tuple[DataFrame, int] | None, flag: str) -> DataFrame:
    """Add the boolean flag: false is certain, true means the key may be there (an exact join has to follow)."""
    if bitmap is None:
        return df.withColumn(flag, F.lit(True))
    rows, bits = bitmap
    df = df.withColumn("__ev_at", F.pmod(F.xxhash64(key), F.lit(bits)))
    words = F.broadcast(rows.select(F.col("word").alias("__ev_word"), F.col("mask").alias("__ev_mask")))
    hit = F.expr("coalesce(shiftright(__ev_mask, cast(__ev_at % 64 as int)) & 1L, 0L) = 1L")
    return df.join(words, (F.col("__ev_at") / 64).cast("int") == F.col("__ev_word"), "left").withColumn(flag, hit).drop("__ev_at", "__ev_word", "__ev_mask")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in the column id of ids; rows that are certain to stay are not shuffled."""
    gone = materialize(ids.select(F.col("id").alias("__ev_gone")).distinct(), "gone")
    marked = in_bitmap(docs, F.col(id_col), bitmap_of(gone, F.col("__ev_gone")), "__ev_maybe")
    kept = marked.filter("__ev_maybe").join(gone.hint("merge"), F.col(id_col) == F.col("__ev_gone"), "left_anti")
    return kept.union(marked.filter("not __ev_maybe")).drop("__ev_maybe")
