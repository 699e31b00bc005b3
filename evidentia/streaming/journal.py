"""Streams over the journal of events: idempotent append, counts by window, sessions, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import work_path


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a journal; times without zone count as UTC of the session."""
    schema = spark.read.parquet(path).schema
    head, last = path[:-1], path[-1]
    return spark.readStream.schema(schema).parquet(f"{head}[{last}]").withColumn("ts", F.col("ts").cast("timestamp"))


def append_once(events: DataFrame, id_col: str = "event_id", late: str = "1 day") -> DataFrame:
    """Every event once, however often it is sent within the time allowed for late ones; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])


def append_for_good(stream: DataFrame, path: str, id_col: str = "event_id", buckets: int = 64, offsets: str = "offsets") -> None:
    """Every event once for ever: a batch adds to the table at path those whose id is not there. Ids are looked up only in their own buckets, and only as a column.

    A batch that is sent again finds its own rows there and adds nothing, so a restart changes nothing.
    """

    def add(batch: DataFrame, n: int) -> None:
        rows = batch.dropDuplicates([id_col]).withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
        old = _table(batch.sparkSession, path)
        if old is not None:
            rows = rows.join(old.select(F.col(id_col).alias("_id"), F.col("bucket").alias("_b")), (F.col("bucket") == F.col("_b")) & (F.col(id_col) == F.col("_id")), "left_anti")
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/{offsets}").trigger(availableNow=True).start().awaitTermination()


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows at path, None where nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows") if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def window_counts(events: DataFrame, by: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, by, n) of tumbling or sliding windows, each sent once when no late event can change it."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(by, start, n) of sessions that end with a pause of gap, each sent once when it is closed."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("start"), "n")


def drain(stream: DataFrame, tag: str) -> DataFrame:
    """All that a stream sends for the input there is now, as a table in the shared folder; offsets lie beside it, so a new start goes on where it ended."""
    spark = stream.sparkSession
    path = work_path(spark, tag)
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/offsets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def merge_registry(stream: DataFrame, path: str, key: str, order: list[str], buckets: int = 64) -> None:
    """Keep the newest row of each key at path, in buckets by key: a batch is merged with the last version of the buckets it touches, and writes only these as version n.

    A batch that is sent again merges the same older versions and writes its own again, so a restart changes nothing. Versions that two newer ones cover are deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = _versions(spark, path, n)
        if old is not None:
            touched = rows.select("bucket").distinct()
            rows = rows.unionByName(_latest(old, n).drop("version").join(F.broadcast(touched), "bucket", "left_semi"))  # as many rows as buckets
        kept = F.struct(*[c for c in batch.columns if c != key])
        new = rows.groupBy("bucket", key).agg(F.max_by(kept, F.struct(*order)).alias("_w")).select(key, "_w.*", "bucket")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={n}")
        _forget(spark, path, n)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str, below: int) -> DataFrame | None:
    found = _table(spark, path)
    found = found.filter(F.col("version") < below) if found is not None else None
    return found


def _latest(rows: DataFrame, below: int) -> DataFrame:
    """Rows of the last version of each bucket; the versions are told by the folders, one row for each."""
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), ["bucket", "version"])  # as many rows as buckets


def _forget(spark: SparkSession, path: str, n: int) -> None:
    """Delete bucket folders of versions before the last two of the bucket."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    held: dict[str, list[int]] = {}
    for v in fs.listStatus(top):
        name = v.getPath().getName()
        if name.startswith("version="):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    held.setdefault(b.getPath().getName(), []).append(int(name[8:]))
    for bucket, versions in held.items():
        for v in sorted(versions)[:-2]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/version={v}/{bucket}"), True)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key."""
    return _latest(_table(spark, path), 1 << 30).drop("bucket", "version")


def progress(events: DataFrame, by: list[str], late: str = "1 hour") -> DataFrame:
    """(by, n, total): counts and sums that are updated while events still come (update mode); with the watermark no key's state is dropped, keys are few."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def keep_last(stream: DataFrame, path: str, keys: list[str]) -> None:
    """The last row told of each key by a stream in update mode, as a registry at path: later batches replace earlier rows."""

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("bucket", F.lit(0)).withColumn("_n", F.lit(n))
        old = _versions(batch.sparkSession, path, n)
        if old is not None:
            rows = rows.unionByName(_latest(old, n).drop("version").withColumn("_n", F.lit(-1)))
        kept = F.struct(*[c for c in batch.columns if c not in keys])
        new = rows.groupBy("bucket", *keys).agg(F.max_by(kept, "_n").alias("_w")).select(*keys, "_w.*", "bucket")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={n}")
        _forget(batch.sparkSession, path, n)

    stream.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()


def unchanged(files: DataFrame, seen: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """Files (key, stamp columns) that differ from what was seen last, or are new: what an incremental run has to read."""
    return files.join(seen.select(key, *stamp).distinct(), [key, *stamp], "left_anti")
